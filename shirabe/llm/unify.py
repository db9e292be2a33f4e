"""One consistent form for text that reads the same: NFKC, no invisible characters, plain spaces, and
look-alike letters repaired by script.

A token is a run of letters (next to Han and kana, which are written without spaces, a space does
not end it).  Look-alikes are only replaced in tokens that mix scripts, and only if the result
stands in the vocabulary of the corpus, in which every distinct text counts once:

* A word of alphabetic letters that mixes scripts becomes, as a whole, the word of one script that
  looks the same: that of its dominant script (the one of its letters without look-alikes), the most
  frequent one if it has no such letters.
* Any other look-alike is judged in its piece of the token, two letters on each side: another
  look-alike that is far more frequent in this piece takes its place; if none is, in the piece of one
  letter on each side; then the look-alike of the dominant script around it, if the vocabulary
  has it after the two letters before or before the two after; then the frequencies of the pieces before and after, taken
  together.  Only where all of these are silent do copies of texts count.

What nothing in the vocabulary speaks for stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.session import materialize

# Groups of characters of different scripts or kinds that look alike.
LOOKALIKES = [
    "へヘ", "べベ", "ぺペ", "りリ", "カ力", "エ工", "ロ口", "ニ二", "ハ八", "タ夕", "ト卜", "チ千",
    "オ才", "ミ三", "ヒ匕", "ー一", "ヌ又", "セ七", "ノ丿", "メ乂", "ム厶", "イ亻",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙӀ", "GԌ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "QԚ", "SЅ", "TТΤ", "WԜ", "XХΧ", "YУΥ", "ZΖ",
    "aаαɑ", "cсϲ", "eе", "gɡ", "hһ", "iіιı", "jј", "kкκ", "lӏ", "oоο", "pрρ", "sѕ", "xхχ", "yуγ", "vν", "uυ", "dԁ", "qԛ", "wԝѡ",
]
INVISIBLE = {"Cf"}  # Unicode category of format characters: zero-width, joiners, soft hyphen, marks of direction
# Further characters that show nothing.
BLANKS = "ᅟᅠㅤﾠ͏᠎⠀"
USUAL = 4  # another look-alike must be this many times as frequent in the context


@lru_cache(maxsize=1)
def fold_table() -> dict[int, str]:
    return {ord(c): group[0] for group in LOOKALIKES for c in group}


def fold(text: str) -> str:
    """Look-alikes of one group become one character."""
    return text.translate(fold_table())


@lru_cache(maxsize=1)
def _unseen() -> tuple[re.Pattern, re.Pattern]:
    """Patterns of the invisible characters and of the spaces that are not plain."""
    area = [*range(0x20, 0x3100), *range(0xFE00, 0x10000), *range(0x110B0, 0x110D0), *range(0x13430, 0x13440), *range(0x1BCA0, 0x1BCB0), *range(0x1D170, 0x1D180), *range(0xE0000, 0xE0080)]
    kinds = {c: unicodedata.category(chr(c)) for c in area}
    hidden = "".join(re.escape(chr(c)) for c, k in kinds.items() if k in INVISIBLE) + re.escape(BLANKS)
    spaces = "".join(re.escape(chr(c)) for c, k in kinds.items() if k == "Zs" and c != 0x20)
    return re.compile(f"[{hidden}]+"), re.compile(f"[{spaces}]")


@lru_cache(maxsize=1)
def _odd() -> np.ndarray:
    """Per character of the first plane: may a text that holds it differ from its consistent form?  The last place is for all others."""
    hidden, spaces = _unseen()

    def odd(c: str) -> bool:
        jamo = 0x1160 < ord(c) < 0x1200  # these join with what stands before them, as combining marks do
        return jamo or unicodedata.category(c)[0] in "MC" or not unicodedata.is_normalized("NFKC", c) or bool(hidden.match(c) or spaces.match(c))

    return np.array([odd(chr(c)) for c in range(0xD800)] + [True] * 0x800 + [odd(chr(c)) for c in range(0xE000, 0x10000)] + [True])


def base_forms(texts: list[str]) -> list[str]:
    """``base_form`` of many texts; only those that hold an odd character are looked at one by one."""
    if not texts:
        return []
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.concatenate([[0], np.cumsum(_odd()[np.minimum(codes, 0x10000)])])
    ends = np.cumsum([len(t) for t in texts])
    some = seen[ends] > seen[np.concatenate([[0], ends[:-1]])]
    return [base_form(t) if x else t for t, x in zip(texts, some.tolist())]


def base_form(text: str) -> str:
    """NFKC without invisible characters; every kind of space but line ends becomes the plain space."""
    if text.isascii():
        return text
    hidden, spaces = _unseen()
    out = unicodedata.normalize("NFKC", text)
    out, n = hidden.subn("", out)
    out = spaces.sub(" ", out)
    return unicodedata.normalize("NFKC", out) if n else out


@lru_cache(maxsize=1 << 17)
def script(c: str) -> str:
    """Script of a character, by its Unicode name."""
    if c == "ー":
        return "KATAKANA"
    if c in "ɑɡı":
        return "PHONETIC"  # named Latin, but never in a Latin word
    name = unicodedata.name(c, "?")
    return name.split()[0].split("-")[0]


_JAPANESE = "一-鿿々〆ぁ-ゖァ-ヺー"
_TOKEN = re.compile(rf"[^\W\d_]+(?:(?:(?<=[{_JAPANESE}]) +| +(?=[{_JAPANESE}]))[^\W\d_]+)*")
_ALPHABETIC = re.compile("[A-Za-zÀ-ɏɐ-ʯͰ-ϿЀ-ԯᴀ-ᶿḀ-ỿἀ-῿Ⱡ-Ɀ]+")
_WORD = "\x01"  # marks the folded form of a whole word


@lru_cache(maxsize=1)
def _groups() -> dict[str, str]:
    return {c: group for group in LOOKALIKES for c in group}


@lru_cache(maxsize=1)
def _looks() -> re.Pattern:
    return re.compile("[" + "".join(_groups()) + "]")


def dominant(letters: str) -> str:
    """The script that most letters have which look like no other letter; '' if there are none, or a tie."""
    counts: dict[str, int] = {}
    for c in letters:
        if c not in _groups() and c.isalpha():
            counts[script(c)] = counts.get(script(c), 0) + 1
    top = sorted(counts.items(), key=lambda x: -x[1])
    return top[0][0] if top and (len(top) == 1 or top[0][1] > top[1][1]) else ""


def _suggested(form: str, i: int) -> str:
    """The look-alike at ``i`` in the script that dominates the letters around it, else the one there."""
    left, right, own = form[i - 1 : i], form[i + 1 : i + 2], form[i]
    if not left or not right or script(left) != script(right) or script(left) == script(own):
        return own
    if own == "へ" and script(left) == "KATAKANA":
        return own  # the particle stands between words of any script
    fit = [c for c in _groups()[own] if script(c) == script(left)]
    return fit[0] if fit and script(left) in ("HIRAGANA", "KATAKANA", "LATIN") else own


def places(form: str) -> list[tuple[int, str, str, str, bool]]:
    """Look-alikes of a text: position, spelling, folded piece, suggestion, may it change?

    Words of alphabetic letters come whole (their folded form after a mark, the suggestion is the
    dominant script); all other look-alikes by character, with two folded characters on each side.
    """
    hits = [m.start() for m in _looks().finditer(form)]
    if not hits:
        return []
    groups, wide = _groups(), "\x02\x02" + form + "\x03\x03"
    out: list[tuple[int, str, str, str, bool]] = []
    at = 0
    for token in _TOKEN.finditer(form):
        lo, hi = token.span()
        inside = []
        while at < len(hits) and hits[at] < hi:
            inside.append(hits[at])
            at += 1
        if not inside:
            continue
        free = len({script(c) for c in token.group() if c != " "}) > 1
        whole: set[int] = set()
        for m in _ALPHABETIC.finditer(form, lo, hi):
            word = m.group()
            own = {script(c) for c in word} if not word.isascii() else {"LATIN"}
            if _looks().search(word):
                out.append((m.start(), word, _WORD + fold(word), dominant(word) if len(own) > 1 else next(iter(own)), len(own) > 1))
                if len(own) > 1:
                    whole.update(range(*m.span()))
        for i in inside:
            if i not in whole:
                out.append((i, form[i], "".join([groups[c][0] if c in groups else c for c in wide[i : i + 5]]), _suggested(form, i), free))
    return out


def unify(df: DataFrame, keys: list[str], text: str, clean: str = "clean", changed: str = "changed") -> DataFrame:
    """``keys``, ``text``, ``clean`` (consistent form) and ``changed`` (the stored value was not in it).

    Null stays null and unchanged; the empty text is consistent; typing errors and plain spaces
    are left alone, and so is a token of one script, whatever it looks like.  The vocabulary is that
    of the distinct consistent forms of ``df``, so copies weigh nothing unless these are silent;
    repeated rows and null keys come out as they went in.  The text travels once, for the distinct
    forms; pieces travel counted; the repaired forms, which are few, are joined back.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(F.col(text).alias("t"), *[F.col(k).alias(n) for k, n in zip(keys, names)])

    def based(batches):
        for batch in batches:
            stored = batch.column(0).to_pylist()
            full = iter(base_forms([v for v in stored if v]))
            forms = [next(full) if v else v for v in stored]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], [*batch.schema.names, "form"])

    def with_form(frame: DataFrame) -> DataFrame:
        return frame.mapInArrow(based, T.StructType([*frame.schema.fields, T.StructField("form", T.StringType())]))

    once = with_form(rows.where(F.length("t") > 0).select("t")).groupBy("form").agg(F.count("*").alias("rows"))
    forms = materialize(once.withColumn("id", F.monotonically_increasing_id()), "unify-forms")

    def pieces(batches):
        for batch in batches:
            ids, stored = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own, n, found = [], [], []
            for i, m, form in zip(ids, stored, batch.column(2).to_pylist()):
                got = places(form)
                found += got
                own += [i] * len(got)
                n += [m] * len(got)
            p, c, w, s, free = zip(*found) if found else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.int32()), *(pa.array(x, pa.string()) for x in (c, w, s)), pa.array(free, pa.bool_())], ["id", "rows", "p", "c", "w", "s", "free"])

    found = forms.select("id", "rows", "form").mapInArrow(pieces, "id bigint, rows bigint, p int, c string, w string, s string, free boolean")
    # few: only the (piece, spelling) pairs that must change
    fixes = materialize(_fixes(found), "unify-fixes")
    todo = found.where("free").join(fixes, ["w", "c", "s"]).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("p", F.char_length("c").alias("n"), "to"))).alias("subs"))
    spelled = F.aggregate("subs", F.col("form"), lambda text, x: F.overlay(text, x["to"], x["p"] + 1, x["n"]))
    repaired = materialize(forms.join(todo, "id").select("form", spelled.alias("out")), "unify-repaired")
    out = with_form(rows).join(repaired, "form", "left").withColumn("out", F.coalesce("out", "form"))
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), F.col("t").alias(text), F.col("out").alias(clean), F.coalesce(F.col("out") != F.col("t"), F.lit(False)).alias(changed))


def _fixes(found: DataFrame) -> DataFrame:
    """(w, c, s) -> to: which spellings of which pieces must change, and into what."""
    kinds = materialize(found.groupBy("w", "c", "s", "free").agg(F.count("*").alias("m"), F.sum("rows").alias("rows")), "unify-kinds")
    is_word = F.col("w").startswith(_WORD)
    return _letter_fixes(kinds.where(~is_word)).unionByName(_word_fixes(kinds.where(is_word)))


def _word_fixes(kinds: DataFrame) -> DataFrame:
    """Mixed words and the word of one script that the vocabulary has for them."""
    known = kinds.where(~F.col("free")).select("w", F.col("c").alias("to"), F.col("s").alias("of"), "m")
    fit = kinds.where("free").select("w", "c", "s").distinct().join(known, "w").where((F.col("s") == "") | (F.col("s") == F.col("of")))
    return fit.groupBy("w", "c", "s").agg(F.max_by("to", F.struct("m", "to")).alias("to"))


def _letter_fixes(kinds: DataFrame) -> DataFrame:
    # the pieces within the wide one: one character on each side, two before, two after
    parts = {"w": (1, 5), "n": (2, 3), "l": (1, 3), "r": (3, 3)}
    at = {x: F.substring("w", a, n).alias(f"at_{x}") for x, (a, n) in parts.items()}
    # only where the narrow piece is spelled in several ways, or the script asks for another look-alike
    several = kinds.groupBy(at["n"]).agg((F.min("c") != F.max("c")).alias("several"))
    full = kinds.where("free").select("w", "c", "s", *at.values()).distinct().join(several, "at_n").where(F.col("several") | (F.col("s") != F.col("c")))
    for x in parts:
        per = kinds.groupBy(at[x], "c").agg(F.sum("m").alias("m"))
        full = full.join(per.groupBy(f"at_{x}").agg(F.collect_list(F.struct("m", "c")).alias(f"has_{x}")), f"at_{x}")
    stored = kinds.where(F.col("s") == F.col("c")).groupBy(F.col("w").alias("at_w"), "c").agg(F.sum("rows").alias("m"))
    full = full.join(stored.groupBy("at_w").agg(F.collect_list(F.struct("m", "c")).alias("copies")), "at_w", "left")

    def others(has):
        return F.filter(has, lambda x: x.c != F.col("c"))

    def verdict(has):
        """The look-alike that is far more frequent than the own one, or the own one if it is that; else null."""
        own = F.filter(has, lambda x: x.c == F.col("c"))[0].m
        top = F.array_max(others(has))
        return F.when(top.m >= USUAL * own, top.c).when(own >= USUAL * top.m, F.col("c"))

    sides = F.concat("has_l", "has_r")
    both = F.transform(F.array_distinct(F.transform(sides, lambda x: x.c)), lambda c: F.struct(F.aggregate(F.filter(sides, lambda x: x.c == c), F.lit(0).cast("bigint"), lambda acc, x: acc + x.m).alias("m"), c.alias("c")))
    known = (F.size(others(F.col("has_w"))) > 0) | (F.size(others(F.col("has_n"))) > 0)
    rival = F.array_max(others(F.col("has_w"))).m >= F.filter("has_w", lambda x: x.c == F.col("c"))[0].m
    asked = (F.col("s") != F.col("c")) & F.exists(sides, lambda x: x.c == F.col("s"))
    to = F.coalesce(verdict(F.col("has_w")), verdict(F.col("has_n")), F.when(asked, F.col("s")), F.when(known, verdict(both)), F.when(rival, verdict(F.col("copies"))))
    return full.select("w", "c", "s", to.alias("to")).where(F.col("to") != F.col("c"))
