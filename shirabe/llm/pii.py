"""Personal items inside free text: names, phones, e-mail and postal addresses, identity numbers.

Numbers and addresses have grammars of their own.  Names are found by bootstrapping: names known
from a structured column (family names, and the given names that follow them) are seeds; the
characters around their mentions give contextual patterns; patterns and the fillers they match
form a graph whose scores are iterated in Spark (a filler is as sure as its patterns, a pattern
as sure as its fillers); the patterns that end above a threshold then find names that no seed
held, of any script.  The seeds only teach: finding uses the patterns, and the names of the row itself.

Seeds and patterns are matched by automata, so a text costs its length and its hits, not the number
of seeds or patterns.  A pattern must hold a share of all seed mentions, which bounds the number of
patterns at every size of the corpus.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.session import materialize

_D = "0-9０-９"
_N = f"[{_D}]"
_DASH = "\\-－‐‑–—−ー―ｰ"
_KANJI = "一-鿿々〆ヶヵ"

# Forms of phone numbers, and the words before a number that is none.
PHONE = re.compile(
    rf"(?<![{_D}A-Za-z@._+＋{_DASH}])(?:[+＋]{_N}{{1,3}}[ 　{_DASH}]?[(（]?{_N}{{1,4}}[)）]?[ 　{_DASH}.]?{_N}{{2,4}}[ 　{_DASH}.]?{_N}{{3,4}}"
    rf"|[(（][0０]{_N}{{1,4}}[)）][ 　]?{_N}{{1,4}}[ 　{_DASH}.]?{_N}{{3,4}}"
    rf"|[0０]{_N}{{1,4}}(?P<s>[{_DASH}.．・ 　]){_N}{{1,4}}(?P=s){_N}{{3,4}}"
    rf"|[0０][5-9５-９][0０]{_N}{{8}}|[0０][1-9１-９]{_N}{{8}})(?![{_D}A-Za-z]|[{_DASH}]{_N})"
)
NOT_PHONE = re.compile(r"(?:番号|ID|Id|No|NO|コード|ロット|検体|整理|カルテ|機器|〒)\s*[:：.]?\s*$")
# Ways to write the at sign.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*(?:[@＠]|[ 　]?[(\[{（［〔<]\s*(?:at|AT|At|アット|アットマーク|@|＠)\s*[)\]}）］〕>][ 　]?| at | AT |[ 　]?(?:アットマーク|★|☆)[ 　]?)[A-Za-z0-9\-]+(?:(?:\.|．| ?[(\[]dot[)\]] ?)[A-Za-z0-9\-]+)*(?:\.|．| ?[(\[]dot[)\]] ?)[A-Za-z]{2,}")
# Words that announce an identity number.
ID_WORDS = r"(?:個人番号|マイナンバー(?:カード)?(?:の?番号)?|被保険者(?:証)?(?:番号)?|健康保険証?(?:番号)?|保険証(?:の?番号)?|保険者番号|(?:運転)?免許証?(?:の?番号)?|パスポート(?:の?番号)?|旅券(?:の?番号)?|(?:基礎)?年金(?:手帳)?(?:の?番号)?|(?:My ?Number|Passport|Insurance|Licen[cs]e|Pension)(?: ?(?:No|number))?)"
ID_NUMBER = re.compile(rf"{ID_WORDS}(?:\s*(?:は|が|:|：|No\.?|NO\.?|№|番号|第|＝|=|「|\(|（))*\s*((?:[A-ZＡ-Ｚ]{{1,2}}[ 　]?)?{_N}(?:[{_D}]|[ 　{_DASH}](?={_N}))*{_N})(?!{_N})", re.IGNORECASE)
# The prefectures of Japan.
PREFECTURES = "北海道|青森県|岩手県|宮城県|秋田県|山形県|福島県|茨城県|栃木県|群馬県|埼玉県|千葉県|東京都|神奈川県|新潟県|富山県|石川県|福井県|山梨県|長野県|岐阜県|静岡県|愛知県|三重県|滋賀県|京都府|大阪府|兵庫県|奈良県|和歌山県|鳥取県|島根県|岡山県|広島県|山口県|徳島県|香川県|愛媛県|高知県|福岡県|佐賀県|長崎県|熊本県|大分県|宮崎県|鹿児島県|沖縄県"
_NUM = f"(?:[{_D}]+|[一二三四五六七八九十百〇]+)"
_HOUSE = rf"(?:{_NUM}丁目(?:{_NUM}番地?(?:の?{_NUM}号?)?|{_NUM}[{_DASH}の]{_NUM}(?:[{_DASH}]{_NUM})*|{_NUM}(?!日|月|年|歳))|{_NUM}番地?(?:の?{_NUM}号?)?|[{_D}]+(?:[{_DASH}][{_D}]+)+)(?:号)?"
_ROOM = rf"(?:[{_DASH}][{_D}]+(?:号室?)?|[ 　]?(?:第[一二三四五六七八九十{_D}]+)?(?!より|へ|から|に|で|の|が|を|は|と|まで)[ァ-ヺー{_KANJI}A-Za-zＡ-Ｚ・]{{1,14}}?(?:[A-ZＡ-Ｚ]?棟)?[{_D}]+(?:号室|号棟|号|階|室|F|Ｆ)?(?:[ 　]?[{_D}]+号?室)?(?![{_D}/年月日時分:：mM％%]))"
_PLACE = rf"[{_KANJI}ぁ-んァ-ヺー]"
ADDRESS = re.compile(
    rf"(?:〒[ 　]?{_N}{{3}}[{_DASH}]?{_N}{{4}}[ 　]?)?(?:(?:{PREFECTURES})[ 　]?)?(?:[{_KANJI}ヶケ]{{1,7}}?[市郡区]|[{_KANJI}ヶケ]{{1,5}}?[町村])(?:{_PLACE}{{0,20}}?){_HOUSE}{_ROOM}?"
)
# What stands around a name in a name field.
NAME_LABEL = re.compile(r"^(?:氏名|名前|患者名|患者氏名|故|Name)[ 　:：]+|^故(?=[一-鿿])", re.IGNORECASE)
HONORIFIC = re.compile(r"[ 　]*(?:さん|さま|様|殿|氏|先生|君|くん|ちゃん|[(（][^()（）]*[)）])$")
NO_NAME = re.compile(r"^(?:匿名|不明|氏名不明|非公開|仮名|本人|家族|同上|該当なし|未記入|未登録|患者|症例|検体|テスト|なし|[A-Z]|.*(?:患者|症例|被験者|ケース|case|patient|row|subject)[ _\-]?[A-Za-z0-9０-９]{1,12})$", re.IGNORECASE)
LETTERS = re.compile(rf"^(?:[{_KANJI}ぁ-んァ-ヺー]+(?:[ 　・]?[{_KANJI}ぁ-んァ-ヺー・]+)?|[A-Za-z][A-Za-z'.\-]*(?:[ 　]+[A-Za-z][A-Za-z'.\-]*)+)$")
SLOT = rf"(?:[{_KANJI}]{{1,6}}(?:[ノの][{_KANJI}]{{1,3}})?(?:[ 　][{_KANJI}]{{1,4}}(?:[ノの][{_KANJI}]{{1,2}})?)?|[ァ-ヺー]{{2,10}}(?:[ 　・][ァ-ヺー]{{2,10}})?|[A-Z][A-Za-z'\-]+[ 　][A-Z][A-Za-z'\-]+)"
LEFT, RIGHT = 4, 2
SEEDS = 20_000
# What follows a name of one character, and characters that stand there for relatives and roles.
TITLES = ("さん", "さま", "様", "氏", "先生", "医師", "殿", "看護師", "くん", "君", "ちゃん")
NO_NAME_ALONE = set("父母兄姉弟妹夫妻娘息子孫祖叔伯甥姪嫁婿客主君医師士人者方皆様彼私我男女児院前後他")
_STOP = "。.\n「」『』)）"


def _free(spans: list[tuple[int, int]], lo: int, hi: int) -> bool:
    return all(hi <= a or lo >= b for a, b in spans)


def plain_items(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the items that grammars alone find."""
    out: list[tuple[str, int, int]] = []
    used: list[tuple[int, int]] = []

    def add(kind: str, lo: int, hi: int) -> None:
        if _free(used, lo, hi):
            used.append((lo, hi))
            out.append((kind, lo, hi))

    for m in EMAIL.finditer(text):
        add("EMAIL", *m.span())
    for m in ADDRESS.finditer(text):
        lo, hi = m.span()
        if _free(used, lo, hi):
            add("ADDRESS", lo, hi)
    for m in ID_NUMBER.finditer(text):
        if sum(c.isdigit() for c in m.group(1)) >= 6:
            add("ID_NUMBER", *m.span(1))
    for m in PHONE.finditer(text):
        lo, hi = m.span()
        digits = sum(c.isdigit() for c in m.group())
        if 9 <= digits <= 15 and not NOT_PHONE.search(text[max(lo - 8, 0) : lo]):
            add("PHONE", lo, hi)
    return out


def field_name(value: str) -> tuple[str, int, int] | None:
    """The name in a name field and its place, without labels, titles, contacts and case codes."""
    cut = len(value)
    for kind, lo, _ in plain_items(value):
        cut = min(cut, lo)
    head = value[:cut] if cut < len(value) else value
    if cut < len(value):
        head = re.sub(r"[ 　]*(?:TEL|Tel|tel|電話|携帯|Mail|mail|E-mail|メール|〒|住所)?[ 　:：/／,、<＜(（\[]*$", "", head)
    lo = 0
    if m := NAME_LABEL.match(head):
        lo = m.end()
    core = head[lo:].rstrip(" 　,、")
    while m := HONORIFIC.search(core):
        if m.start() == 0:
            break
        core = core[: m.start()]
    lead = len(core) - len(core.lstrip(" 　"))
    core = core.strip(" 　")
    if not core or (len(core) == 1 and (core in NO_NAME_ALONE or not re.match(f"[{_KANJI}]", core))) or any(c.isdigit() for c in core) or NO_NAME.match(core) or not LETTERS.match(core):
        return None
    return core, lo + lead, lo + lead + len(core)


class Lexicon:
    """Known family and given names; finds them in a text by an automaton."""

    def __init__(self, families: tuple[str, ...], givens: tuple[str, ...]):
        import ahocorasick

        self.families, self.givens = set(families), set(givens)
        self.lengths = sorted({len(g) for g in givens}, reverse=True)
        self.auto = ahocorasick.Automaton()
        for f in families:
            self.auto.add_word(f, len(f))
        if families:
            self.auto.make_automaton()

    def _end(self, text: str, at: int) -> int:
        """Where the name whose family part ends at ``at`` ends: after the longest given name that follows, if one does."""
        for gap in (0, 1):
            if gap and text[at : at + 1] not in (" ", "　", "・"):
                break
            for n in self.lengths:
                if text[at + gap : at + gap + n] in self.givens and len(text) >= at + gap + n:
                    return at + gap + n
        return at

    def find(self, text: str) -> list[tuple[int, int]]:
        """Mentions from left to right without overlap, the longest of each place."""
        if not self.families:
            return []
        hits = sorted(((e + 1 - n, self._end(text, e + 1)) for e, n in self.auto.iter(text)), key=lambda h: (h[0], -h[1]))
        out: list[tuple[int, int]] = []
        for lo, hi in hits:
            if not out or lo >= out[-1][1]:
                out.append((lo, hi))
        return out

    def known(self, filler: str) -> bool:
        if filler in self.families:
            return True
        return any(filler[:i] in self.families and (filler[i:] in self.givens or (filler[i] in " 　・" and filler[i + 1 :] in self.givens)) for i in range(1, len(filler)))


def _sides(text: str, lo: int, hi: int) -> list[tuple[str, str]]:
    """The contexts of a mention: a short and a longer left side, "^" for a sentence start, "$" for the end."""
    right = text[hi : hi + RIGHT]
    right = right[:1] if right[:1] in _STOP else right
    left = text[max(lo - LEFT, 0) : lo]
    cut = max((left.rfind(c) for c in _STOP), default=-1)
    whole = lo <= LEFT or cut >= 0
    left = left[cut + 1 :].lstrip(" 　\n") if cut >= 0 else left
    sides = {"^" + left if whole else left, left[-2:] if len(left) >= 2 else "^" + left if whole else left}
    return [(x, right or "$") for x in sorted(sides) if x]


@lru_cache(maxsize=4)
def _lexicon(families: tuple[str, ...], givens: tuple[str, ...]) -> Lexicon:
    return Lexicon(families, givens)


@lru_cache(maxsize=1 << 16)
def _filler(right: str) -> re.Pattern:
    return re.compile(rf"{SLOT}(?={'$' if right == '$' else re.escape(right)})")


_SLOT_AT = re.compile(SLOT)


class Patterns:
    """Rules (left side, right side); finds their fillers by an automaton over the left sides."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        import ahocorasick

        by: dict[str, list[tuple[int, bool, str]]] = defaultdict(list)
        for i, (left, right) in enumerate(rules):
            by[left[1:] if left.startswith("^") else left].append((i, left.startswith("^"), right))
        self.at_start = by.pop("", [])  # rules of a sentence start alone
        self.auto = ahocorasick.Automaton()
        for anchor, own in by.items():
            self.auto.add_word(anchor, (len(anchor), own))
        if by:
            self.auto.make_automaton()
        self.some = bool(by)

    def find(self, text: str):
        """Rule number and span of every filler; one character alone counts only before a title."""
        places = [(e + 1, n, own) for e, (n, own) in self.auto.iter(text)] if self.some else []
        if self.at_start:
            places += [(p, 0, self.at_start) for p in {0, *(m.end() for m in re.finditer(rf"[{re.escape(_STOP)}][ 　\n]?", text))}]
        for p, n, own in places:
            if not _SLOT_AT.match(text, p):
                continue
            first = p == n or text[p - n - 1] in _STOP or (text[p - n - 1] in " 　\n" and p - n > 1 and text[p - n - 2] in _STOP)
            for i, start, right in own:
                if start and not first:
                    continue
                m = _filler(right).match(text, p)
                if m and (m.end() - p > 1 or (text.startswith(TITLES, m.end()) and m.group() not in NO_NAME_ALONE)):
                    yield i, p, m.end()


@lru_cache(maxsize=4)
def _patterns(rules: tuple[tuple[str, str], ...]) -> Patterns:
    return Patterns(rules)


def learn_names(df: DataFrame, name: str, family: str, text: str, least: int = 4, share: float = 2e-5, sure: float = 0.5, rounds: int = 3, seeds: int = SEEDS) -> Broadcast:
    """The accepted (left, right) patterns, sent to the executors.

    At most ``seeds`` of the most frequent family and given names start the search: a bound on the
    labelled examples, not on the texts, all of which are read for patterns and for fillers.
    ``least`` distinct names must stand in a context before it becomes a pattern, and ``share`` of
    the (context, name) pairs of all contexts: there are at most ``1 / share`` patterns, however
    large the corpus.
    """
    sc = df.sparkSession.sparkContext
    fam = df.where(F.length(family) >= 1).groupBy(F.col(family).alias("w")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").limit(seeds)
    families = tuple(r["w"] for r in fam.collect())

    def cores(batches):
        for batch in batches:
            out = []
            for v, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = field_name(v) if v else None
                rest = got[0][len(f) :].strip(" 　・") if got and f and got[0].startswith(f) else ""
                out.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["w"])

    giv = df.where(F.length(name) > 0).select(name, family).mapInArrow(cores, "w string").where(F.length("w") > 0).groupBy("w").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").limit(seeds)
    givens = tuple(r["w"] for r in giv.collect())
    if not families:
        return sc.broadcast(())
    known = sc.broadcast((families, givens))
    texts = df.select(F.col(text).alias("t")).where(F.length("t") > 0)

    def contexts(batches):
        lex = _lexicon(*known.value)
        for batch in batches:
            found = set()
            for t in batch.column(0).to_pylist():
                for lo, hi in lex.find(t):
                    found.update((left, right, t[lo:hi]) for left, right in _sides(t, lo, hi))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(3)], ["l", "r", "x"])

    pairs = materialize(texts.mapInArrow(contexts, "l string, r string, x string").distinct(), "name-contexts")
    needed = max(least, share * pairs.count())
    seen = pairs.groupBy("l", "r").agg(F.count("*").alias("e"))
    rules = tuple((r["l"], r["r"]) for r in seen.where(F.col("e") >= needed).orderBy("l", "r").collect())
    if not rules:
        return sc.broadcast(())
    tried = sc.broadcast(rules)

    def fillers(batches):
        lex, patterns = _lexicon(*known.value), _patterns(tried.value)
        for batch in batches:
            found = {(i, t[lo:hi]) for t in batch.column(0).to_pylist() for i, lo, hi in patterns.find(t)}
            n, x = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(x, pa.string()), pa.array([lex.known(v) for v in x], pa.bool_())], ["rule", "x", "known"])

    graph = materialize(texts.mapInArrow(fillers, "rule int, x string, known boolean").groupBy("rule", "x").agg(F.max("known").alias("known")), "name-graph")
    score = graph.groupBy("rule").agg(F.avg(F.col("known").cast("double")).alias("p"))
    for _ in range(rounds):
        mixed = graph.join(score, "rule")
        filler = mixed.groupBy("x").agg(F.max("known").alias("known"), (1 - F.product(1 - F.least(F.col("p"), F.lit(0.99)) * 0.9)).alias("s")).select("x", F.when(F.col("known"), F.lit(1.0)).otherwise(F.col("s")).alias("s"))
        score = graph.join(filler, "x").groupBy("rule").agg(F.avg("s").alias("p"))
    good = sorted(r["rule"] for r in score.where(F.col("p") >= sure).collect())
    return sc.broadcast(tuple(rules[i] for i in good))


def _own_names(text: str, value: str | None) -> list[tuple[int, int]]:
    """Mentions of the name that the row's own name field holds, its parts joined in any way."""
    got = field_name(value) if value and not value.isspace() else None
    if not got or len(got[0]) < 3:
        return []
    parts = [re.escape(x) for x in re.split("[ 　・]+", got[0])]
    return [m.span() for m in re.finditer("[ 　・]?".join(parts), text)] if got[0][:2] in text else []


def _text_names(text: str, rules: tuple[tuple[str, str], ...], used: list[tuple[int, int]], name: str | None = None) -> list[tuple[str, int, int]]:
    spans = [(hi - lo, lo, hi) for _, lo, hi in _patterns(rules).find(text)] if rules else []
    spans += [(hi - lo, lo, hi) for lo, hi in _own_names(text, name)]
    out: list[tuple[str, int, int]] = []
    for _, lo, hi in sorted(spans, key=lambda s: (-s[0], s[1])):
        if _free(used, lo, hi):
            used.append((lo, hi))
            out.append(("NAME", lo, hi))
    return out


def find_items(df: DataFrame, keys: list[str], fields: dict[str, str], learned: Broadcast, placeholder: bool = False) -> DataFrame:
    """Items of every field: ``keys``, ``fld``, ``pii_kind``, ``pii_text``, or with ``placeholder`` the text.

    ``fields`` says how each column is read: "name" (a field for names) or "text".  With
    ``placeholder`` one row per row and field comes out, ``fld`` and ``masked``: each item replaced
    by its kind in brackets, all else untouched, null for null.  Blank values hold nothing.
    A name that a name field of the row holds counts in its texts too.
    """
    names = [f"k{i}" for i in range(len(keys))]
    named = F.coalesce(*[F.when(F.trim(f) != "", F.col(f)) for f, how in fields.items() if how == "name"], F.lit(None).cast("string"))
    rows = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], named.alias("own"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("fld", "v"))
    rows = rows.select(*names, "fld", "v", F.when(F.col("fld").isin([f for f, how in fields.items() if how != "name"]), F.col("own")).alias("own"))

    def items(value: str, how: str, own: str | None) -> list[tuple[str, int, int]]:
        found = plain_items(value)
        used = [(lo, hi) for _, lo, hi in found]
        if how == "name":
            got = field_name(value)
            if got and _free(used, got[1], got[2]):
                found.append(("NAME", got[1], got[2]))
            return found
        return found + _text_names(value, learned.value, used, own)

    def run(batches):
        for batch in batches:
            fld, val, own = (batch.column(len(names) + i).to_pylist() for i in range(3))
            at, kinds, texts, masked = [], [], [], []
            for i, (f, v, o) in enumerate(zip(fld, val, own)):
                got = items(v, fields[f], o) if v and not v.isspace() else []
                if placeholder:
                    for kind, lo, hi in sorted(got, key=lambda g: -g[1]):
                        v = v[:lo] + f"[{kind}]" + v[hi:]
                    masked.append(v)
                else:
                    for kind, lo, hi in got:
                        at.append(i), kinds.append(kind), texts.append(v[lo:hi])
            if placeholder:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(masked, pa.string())], [*names, "fld", "masked"])
            else:
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:-2]), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], [*names, "fld", "pii_kind", "pii_text"])

    own = [T.StructField(n, rows.schema[n].dataType) for n in [*names, "fld"]]
    tail = ["masked"] if placeholder else ["pii_kind", "pii_text"]
    out = rows.mapInArrow(run, T.StructType([*own, *(T.StructField(t, T.StringType()) for t in tail)]))
    out = out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "fld", *tail)
    return out if placeholder else out.distinct()
