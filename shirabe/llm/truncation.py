"""Texts that were cut off.

A stack automaton reads the whole text: brackets, quotes and markup elements that stay open at the
end, half a tag, half an escape, half a character (the replacement character, a lone surrogate), a
mark of omission.  Texts that end well by it can still be cut.  Two statistics of the corpus tell:

* Endings: how often the last characters of a text stand anywhere in its field and how often at the
  end of a sentence.  Complete endings end most of the sentences in which they stand; the last
  characters of a cut text almost never do.
* Terminators: the share of its texts that each source ends with a sentence end.  Where a source nearly
  always does, a text without one is cut unless its ending is well established.

Only the endings that some text has are counted: their hashes fill a filter of fixed size that every
task tests its n-grams against, so n-grams that end no text never leave the task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.llm.unify import base_forms, fold_table
from shirabe.session import materialize

# Opening and closing signs, sentence ends, and marks of omission.
OPEN = dict(zip("([{「『【〈《“", ")]}」』】〉》”"))
STOPS = "。.!?！？．"
OMITTED = ("…", "...", "‥", "(続", "(続)", "(続く)", "(以下略)", "(以下省略)", "[続く]", "[...]", "(略)", "→", "(cont", "(cont.)", "(continued)", "[truncated]", "<truncated>")
# Markup elements without an end tag, or whose end tag may be left out.
NO_END_TAG = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "p", "li", "td", "tr", "th", "dt", "dd", "option", "truncated"}
LENGTHS = (6, 5, 4, 3, 2)
BROKEN = "\ufffd"
FILTER_BITS = 24  # 2 MB, whatever the corpus holds
_SIGNS = re.compile(r"""<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*?)?(?P<self>/?)>|(?P<inch>[0-9]")(?![^"]*")|(?P<sign>["()\[\]{}「」『』【】〈〉《》“”])""")


def unclosed(text: str) -> bool:
    """Does a bracket, a quote or a markup element stay open at the end?"""
    stack: list[str] = []
    for m in _SIGNS.finditer(text):
        if tag := m.group("tag"):
            tag = tag.lower()
            if m.group("self") or tag in NO_END_TAG:
                continue
            if not m.group("end"):
                stack.append(f"<{tag}")
            elif f"<{tag}" in stack:
                del stack[len(stack) - 1 - stack[::-1].index(f"<{tag}") :]
            continue
        c = m.group("sign")
        if c is None:
            # a length in inches, unless it closes a quote
            if '"' in stack:
                del stack[len(stack) - 1 - stack[::-1].index('"') :]
        elif c in OPEN:
            stack.append(OPEN[c])
        elif stack and c == stack[-1]:
            stack.pop()
        elif c == '"':
            stack.append(c)
    return bool(stack)


def broken_end(text: str) -> bool:
    """Half a character, half an escape or half a tag at the end."""
    if not text:
        return False
    if text[-1] == BROKEN or 0xD800 <= ord(text[-1]) <= 0xDFFF:
        return True
    lt = text.rfind("<")
    if lt >= 0 and ">" not in text[lt:] and re.fullmatch(r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z_:-]+(?:=(?:\"[^\"]*\"?|'[^']*'?|[^\s\"'<>]*))?)*\s*/?|</", text[lt:]):
        return True
    tail = text[-12:]
    amp = tail.rfind("&")
    if amp >= 0 and re.fullmatch(r"&(?:#?[A-Za-z0-9]+|#)", tail[amp:]):
        return True
    slash = tail.rfind("\\")
    return slash >= 0 and re.fullmatch(r"\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?", tail[slash:]) is not None


def _rule(form: str) -> str:
    """The rule that a text breaks by itself, '' if none."""
    if broken_end(form):
        return "broken"
    if form.lower().endswith(OMITTED):
        return "omitted"
    return "unclosed" if unclosed(form) else ""


def _hashes(codes: list[np.ndarray], n: int) -> np.ndarray:
    """Hash of n columns of codes."""
    h = np.zeros(len(codes[0]), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h * np.uint64(0x100000001B3) + codes[k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h + np.uint64(n)


_table: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Code points, look-alikes as one."""
    if not _table:
        table = np.arange(0x30000, dtype=np.uint32)
        for c, to in fold_table().items():
            table[c] = ord(to)
        _table.append(table)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x30000, _table[0][np.minimum(codes, 0x2FFFF)], codes).astype(np.uint64)


def _ending(form: str) -> str:
    return form.rstrip().rstrip(STOPS).rstrip()


def _ending_hashes(tails: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length: hash of the last characters of each text, and whether the text is as long."""
    most = max(LENGTHS)
    codes = _codes("".join([t[-most:].rjust(most, "\0") for t in tails])).reshape(-1, most)
    sizes = np.array([min(len(t), most) for t in tails], np.int64)
    return [(_hashes([codes[:, most - n + k] for k in range(n)], n), sizes >= n) for n in LENGTHS]


def find_cut(df: DataFrame, keys: list[str], text: str, source: str | None = None, share: float = 0.12, least: int = 12, strict: float = 0.98, enough: int = 50, sure: float = 0.5) -> DataFrame:
    """``keys`` and ``rule`` of every cut row: broken, omitted, unclosed, ending or terminator.

    ``keys[0]`` names the field; endings are counted per field over the distinct texts, so copies
    weigh nothing.  ``share`` is the part of its occurrences that must end a sentence for a string to
    count as an ending; the longest string seen at least ``least`` times decides, the text itself not
    counted.  Only where the distinct texts hold none so often, copies of other texts count towards
    ``least``, never towards the share.  A missing final full stop does not matter, but for a
    ``source`` that ends ``strict`` of its distinct texts (``enough`` of them at least) with one: there
    a text without it is cut if its ending ends less than ``sure`` of the sentences it stands in.
    Null, empty and blank texts are not cut.  Repeated rows are judged alike.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(F.col(text).alias("t"), *[F.col(k).alias(n) for n, k in zip(names, keys)], (F.col(source) if source else F.lit(None)).cast("string").alias("src")).where(F.col("t").rlike(r"(?U)\S"))
    field = rows.schema["k0"].dataType

    def based(batches):
        for batch in batches:
            forms = [f.rstrip() for f in base_forms(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(forms, pa.string())], [*batch.schema.names[1:], "form"])

    formed = rows.mapInArrow(based, T.StructType([*rows.schema.fields[1:], T.StructField("form", T.StringType())]))
    texts = formed.groupBy("k0", "form").agg(F.count("*").alias("copies"))

    def ends(batches):
        for batch in batches:
            forms = batch.column(1).to_pylist()
            rule = [_rule(f) for f in forms]
            stop = [f.endswith(tuple(STOPS)) for f in forms]
            per = _ending_hashes([_ending(f) for f in forms]) if forms else []
            some = np.array([not r for r in rule], bool)
            held = np.array([ok & some for _, ok in per]).T if per else np.zeros((0, 5), bool)
            flat = np.array([h.view(np.int64) for h, _ in per]).T[held] if per else np.zeros(0, np.int64)
            h = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(stop, pa.bool_()), h], [*batch.schema.names, "rule", "stop", "h"])

    schema = T.StructType([*texts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("stop", T.BooleanType()), T.StructField("h", T.ArrayType(T.LongType()))])
    judged = materialize(texts.mapInArrow(ends, schema), "endings")
    asked = df.sparkSession.sparkContext.broadcast(_filter(judged.where(~F.col("stop"))))

    def grams(batches):
        held = asked.value
        for batch in batches:
            fields, forms, copies = (c.to_pylist() for c in batch.columns)
            for name in set(fields):
                own = [(f, m) for f, k, m in zip(forms, fields, copies) if k == name]
                flat = _codes("\x03".join([f for f, _ in own]) + "\x03")
                stored = np.repeat([m for _, m in own], [len(f) + 1 for f, _ in own])
                end = np.isin(flat, np.concatenate([[np.uint64(3)], _codes(STOPS)]))
                inside = np.concatenate([[0], np.cumsum(flat == 3)])
                for n in LENGTHS:
                    if len(flat) <= n:
                        continue
                    h = _hashes([flat[k : len(flat) - n + k] for k in range(n)], n)
                    spot = _spot(h)
                    at = np.flatnonzero(held[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
                    at = at[inside[at + n] == inside[at]]
                    u, inv = np.unique(h[at], return_inverse=True)
                    total = np.bincount(inv, minlength=len(u))
                    stop = np.bincount(inv, weights=end[at + n], minlength=len(u)).astype(np.int64)
                    n_rows = np.bincount(inv, weights=stored[at], minlength=len(u)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), batch.column(0).type), pa.array(u.view(np.int64)), pa.array(total), pa.array(stop), pa.array(n_rows)], ["f", "g", "total", "stops", "rows"])

    kind = T.StructType([T.StructField("f", field), *(T.StructField(x, T.LongType()) for x in ("g", "total", "stops", "rows"))])
    counts = judged.select("k0", "form", "copies").mapInArrow(grams, kind).groupBy("f", "g").agg(*(F.sum(x).alias(x) for x in ("total", "stops", "rows")))
    # each distinct ending is judged once per number of its text's copies, at every length, then joined back
    open_end = judged.where((F.col("rule") == "") & ~F.col("stop")).select(F.col("k0").alias("f"), "form", "h", "copies")
    at = open_end.select("f", "h", "copies").distinct().select("f", "h", "copies", F.posexplode("h").alias("pos", "g"))
    thin = F.col("total") < least
    seen = at.join(counts, ["f", "g"]).where(~thin | ((F.col("total") > 1) & (F.col("rows") - F.col("copies") + 1 >= least)))
    first = seen.groupBy("f", "h", "copies").agg(F.min_by(F.struct("total", "stops"), F.struct(thin, "pos")).alias("b"))
    own = F.when(F.col("b.stops") - 1 < (F.col("b.total") - 1) * share, "ending").when(F.col("b.stops") - 1 < (F.col("b.total") - 1) * sure, "terminator")
    weak = first.select("f", "h", "copies", own.alias("rule")).where(F.col("rule").isNotNull())
    lost = open_end.join(weak, ["f", "h", "copies"]).select("f", "form", "rule")
    cut = judged.where(F.col("rule") != "").select(F.col("k0").alias("f"), "form", "rule").unionByName(lost)
    out = _joined(formed, materialize(cut, "cut"), names)
    per = formed.select("k0", "src", F.col("form").rlike(f"[{re.escape(STOPS)}]$").alias("stop"), F.xxhash64("form").alias("x")).distinct()
    base = per.groupBy(F.col("k0").alias("bf"), F.col("src").alias("bs")).agg(F.avg(F.col("stop").cast("double")).alias("ended"), F.count("*").alias("n")).where((F.col("ended") >= strict) & (F.col("n") >= enough) & F.col("bs").isNotNull())
    kept = out.where(F.col("rule") != "terminator").select(*names, "rule")
    missing = out.where(F.col("rule") == "terminator").join(base, F.col("k0").eqNullSafe(F.col("bf")) & (F.col("src") == F.col("bs")), "left_semi").select(*names, "rule")
    return kept.unionByName(missing).select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "rule")


def _joined(formed: DataFrame, cut: DataFrame, names: list[str]) -> DataFrame:
    side = cut.select(F.col("f").alias("cut_f"), F.col("form").alias("cut_form"), "rule")
    return formed.join(side, F.col("k0").eqNullSafe(F.col("cut_f")) & (F.col("form") == F.col("cut_form"))).select(*names, "src", "rule")


def _spot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(judged: DataFrame) -> np.ndarray:
    """The table of ``2 ** FILTER_BITS`` bits on which the endings fall, eight to a number.

    Set bits reach the driver as words of 64, so at most ``2 ** (FILTER_BITS - 6)`` rows do, whatever
    the corpus holds.  A full table filters nothing and loses nothing.
    """

    def words(batches):
        table = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            table[_spot(batch.column(0).flatten().to_numpy().view(np.uint64))] = True
        packed = np.packbits(table, bitorder="little").view(np.int64)
        some = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(packed[some])], ["w", "bits"])

    rows = judged.select("h").mapInArrow(words, "w bigint, bits bigint").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    packed[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()
    return packed.view(np.uint8)
