"""Freely typed values mapped to the entries of a reference list.

An automaton over canonical labels, readings and aliases finds embedded mentions; the longest
non-overlapping ones win.  Aliases are made from the list itself: labels fall into a beginning, a
middle and an end that recur in other labels (found by how many different characters follow or
precede them), the readings of these parts follow from the readings of the labels, and each label
gets its parts in the usual orders, each part by sign or by reading.  An alias of several entries
names none of them.  What the automaton leaves goes to token-set similarity: tokens are the pairs of
adjacent characters, the sets meet through inverted lists, and every form whose set is close enough
to be within the allowed number of edits is verified by edit distance; the closest is meant.  No
form is left out that could win: an edit removes at most three pairs of a set.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.llm.unify import base_form, fold

UNMATCHED = "UNMATCHED"
MAX_ENTRIES = 100_000
# Remarks that people add to a label.
REMARKS_BEFORE = r"^(?:s/o|r/o|再発|既往|疑い|疑|術後|左|右|両側の|軽度の|#?\d+[.)])\s*[:：]?\s*"
REMARKS_AFTER = r"(?:の疑い|疑い|疑|既往歴|既往|術後|経過観察(?:中)?|再発|など|等|[(【\[](?:右|左|両側|両|状|術後|疑い|疑|既往|再発|仮|要確認|詳細不明|精査中)[)】\]]|\?)$"
# Signs that may stand between the parts of a label.
BETWEEN = re.compile(r"[\s・,、。.;:/|()\[\]{}【】「」『』〈〉<>\"'?!_\-]+")
_HIRA = {c: c - 0x60 for c in range(0x30A1, 0x30F7)}


def key_form(text: str) -> str:
    """Consistent form, look-alikes folded, all kana as hiragana, no signs between parts."""
    out = base_form(text).lower()
    out = BETWEEN.sub("", out)
    return fold(out).translate(_HIRA).lower()


def bare(text: str) -> str:
    """The value without added remarks."""
    out = base_form(text).strip().strip("「」『』\"'")
    while True:
        cut = re.sub(REMARKS_AFTER, "", re.sub(REMARKS_BEFORE, "", out)).strip(" 、,・.。")
        if cut == out or len(cut) < 2:
            return out
        out = cut


def _parts(labels: list[str], ratio: float = 0.3, least: int = 4) -> list[tuple[str, str, str]]:
    """Beginning, middle and end of every label; a missing part is empty."""

    def recurring(words: list[str]) -> dict[str, str]:
        after: dict[str, Counter] = defaultdict(Counter)
        for w in words:
            for i in range(1, len(w)):
                after[w[:i]][w[i]] += 1
        out = {}
        for w in words:
            for i in range(2, len(w) - 1):
                nxt = after[w[:i]]
                total = sum(nxt.values())
                if total >= least and len(nxt) >= ratio * min(total, 12):
                    out[w] = w[:i]
                    break
        return out

    begin = recurring(labels)
    rests = [w[len(begin.get(w, "")) :] for w in labels]
    end = recurring([r[::-1] for r in rests])
    out = []
    for w, r in zip(labels, rests):
        b, e = begin.get(w, ""), end.get(r[::-1], "")[::-1]
        out.append((b, r[: len(r) - len(e)], e))
    return out


def _common(words: list[str], back: bool = False) -> str:
    if back:
        return _common([w[::-1] for w in words])[::-1]
    lo, hi = min(words), max(words)
    n = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
    return lo[:n]


class Matcher:
    """Entry of a value; built from (id, label, reading) rows."""

    def __init__(self, entries: list[tuple[str, str, str | None]], limit: float = 0.55):
        import ahocorasick

        self.limit = limit
        entries = sorted((e for e in entries if e[1]), key=lambda e: e[0])
        labels = [key_form(e[1]) for e in entries]
        readings = [key_form(e[2]) if e[2] else "" for e in entries]
        parts = _parts(labels)
        said = self._readings(parts, readings)
        self.ids = [e[0] for e in entries]
        self.exact: dict[str, int] = {}
        forms: list[tuple[str, int, int]] = []
        for i, ((b, m, e), lab, read) in enumerate(zip(parts, labels, readings)):
            tail = len(m) + len(e) if b and len(m) + len(e) > 1 else len(lab)
            forms.append((lab, i, tail))
            if read:
                forms.append((read, i, max(len(read) * tail // max(len(lab), 1), 1)))
            if b and m and e:
                for order in ((0, 1, 2), (1, 2, 0), (2, 0, 1), (1, "の", 0, 2)):
                    choices = [[(b, m, e)[x], *said.get((x, (b, m, e)[x]), ())] if x != "の" else ["の"] for x in order]
                    for pick in itertools.product(*choices):
                        forms.append(("".join(pick), i, tail))
        owners: dict[str, set[int]] = defaultdict(set)
        for form, i, _ in forms:
            owners[form].add(i)
        label_of = {lab: i for i, lab in reversed(list(enumerate(labels)))}
        auto = ahocorasick.Automaton()
        seen: set[str] = set()
        self.forms: list[tuple[str, int, int]] = []
        for form, i, tail in forms:
            if form in seen or (len(owners[form]) > 1 and label_of.get(form) != i):
                continue
            seen.add(form)
            self.exact[form] = i
            self.forms.append((form, i, tail))
            if len(form) >= 4:
                auto.add_word(form, (len(form), i))
        if len(auto):
            auto.make_automaton()
        self.auto = auto
        grams: dict[str, list[int]] = defaultdict(list)
        for k, (form, _, _) in enumerate(self.forms):
            for g in _pairs(form):
                grams[g].append(k)
        self.grams = {g: np.array(v, np.int32) for g, v in grams.items()}
        self.size = np.array([len(_pairs(f)) for f, _, _ in self.forms], np.int64)
        self.chars = np.array([len(f) for f, _, _ in self.forms], np.int64)
        self.most = np.array([int(limit * tail) for _, _, tail in self.forms], np.int64)
        # forms so short that an allowed number of edits may leave no pair of them
        self.loose = np.flatnonzero(self.size <= EDIT_PAIRS * self.most)

    @staticmethod
    def _readings(parts, readings) -> dict[tuple[int, str], set[str]]:
        """Readings of the parts: what the readings of all labels with a part have in common."""
        by_b, by_e = defaultdict(list), defaultdict(list)
        for (b, _, e), r in zip(parts, readings):
            if r:
                by_b[b].append(r)
                by_e[e].append(r)
        out: dict[tuple[int, str], set[str]] = defaultdict(set)
        begin = {b: _common(rs) for b, rs in by_b.items() if b and len(rs) > 1}
        end = {e: _common(rs, True) for e, rs in by_e.items() if e and len(rs) > 1}
        middle: dict[str, Counter] = defaultdict(Counter)
        for (b, m, e), r in zip(parts, readings):
            x, y = begin.get(b, ""), end.get(e, "")
            if r and x and y and len(x) + len(y) < len(r):
                middle[m][r[len(x) : len(r) - len(y)]] += 1
        for b, x in begin.items():
            out[(0, b)].add(x)
        for e, y in end.items():
            out[(2, e)].add(y)
        for m, c in middle.items():
            out[(1, m)].add(c.most_common(1)[0][0])
        return out

    def _mentions(self, text: str) -> list[tuple[int, int, int]]:
        """Longest non-overlapping embedded forms: start, end, entry."""
        if not len(self.auto):
            return []
        hits = sorted(((n, stop + 1 - n, i) for stop, (n, i) in self.auto.iter(text)), key=lambda h: (-h[0], h[1], h[2]))
        taken: list[tuple[int, int, int]] = []
        for n, start, i in hits:
            if all(start + n <= s or start >= e for s, e, _ in taken):
                taken.append((start, start + n, i))
        return taken

    def find(self, value: str) -> str:
        """Id of the entry meant, or UNMATCHED."""
        for text in dict.fromkeys((key_form(value), key_form(bare(value)))):
            if (i := self.exact.get(text)) is not None:
                return self.ids[i]
        whole, text = key_form(value), key_form(bare(value))
        found = {i for _, _, i in self._mentions(whole)}
        if len(found) == 1:
            return self.ids[found.pop()]
        best = min((x for x in (self._nearest(text), self._nearest(whole) if whole != text else None) if x), default=None)
        return self.ids[best[3]] if best else UNMATCHED

    def _nearest(self, text: str) -> tuple[float, int, int, int] | None:
        """(edits by distinguishing characters, edits, -common pairs, entry) of the closest form, exactly."""
        if len(text) < 2 or not self.forms:
            return None
        pairs = _pairs(text)
        rows = [self.grams[g] for g in pairs if g in self.grams]
        ids, both = np.unique(np.concatenate([*rows, self.loose.astype(np.int32)]), return_counts=True)
        both = both - np.isin(ids, self.loose, assume_unique=True)
        most = self.most[ids]
        able = (np.abs(self.chars[ids] - len(text)) <= most) & (np.maximum(self.size[ids], len(pairs)) - both <= EDIT_PAIRS * most)
        ids, both = ids[able], both[able]
        order = np.argsort(-both, kind="stable")
        ids, both = ids[order], both[order]
        best = None
        lo, step = 0, 16
        while lo < len(ids):
            if best is not None and len(pairs) - both[lo] > EDIT_PAIRS * best[1]:
                break  # fewer common pairs from here on: none can be as close
            part = ids[lo : lo + step]
            d = edits_all(text, [self.forms[k][0] for k in part])
            for x in np.flatnonzero(d <= self.most[part]):
                _, i, tail = self.forms[part[x]]
                cand = (d[x] / tail, int(d[x]), -int(both[lo + x]), i)
                if best is None or cand[1:] < best[1:]:
                    best = cand
            lo, step = lo + step, min(step * 4, 1024)
        return best


EDIT_PAIRS = 3  # pairs of adjacent characters that one edit (a swap) can remove


def _pairs(text: str) -> set[str]:
    return {text[j : j + 2] for j in range(len(text) - 1)}


def edits_all(a: str, others: list[str]) -> np.ndarray:
    """Edit distances (with swaps of neighbours) of one text to many, all at once."""
    width, n = max(map(len, others), default=0), len(others)
    codes = np.frombuffer("".join([o.ljust(width, "\0") for o in others]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
    step = np.arange(width + 1, dtype=np.int16)
    last = before = np.broadcast_to(step, (n, width + 1))
    hit_before = None
    for i, x in enumerate(map(ord, a), 1):
        hit = codes == x
        row = np.empty((n, width + 1), np.int16)
        row[:, 0] = i
        np.minimum(before[:, 1:] + 1, before[:, :-1] + ~hit, out=row[:, 1:])
        if hit_before is not None and width > 1:
            np.minimum(row[:, 2:], np.where(hit[:, :-1] & hit_before[:, 1:], last[:, :-2] + 1, row[:, 2:]), out=row[:, 2:])
        row -= step  # insertions: the running minimum along the text
        np.minimum.accumulate(row, axis=1, out=row)
        row += step
        last, before, hit_before = before, row, hit
    return before[np.arange(n), [len(o) for o in others]].astype(np.int64)


def map_values(df: DataFrame, keys: list[str], text: str, refs: DataFrame, ref_id: str, label: str, reading: str | None = None, out: str = "ref_id", limit: float = 0.55) -> DataFrame:
    """``keys`` and the id meant, for each row whose value is neither null, blank nor an exact label.

    The reference list is bounded: more than ``MAX_ENTRIES`` entries are refused, as they are sent
    to every executor.  Each distinct value is matched once.  Ties go to the form that shares more
    character pairs, then to the smaller id; an alias that several entries share names none of them.  An empty list leaves every value unmatched.
    """
    cols = [F.col(ref_id).cast("string"), F.col(label), F.col(reading) if reading else F.lit(None).cast("string")]
    entries = [tuple(r) for r in refs.select(*cols).limit(MAX_ENTRIES + 1).collect()]
    if len(entries) > MAX_ENTRIES:
        raise ValueError("the reference list is too long to be sent to every executor")
    table = df.sparkSession.sparkContext.broadcast(entries)
    exact = refs.select(F.col(label).alias("v")).distinct()
    rows = df.select(*keys, F.col(text).alias("v")).where(F.col("v").rlike(r"(?U)\S")).join(F.broadcast(exact), "v", "left_anti")

    def run(batches):
        matcher = None
        for batch in batches:
            matcher = matcher or _matcher(tuple(table.value), limit)
            found = [matcher.find(v) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["v", "found"])

    schema = T.StructType([T.StructField("v", T.StringType()), T.StructField("found", T.StringType())])
    # matching is dear per value and the values are short, so partitions go by count, not by bytes
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.select("v").distinct().repartition(parts)
    mapped = values.mapInArrow(run, schema)
    return rows.join(mapped, "v").select(*keys, F.col("found").alias(out))


_known: dict[tuple, Matcher] = {}


def _matcher(entries: tuple, limit: float) -> Matcher:
    key = (hash(entries), limit)
    if key not in _known:
        _known.clear()
        _known[key] = Matcher(list(entries), limit)
    return _known[key]
