"""Filling containers of fixed capacity with items of varying length.

Only the histogram of lengths (at most ``capacity`` numbers) reaches the driver.  There the
configuration linear program - patterns of lengths that fit one container, as few containers as
possible - is solved by multiplicative weights: the weights price the lengths, a knapsack dynamic
program finds the best patterns for these prices, they are used for a small share of the demand,
and the prices of what they served fall.  The fractional counts are rounded down, the rest is
solved again until nothing is gained or the lower bound is met, and the last items are placed best
fit, largest first, whole length classes at a time.  The result is a table of patterns with
multiplicities; its size, and the work for it, depend on the capacity, not on the number of items.

Items find their place without a shuffle of the corpus: the n-th item of a length (numbered by
partition offsets and a rank inside the partition) goes to the n-th place for that length.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.session import materialize

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), lengths falling


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int, many: int = 8) -> list[dict[int, int]]:
    """The most valuable multisets of sizes within the capacity: the best one, then the best that begin with another size."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, values = sizes[order], values[order]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        m = upto[c]
        if m:
            gain = values[:m] + best[c - sizes[:m]]
            k = int(gain.argmax())
            if gain[k] > best[c - 1]:
                best[c], take[c] = gain[k], k
                continue
        best[c] = best[c - 1]

    def filled(c: int, out: dict[int, int]) -> dict[int, int]:
        while c > 0:
            if take[c] < 0:
                c -= 1
                continue
            size = int(sizes[take[c]])
            out[size] = out.get(size, 0) + 1
            c -= size
        return out

    whole = values + best[capacity - sizes]
    return [filled(capacity - int(sizes[k]), {int(sizes[k]): 1}) for k in np.argsort(-whole, kind="stable")[:many]]


def _fractional(demand: dict[int, int], capacity: int, rounds: int, rate: float) -> dict[Pattern, float]:
    """Pattern -> how often, by multiplicative weights; covers about the demand, never above it by plan."""
    sizes = np.array(sorted(demand), np.int64)
    need = np.array([demand[s] for s in sizes], float)
    index = {int(s): i for i, s in enumerate(sizes)}
    served = np.zeros(len(sizes))
    used: dict[Pattern, float] = {}
    total = float((sizes * need).sum()) / capacity
    step = max(total / rounds, 1e-9)
    for _ in range(rounds):
        share = served / need
        weight = np.exp(-rate * (share - share.min()))
        patterns = {tuple(sorted(p.items(), reverse=True)): p for p in _knapsack(sizes / capacity * weight, sizes, capacity)}
        for key, pattern in patterns.items():
            at, counts = [index[s] for s in pattern], np.array(list(pattern.values()), float)
            amount = min(step / len(patterns), float((need[at] / counts).min()))
            used[key] = used.get(key, 0.0) + amount
            served[at] += counts * amount
    return used


def _best_fit(demand: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Best fit, largest first, over what is left: equal containers are filled together.

    An item goes where it leaves least room, so a container that takes one item of a length takes as
    many of it as fit before the next one does; a class of equal containers is cut in at most three.
    """
    boxes: dict[tuple[int, Pattern], int] = {}  # (room, content) -> how many containers
    rooms: list[tuple[int, Pattern]] = []  # the same keys in order

    def add(room: int, content: Pattern, n: int) -> None:
        if n and (room, content) not in boxes:
            bisect.insort(rooms, (room, content))
        if n:
            boxes[room, content] = boxes.get((room, content), 0) + n

    for size in sorted(demand, reverse=True):
        left = demand[size]
        while left:
            at = bisect.bisect_left(rooms, (size, ()))
            old = at < len(rooms)
            room, content = rooms[at] if old else (capacity, ())
            fits = room // size
            n = min(left // fits, boxes[room, content]) if old else left // fits
            rest = left - n * fits if not old or n < boxes[room, content] else 0
            if old:
                boxes[room, content] -= n + (rest > 0)
                if not boxes[room, content]:
                    del boxes[room, content], rooms[at]
            add(room - fits * size, (*content, (size, fits)), n)
            if rest:
                add(room - rest * size, (*content, (size, rest)), 1)
            left -= n * fits + rest
    out: dict[Pattern, int] = {}
    for (_, content), n in boxes.items():
        key = tuple(sorted(content, reverse=True))
        out[key] = out.get(key, 0) + n
    return out


def plan_patterns(histogram: dict[int, int], capacity: int, rounds: int = 24, rate: float = 6.0, passes: int = 6) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that hold exactly the histogram's items."""
    rest = {int(s): int(n) for s, n in histogram.items() if n > 0}
    least = lower_bound(rest, capacity)
    plan: dict[Pattern, int] = {}
    for _ in range(passes):
        if sum(rest.values()) <= 4 * len(rest) or not rest:
            break  # too few of each length for a fractional solution to mean anything
        before = sum(rest.values())
        for pattern, often in sorted(_fractional(rest, capacity, rounds, rate).items(), key=lambda x: (-x[1], x[0])):
            times = min([math.floor(often + 1e-9), *(rest.get(s, 0) // a for s, a in pattern)])
            waste = capacity - sum(s * a for s, a in pattern)
            if times <= 0 or waste > capacity // 64:
                continue
            plan[pattern] = plan.get(pattern, 0) + times
            for s, a in pattern:
                rest[s] -= a * times
        rest = {s: n for s, n in rest.items() if n}
        last = _best_fit(rest, capacity)
        if sum(rest.values()) > 0.98 * before or sum(plan.values()) + sum(last.values()) <= least:
            break
    for pattern, times in _best_fit(rest, capacity).items():
        plan[pattern] = plan.get(pattern, 0) + times
    return sorted(plan.items(), reverse=True)


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing uses fewer containers than this."""
    return math.ceil(sum(s * n for s, n in histogram.items()) / capacity)


def pack(sizes: DataFrame, key: str, size: str, capacity: int, container: str = "container") -> DataFrame:
    """``container``, ``key``, ``piece``, ``size``: every unit of every item exactly once.

    An item above the capacity is cut into full pieces (each a container of its own) and a rest
    that is packed like any other item; no other item is cut.  Pieces count from 0.  Items of size
    null or 0 hold nothing and give no row.  Rows with one key are items of their own.  An empty
    table gives no rows.  Ties go by partition and row order, so container numbers may differ
    between runs while the packing stays valid.
    """
    rows = sizes.select(F.col(key).alias("k"), F.col(size).cast("bigint").alias("n")).where(F.col("n") > 0)
    cut = rows.select("k", F.explode(F.expr(f"transform(sequence(0, cast(ceil(n / {capacity}) as bigint) - 1), i -> named_struct('piece', i, 'len', least({capacity}L, n - i * {capacity}L)))")).alias("p")).select("k", "p.piece", "p.len")
    items = materialize(_numbered(cut), "pieces")
    per = items.groupBy("pid", "len").agg(F.count("*").alias("c"))
    before = per.withColumn("base", F.sum("c").over(Window.partitionBy("len").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
    before = materialize(before.select("pid", "len", F.coalesce("base", F.lit(0)).cast("bigint").alias("base"), "c"), "offsets")
    histogram = {int(r["len"]): int(r["c"]) for r in before.groupBy("len").agg(F.sum("c").alias("c")).collect()}
    full = histogram.pop(capacity, 0)
    places = _places(plan_patterns(histogram, capacity), full, capacity)
    # (partition, length) pairs: a join that Spark broadcasts only while they are few
    ranked = items.join(before, ["pid", "len"]).select("k", "piece", "len", (F.col("base") + F.col("r")).alias("rank"))
    return _assign(ranked, places).select(F.col("c").alias(container), F.col("k").alias(key), "piece", F.col("len").alias(size))


def _numbered(cut: DataFrame) -> DataFrame:
    """Adds the partition and the running number of each length inside it, as data."""

    def run(batches):
        nxt: dict[int, int] = {}
        for batch in batches:
            lens = batch.column(2).to_numpy()
            out = np.empty(len(lens), np.int64)
            order = np.argsort(lens, kind="stable")
            uniq, first = np.unique(lens[order], return_index=True)
            for ln, lo, hi in zip(uniq.tolist(), first, [*first[1:], len(lens)]):
                at = nxt.get(ln, 0)
                out[order[lo:hi]] = np.arange(at, at + hi - lo)
                nxt[ln] = at + int(hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["k", "piece", "len", "pid", "r"])

    rows = cut.select("k", "piece", "len", F.spark_partition_id().alias("pid"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("r", T.LongType())]))


def _places(plan: list[tuple[Pattern, int]], full: int, capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each pattern, its first container, items per container."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    box = 0
    if full:
        by[capacity] = [(0, 0, 1)]
        box = full
    for pattern, times in plan:
        for s, a in pattern:
            by.setdefault(s, []).append((seen.get(s, 0), box, a))
            seen[s] = seen.get(s, 0) + a * times
        box += times
    return {s: tuple(np.array(col, np.int64) for col in zip(*v)) for s, v in by.items()}


def _assign(ranked: DataFrame, places: dict) -> DataFrame:
    table = ranked.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        own = table.value
        for batch in batches:
            lens, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            out = np.empty(len(lens), np.int64)
            order = np.argsort(lens, kind="stable")
            uniq, first = np.unique(lens[order], return_index=True)
            for ln, lo, hi in zip(uniq.tolist(), first, [*first[1:], len(lens)]):
                begin, box, each = own[ln]
                at = order[lo:hi]
                k = np.searchsorted(begin, rank[at], side="right") - 1
                out[at] = box[k] + (rank[at] - begin[k]) // each[k]
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns[:3]], ["c", "k", "piece", "len"])

    schema = T.StructType([T.StructField("c", T.LongType()), *ranked.schema.fields[:3]])
    return ranked.mapInArrow(run, schema)
