"""Dense vectors: pooling, inner products, exact nearest neighbours, own against best other.

One side of a product is held in blocks of at most ``BLOCK`` rows, each sent to the executors by
itself; the other side streams through in Arrow batches.  Neither side is ever held whole, so
nothing that grows with the data is broadcast, and results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shirabe.session import materialize

BLOCK = 20_000
CELLS = 2_000_000  # scores of one step, 16 MB


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length 1; the zero vector stays as it is."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors that the mask keeps (array of arrays, array of 0/1)."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m > 0, t)), lambda t: t.isNotNull())
    width = F.size(F.element_at(tokens, 1))
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), width), lambda s, t: F.zip_with(s, t, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _blocks(df: DataFrame, size: int) -> Iterator[list]:
    block: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _written_once(moving: DataFrame, kept: DataFrame, block: int) -> DataFrame:
    """``moving``, written down if several blocks will stream it, so that it is computed once."""
    return materialize(moving, "vectors") if kept.limit(block + 1).count() > block else moving


def _top(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest scores per row; all that tie with the k-th stay, to be settled by key."""
    top = min(k, score.shape[1])
    edge = np.partition(score, score.shape[1] - top, axis=1)[:, score.shape[1] - top]
    return np.nonzero(score >= edge[:, None])


def knn(queries: DataFrame, base: DataFrame, k: int, qid: str = "qid", bid: str = "bid", vec: str = "vec", block: int = BLOCK, hold: str = "queries") -> DataFrame:
    """``qid``, ``bid``, ``score``, ``rank``: the k rows of ``base`` with the largest inner product per query.

    Ties go to the smaller ``bid``; rows with a null vector take no part.  The side named by ``hold``
    is sent out block by block while the other streams: hold the smaller one.  Per block, each
    query sends at most k rows (and ties) on from a batch.
    """
    if hold not in ("queries", "base"):
        raise ValueError(f"cannot hold {hold}")
    spark = base.sparkSession
    q = queries.where(F.col(vec).isNotNull()).select(F.col(qid).alias("i"), F.col(vec).alias("v"))
    b = base.where(F.col(vec).isNotNull()).select(F.col(bid).alias("i"), F.col(vec).alias("v"))
    kept, moving = (q, b) if hold == "queries" else (b, q)
    moving = _written_once(moving, kept, block)
    qt, bt = queries.schema[qid].dataType, base.schema[bid].dataType
    kind = to_arrow_type(qt if hold == "queries" else bt)
    schema = T.StructType([T.StructField("q", qt), T.StructField("b", bt), T.StructField("s", T.DoubleType())])
    out = None
    for part in _blocks(kept, block):
        held = spark.sparkContext.broadcast(([r[0] for r in part], np.array([r[1] for r in part], np.float64)))

        def run(batches, held=held):
            names, m = held.value
            for batch in batches:
                rows = _matrix(batch.column(1)) if batch.num_rows else None
                if rows is None:
                    continue
                step = 2048
                for lo in range(0, len(names) if hold == "queries" else batch.num_rows, step):
                    if hold == "queries":
                        score = m[lo : lo + step] @ rows.T
                        r, c = _top(score, k)
                        cols = [pa.array([names[lo + x] for x in r], kind), batch.column(0).take(pa.array(c))]
                    else:
                        score = rows[lo : lo + step] @ m.T
                        r, c = _top(score, k)
                        cols = [batch.column(0).take(pa.array(r + lo)), pa.array([names[x] for x in c], kind)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(score[r, c])], ["q", "b", "s"])

        got = moving.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "b"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(qid), F.col("b").alias(bid), F.col("s").alias("score"), "rank")


def own_and_other(records: DataFrame, labels: DataFrame, rid: str, group: str, vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """``rid``, ``own``, ``other``, ``best_other``: similarity to the own label and to the closest other.

    ``labels`` has one vector per group.  Groups of the very same vector share one held row, with
    their two smallest names, as no record needs a third; the rows are held block by block, and a
    batch is compared in steps of at most ``CELLS`` scores.  ``own`` is null for a group without a
    label; ties among others go to the smaller group.
    """
    spark = records.sparkSession
    gt, rt = labels.schema[group].dataType, records.schema[rid].dataType
    ga = to_arrow_type(gt)
    schema = T.StructType([T.StructField("r", rt), T.StructField("own", T.DoubleType()), T.StructField("other", T.DoubleType()), T.StructField("g", gt)])
    known = materialize(labels.where(F.col(vec).isNotNull()).select(F.col(group).alias("g"), F.col(vec).alias("v")), "labels")
    least = known.groupBy("v").agg(F.min("g").alias("first"))
    names = known.join(least, "v").select("g", "first")
    second = names.where(F.col("g") > F.col("first")).groupBy("first").agg(F.min("g").alias("second"))
    held_side = materialize(least.join(second, "first", "left").select("first", "second", "v"), "label-vectors")
    rows = records.where(F.col(vec).isNotNull()).select(F.col(rid).alias("r"), F.col(group).alias("g"), F.col(vec).alias("v")).join(names, "g", "left").select("r", "g", "first", "v")
    rows = _written_once(rows, held_side, block)
    out = None
    for part in _blocks(held_side.orderBy("first"), block):
        held = spark.sparkContext.broadcast(([r[0] for r in part], [r[1] for r in part], np.array([r[2] for r in part], np.float64)))

        def run(batches, held=held):
            first, second, m = held.value
            place = {g: i for i, g in enumerate(first)}
            step = max(1, CELLS // len(first))
            for whole in batches:
                for lo in range(0, whole.num_rows, step):
                    batch = whole.slice(lo, step)
                    score = _matrix(batch.column(3)) @ m.T
                    group_of = batch.column(1).to_pylist()
                    at = np.array([place.get(g, -1) for g in batch.column(2).to_pylist()])
                    has = np.flatnonzero(at >= 0)
                    own: list = [None] * batch.num_rows
                    for i in has:
                        own[i] = float(score[i, at[i]])
                    score[has, at[has]] = -np.inf
                    best = score.argmax(axis=1)
                    value = score[np.arange(len(best)), best]
                    other = [(float(x), first[b]) if np.isfinite(x) else (None, None) for x, b in zip(value, best)]
                    for i in has:  # another group may have the own vector
                        g = first[at[i]] if first[at[i]] != group_of[i] else second[at[i]]
                        if g is not None and (other[i][0] is None or own[i] > other[i][0] or (own[i] == other[i][0] and g < other[i][1])):
                            other[i] = (own[i], g)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64()), pa.array([x for x, _ in other], pa.float64()), pa.array([g for _, g in other], ga)], ["r", "own", "other", "g"])

        got = rows.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], schema)
    order = F.when(F.col("other").isNotNull(), F.struct(-F.col("other"), F.col("g")))
    merged = out.groupBy("r").agg(F.max("own").alias("own"), F.max("other").alias("other"), F.min_by("g", order).alias("best_other"))
    return merged.withColumnRenamed("r", rid)


def similarity_reason(own: Column, other: Column, self_min: float, other_margin: float, ambiguous_gap: float) -> Column:
    """Why an expression goes, null if it stays; the first rule that holds decides.

    Without an own label it stays.  With both main thresholds at 0 the stage is off.
    """
    if self_min <= 0 and other_margin <= 0:
        return F.lit(None).cast("string")
    rule = F.when(own.isNull(), F.lit(None)).when(own < self_min, "low_self_sim").when(other - own > other_margin, "high_other_sim")
    if ambiguous_gap > 0:
        rule = rule.when(own - other < ambiguous_gap, "ambiguous_top1_top2")
    return rule


def rerank(hits: DataFrame, query: str, score: str, lexical: Column, short: Column, rank: str = "rank", least_lexical: float = 0.20, lexical_weight: float = 0.35, short_weight: float = 0.40, least_score: float = 0.70, entry_id: str | None = None) -> DataFrame:
    """The best hit per query by score + weight x lexical - weight x shortness, earlier rank on ties.

    Hits below ``least_lexical`` do not compete; the winner must then reach ``least_score`` by its
    raw score and have an id.
    """
    rows = hits.withColumn("_lex", lexical).withColumn("combined", F.col(score) + lexical_weight * F.col("_lex") - short_weight * short).where(F.col("_lex") >= least_lexical)
    whole = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(query).agg(F.max_by(whole, F.struct("combined", -F.col(rank))).alias("w")).select("w.*").drop("_lex")
    good = F.col(score) >= least_score
    return best.where(good & F.coalesce(F.col(entry_id) != "", F.lit(False)) if entry_id else good)


def _hashed(values: list[str], width: int) -> np.ndarray:
    """One row per text: its distinct characters and character pairs, each a sign at a hashed place."""
    sizes = np.array([len(v) for v in values], np.int64)
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(values)), sizes)
    pair = (owner[1:] == owner[:-1]).nonzero()[0]
    owner = np.concatenate([owner, owner[pair]])
    gram = np.concatenate([codes, (codes[pair] + np.uint64(1)) << np.uint64(21) | codes[pair + 1]])
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    owner, h = owner[first], gram[first]
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    out = np.zeros((len(values), width))
    np.add.at(out, (owner, (h % np.uint64(width)).astype(np.int64)), np.where(h >> np.uint64(63), 1.0, -1.0))
    n = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, n, out=out, where=n > 0)


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic stand-in for a model: hashed characters and character pairs, at length 1.

    One Arrow call per batch, over all its texts at once; null and empty texts give the zero vector.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(s: pd.Series) -> pd.Series:
        return pd.Series(list(_hashed([x or "" for x in s.where(s.notna(), None)], width)), dtype=object)

    return embed(text)
