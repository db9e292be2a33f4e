"""Scores of predicted against gold term sets: exact, hierarchical, recall at k, first hits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(pred: DataFrame, case: str, term: str, score: str, seq: str = "seq", statuses: tuple[str, str] | None = None) -> DataFrame:
    """``case``, ``term``, ``rank``: predictions by falling score, then order; repeats keep their places.

    ``statuses`` = (column, wanted) filters first; a missing status counts as the wanted one.
    Empty cases and terms are dropped, a missing score counts as 0.
    """
    rows = pred.where((F.coalesce(F.col(case).cast("string"), F.lit("")) != "") & (F.coalesce(F.col(term), F.lit("")) != ""))
    if statuses:
        rows = rows.where(F.coalesce(F.col(statuses[0]), F.lit(statuses[1])) == statuses[1])
    order = [F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(seq)]
    return rows.select(case, term, F.row_number().over(Window.partitionBy(case).orderBy(*order)).alias("rank"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = _share(tp, tp + fp), _share(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), _share(2 * p * r, p + r).alias("f1")]


def exact_scores(gold: DataFrame, pred: DataFrame, case: str, term: str) -> DataFrame:
    """One row: ``tp``, ``fp``, ``fn``, ``precision``, ``recall``, ``f1`` over the distinct terms of gold cases.

    Cases are those of ``gold`` (a case without gold terms has one row with a null term);
    predictions of other cases do not count.
    """
    cases = gold.select(case).distinct()
    g = gold.where(F.col(term).isNotNull()).select(case, term).distinct().withColumn("g", F.lit(1))
    p = pred.select(case, term).distinct().join(cases, case, "left_semi").withColumn("p", F.lit(1))
    both = g.join(p, [case, term], "full")
    counts = both.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return counts.select("tp", "fp", "fn", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


WIDE = 1_000  # predictions of a case from which on its pairs are made from the closure


def _related(g: DataFrame, p: DataFrame, closure: DataFrame, case: str) -> DataFrame:
    """``case``, ``g``, ``p``, ``rank``: pairs of a case of which one term is the other's ancestor.

    The pairs of a case are looked up in the closure: expanding a gold term to all its descendants
    would make as many rows as the ontology has terms.  Only cases of more than ``WIDE`` predictions are expanded.
    """
    size = p.groupBy(case).agg(F.count("*").alias("_n"))
    sized = g.join(size, case)
    up = closure.select(F.col("node").alias("x"), F.col("ancestor").alias("y"))
    both = sized.where(F.col("_n") <= WIDE).select(case, "g").join(p, case)
    ways = F.explode(F.array(F.struct(F.col("g").alias("x"), F.col("p").alias("y")), F.struct(F.col("p").alias("x"), F.col("g").alias("y")))).alias("w")
    few = both.select(case, "g", "p", "rank", ways).select(case, "g", "p", "rank", "w.x", "w.y").join(up, ["x", "y"], "left_semi")
    near = up.unionByName(up.select(F.col("y").alias("x"), F.col("x").alias("y")))
    wide = sized.where(F.col("_n") > WIDE).select(case, "g").join(near, F.col("g") == F.col("x")).select(case, "g", F.col("y").alias("p")).distinct()
    return few.select(case, "g", "p", "rank").unionByName(wide.join(p, [case, "p"]).select(case, "g", "p", "rank"))


def hierarchical_scores(gold: DataFrame, pred: DataFrame, closure: DataFrame, case: str, term: str) -> DataFrame:
    """As ``exact_scores``, where a prediction also meets its gold term's ancestors and descendants.

    Each gold term, in ascending order, takes the best ranked prediction that is not taken yet.
    Candidate pairs are looked up in the closure; for the matching they stream through their
    case's partition in order, and a task holds the taken predictions of one case.
    """
    cases = gold.select(case).distinct()
    g = gold.where(F.col(term).isNotNull()).select(case, F.col(term).alias("g")).distinct()
    p = pred.join(cases, case, "left_semi").groupBy(case, F.col(term).alias("p")).agg(F.min("rank").alias("rank"))
    same = g.join(p, (g[case] == p[case]) & (F.col("g") == F.col("p"))).select(g[case], "g", "p", "rank")
    pairs = same.unionByName(_related(g, p, closure, case)).distinct()

    def match(batches):
        current, done, taken = object(), None, set()
        for batch in batches:
            n = 0
            for c, g, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if c != current:
                    current, done, taken = c, None, set()
                if g != done and p not in taken:
                    taken.add(p)
                    done = g
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["tp"])

    tp = pairs.select(case, "g", "p", "rank").repartition(case).sortWithinPartitions(case, "g", "rank").mapInArrow(match, "tp bigint")
    n = [g.agg(F.count("*").alias("ng")), p.agg(F.count("*").alias("np")), tp.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))]
    total = n[0].crossJoin(n[1]).crossJoin(n[2]).select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))
    return total.select("tp", "fp", "fn", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def recall_at(gold: DataFrame, pred: DataFrame, case: str, term: str, ks: list[int]) -> DataFrame:
    """``k``, ``recall``: mean over cases with gold terms; cases without predictions count as 0."""
    g = gold.where(F.col(term).isNotNull()).select(case, term).distinct()
    hit = g.join(pred.groupBy(case, term).agg(F.min("rank").alias("rank")), [case, term], "left")
    per = hit.groupBy(case).agg(*[F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"r{k}") for k in ks])
    mean = per.agg(*[F.coalesce(F.avg(f"r{k}"), F.lit(0.0)).alias(f"r{k}") for k in ks])
    return mean.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks])).alias("x")).select("x.*")


def first_hits(gold: DataFrame, pred: DataFrame, case: str, term: str, closure: DataFrame | None = None) -> DataFrame:
    """One row: ``mean_rank`` of the first hit over the cases that hit, ``hits``, ``cases``; 0 if none hits.

    With a closure, ancestors and descendants of a gold term count as hits too.
    """
    g = gold.where(F.col(term).isNotNull()).select(case, F.col(term).alias("t")).distinct()
    wide = g
    if closure is not None:
        up = closure.select(F.col("node").alias("x"), F.col("ancestor").alias("y"))
        near = up.unionByName(closure.select(F.col("ancestor").alias("x"), F.col("node").alias("y"))).distinct()
        wide = g.unionByName(g.join(near, F.col("t") == F.col("x")).select(case, F.col("y").alias("t"))).distinct()
    best = pred.groupBy(case, F.col(term).alias("t")).agg(F.min("rank").alias("rank"))
    first = wide.join(best, [case, "t"]).groupBy(case).agg(F.min("rank").alias("rank"))
    return g.select(case).distinct().join(first, case, "left").agg(F.coalesce(F.avg("rank"), F.lit(0.0)).alias("mean_rank"), F.count("rank").alias("hits"), F.count("*").alias("cases"))
