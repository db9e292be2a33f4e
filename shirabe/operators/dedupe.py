"""First, last, best and capped rows per key; duplicates across groups; row numbers and shards.

One row per key is always taken by an aggregate (``max_by`` over the whole row), which combines
before the shuffle and holds one row per key, never by sorting whole groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.session import materialize


def _one(df: DataFrame, keys: list[str], order: list[Column], last: bool) -> DataFrame:
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    by = F.struct(*order)
    pick = F.max_by(whole, by) if last else F.min_by(whole, by)
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def last_wins(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row with the largest ``seq`` per key, as a dictionary built in order would keep."""
    return _one(df, keys, [F.col(seq)], True)


def first_wins(df: DataFrame, keys: list[str], seq: str = "seq", skip_blank: str | None = None) -> DataFrame:
    """The row with the smallest ``seq`` per key; rows whose ``skip_blank`` is null or blank do not count."""
    rows = df.where(F.col(skip_blank).rlike(r"(?U)\S")) if skip_blank else df
    return _one(rows, keys, [F.col(seq)], False)


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order`` (columns that sort ascending; negate a number to sort it down)."""
    return _one(df, keys, order, False)


def capped(df: DataFrame, key: str, n: int, seq: str = "seq", seed: int | None = None) -> DataFrame:
    """At most ``n`` rows per key: a seeded, repeatable choice (by the MD5 of seed and ``seq``), or the first by ``seq`` without a seed.

    Rows with a null key are dropped; ``n`` of 0 or less keeps all.  The limit is pushed below the
    shuffle by Spark's group limit, so a hot key sends at most ``n`` rows per partition.
    """
    rows = df.where(F.col(key).isNotNull())
    if n <= 0:
        return rows
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(seq).cast("string"))), F.col(seq)] if seed is not None else [F.col(seq)]
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def with_index(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Row number from 0 in ``order`` over the whole table, without a single-task sort.

    Rows are range-partitioned and written once; partition offsets come from the counts.
    """
    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()), "indexed")
    local = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    counts = parts.groupBy("_pid").agg(F.count("*").alias("_c"))
    start = counts.withColumn("_start", F.coalesce(F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_start")
    return local.join(start, "_pid").withColumn(name, (F.col("_start") + F.col("_n") - 1).cast("bigint")).drop("_pid", "_n", "_start")


def shard(df: DataFrame, order: list[str], n: int, k: int) -> DataFrame:
    """Every n-th row from the k-th; one shard or less is the whole table."""
    if n <= 1:
        return df
    return with_index(df, order, "_row").where(F.col("_row") % n == k).drop("_row")


POLICIES = ("drop_all", "keep_shallow", "keep_deep", "keep_best_score")


def cross_group_duplicates(df: DataFrame, group: str, text_key: str, policy: str = "drop_all", depth: str = "depth", score: str = "score", seq: str = "seq", reason: str = "reason") -> DataFrame:
    """All rows with ``reason``: null if kept, else why removed.

    A text that occurs in one group only is kept with all its rows.  In several groups all its rows
    go (``drop_all``) or all but one: the shallowest, the deepest or the best scored, ties by
    ``seq``; an unknown depth counts as very deep.  Two small aggregates per text joined back, so a
    frequent text never gathers in one task.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    deep = F.coalesce(F.col(depth), F.lit(1_000_000_000)) if policy in ("keep_shallow", "keep_deep") else F.lit(0)
    order = {"drop_all": F.col(seq).cast("double"), "keep_shallow": deep, "keep_deep": -deep, "keep_best_score": -F.coalesce(F.col(score), F.lit(0.0))}[policy]
    per = df.groupBy(F.col(text_key).alias("_t")).agg(F.min(group).alias("_lo"), F.max(group).alias("_hi"), F.max(F.col(group).isNull()).alias("_null"), F.min_by(F.col(seq), F.struct(order, F.col(seq))).alias("_win"))
    several = (F.col("_lo") != F.col("_hi")) | (F.col("_null") & F.col("_lo").isNotNull())
    dup = per.where(several).select("_t", "_win")
    name = "cross_hpo_duplicate" + ("" if policy == "drop_all" else f"_{policy}")
    gone = F.lit(True) if policy == "drop_all" else F.col(seq) != F.col("_win")
    joined = df.join(dup, F.col(text_key) == F.col("_t"), "left")
    return joined.withColumn(reason, F.when(F.col("_t").isNotNull() & gone, F.lit(name))).drop("_t", "_win")


def split_by_reason(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Kept and removed rows; together they are the input."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())
