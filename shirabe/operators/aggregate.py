"""Ordered collections, counters, profiles and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from shirabe.session import materialize


def ordered_distinct(df: DataFrame, key: str, value: str, seq: str = "seq", out: str = "values") -> DataFrame:
    """Per key the distinct values in order of first arrival; null values are left out."""
    first = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(seq).alias("_s"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", F.col(value).alias("_v")))), lambda x: x["_v"]).alias(out))


def collect_records(df: DataFrame, key: str, columns: list[str], seq: str = "seq", out: str = "records") -> DataFrame:
    """Per key its records, in order of ``seq``."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq), *columns))).alias(out))


def counts_by(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(out))


def good_groups(df: DataFrame, key: str, good: Column, target: int) -> DataFrame:
    """Per key the good rows and whether they are enough."""
    return df.groupBy(key).agg(F.count_if(good).alias("n_good"), (F.count_if(good) >= target).alias("finished"))


def int_then_text(key: str) -> list[Column]:
    """Sort order: whole numbers by value first, then texts."""
    number = F.col(key).try_cast("bigint")
    return [number.isNull().asc(), number.asc(), F.col(key).asc()]


def length_profile(df: DataFrame, text: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and most of the text lengths; nulls count as length 0."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(n).alias("mean"), F.stddev(n).alias("std"), F.min(n).alias("least"), F.percentile(n, F.lit(0.25)).alias("q1"), F.percentile(n, F.lit(0.5)).alias("median"), F.percentile(n, F.lit(0.75)).alias("q3"), F.max(n).alias("most"))


def reduction_rate(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """How much shorter the texts became, in per cent of the characters; 0 for an empty table."""
    a, b = F.sum(F.length(before)), F.sum(F.length(after))
    return df.agg(F.when(a > 0, (1 - b / a) * 100).otherwise(0.0).alias("reduction"))


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one in ``order``, without a one-task sort.

    Rows are range-partitioned and written once; each partition starts from the sums before it.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "running")
    local = F.sum(value).over(Window.partitionBy("_pid").orderBy(*order))
    sums = parts.groupBy("_pid").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    return parts.withColumn(out, local).join(sums.select("_pid", before.alias("_before")), "_pid").withColumn(out, F.col(out) + F.col("_before")).drop("_pid", "_before")


def nearest_rank(df: DataFrame, value: Column, share: float = 0.95, out: str = "p") -> DataFrame:
    """The value at place int(n * share) of the sorted values, by counts per value, not by a list of all."""
    per = df.select(value.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("c"))
    run = running_total(per, ["v"], "c", "upto")
    total = run.agg(F.sum("c").alias("n"))
    return run.join(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("n") * share)).agg(F.min("v").alias(out))  # one row


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """``bin`` (from 0), ``lo``, ``hi``, ``n``: equal bins between the least and the greatest value."""
    rows = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    width = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / bins).otherwise(1.0)
    spot = F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1)).cast("int")
    placed = rows.join(F.broadcast(ends)).select(spot.alias("bin"), F.col("a"), width.alias("w"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.first(F.col("a") + F.col("bin") * F.col("w")).alias("lo"), F.first(F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("hi"))


def pivot_metrics(df: DataFrame, by: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One row per condition, one column per metric; a missing metric is null."""
    return df.groupBy(by).pivot(metric, metrics).agg(F.first(value, ignorenulls=True))


def unpivot_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric``, ``value`` rows in the given order from one wide row."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for i, m in enumerate(metrics)])).alias("x")).select("x.*").orderBy("i").drop("i")


def quality_of_lines(df: DataFrame, line: str, required: tuple[str, ...] = ("messages", "output")) -> DataFrame:
    """Per kind of JSON line (ok, bad_json, bad_type, missing_key, bad_messages): how many."""
    v = F.try_parse_json(F.col(line))
    kind = F.schema_of_variant(v)
    lacks = None
    for k in required:
        gone = F.try_variant_get(v, f"$.{k}", "variant").isNull()
        lacks = gone if lacks is None else lacks | gone
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.messages", "variant")).startswith("ARRAY"), F.lit(False))
    label = F.when(v.isNull(), "bad_json").when(~kind.startswith("OBJECT"), "bad_type").when(lacks, "missing_key").when(~listed, "bad_messages").otherwise("ok")
    return df.where(F.trim(line) != "").groupBy(label.alias("kind")).agg(F.count("*").alias("n"))


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """The table with counters that fill while it is computed, at no extra pass: rows, and one sum per counter."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(n) for n, c in counters.items())), watch


def round_stats(df: DataFrame, round_col: str, good: Column, scores: tuple[str, ...] = ("match", "simplicity", "overall")) -> DataFrame:
    """Per round: rows, good rows and the mean of each score."""
    return df.groupBy(round_col).agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"), *(F.avg(s).alias(f"mean_{s}") for s in scores))
