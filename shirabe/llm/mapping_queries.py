"""Queries of problem 7: typed labels and the entries they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm.mapping import UNMATCHED, map_values


def _values(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.read.parquet(f"{sf}/sft_rows.parquet").select(F.lit("standard_name").alias("fld"), "seq", F.col("standard_name").alias("t"))
    b = spark.read.parquet(f"{sf}/hpo_master.parquet").select(F.lit("jp_final").alias("fld"), "seq", F.col("jp_final").alias("t"))
    return a.unionByName(b)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The entry meant by each value that is not an exact label."""
    refs = spark.read.parquet(f"{sf}/label_ref.parquet")
    return map_values(_values(spark, sf), ["fld", "seq"], "t", refs, "ref_id", "ref_label", "ref_kana")


def p7_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that mean no entry, with how many rows hold them."""
    found = p7_found(spark, sf).where(F.col("ref_id") == UNMATCHED)
    return _values(spark, sf).join(found, ["fld", "seq"]).groupBy("fld", F.col("t").alias("value")).agg(F.count("*").alias("n_rows"))


QUERIES = {"p7_found": p7_found, "p7_unmatched": p7_unmatched}
ORACLE: dict[str, str] = {}
