"""Queries of problems 4 and 5: cut texts, and one form for look-alike text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm.truncation import find_cut
from shirabe.llm.unify import unify


def _cut_input(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.read.parquet(f"{sf}/expr_records.parquet").select(F.lit("expr").alias("fld"), "seq", "source", F.col("expr").alias("t"))
    b = spark.read.parquet(f"{sf}/hpo_master.parquet").select(F.lit("definition_ja").alias("fld"), "seq", "source", F.col("definition_ja").alias("t"))
    return a.unionByName(b)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose text lost its end."""
    return find_cut(_cut_input(spark, sf), ["fld", "seq"], "t", "source").select("fld", "seq")


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per field and source: rows with a text, cut rows, and their share in millionths."""
    rows = _cut_input(spark, sf).where(F.col("t").rlike(r"(?U)\S"))
    cut = find_cut(rows, ["fld", "seq", "source"], "t", "source").groupBy("fld", "source").agg(F.count("*").alias("n_cut"))
    total = rows.groupBy("fld", "source").agg(F.count("*").alias("n_rows"))
    n = F.coalesce("n_cut", F.lit(0))
    joined = total.join(cut, (total.fld == cut.fld) & total.source.eqNullSafe(cut.source), "left").select(total.fld, total.source, "n_rows", n.alias("n_cut"))
    return joined.withColumn("millionths", F.floor(F.col("n_cut") * 1_000_000 / F.col("n_rows")).cast("bigint"))


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/expr_records.parquet").select("seq", F.explode(F.create_map(F.lit("expr"), F.col("expr"), F.lit("hpo_label"), F.col("hpo_label"))).alias("fld", "t"))
    s = spark.read.parquet(f"{sf}/sft_rows.parquet").select("seq", F.lit("standard_name").alias("fld"), F.col("standard_name").alias("t"))
    return e.unionByName(s)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose value is not in the consistent form."""
    return unify(_forms(spark, sf).where(F.length("t") > 0), ["fld", "seq"], "t").where("changed").select("fld", "seq")


def p5_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every value in its consistent form."""
    return unify(_forms(spark, sf), ["fld", "seq"], "t").select("fld", "seq", "clean", F.col("changed").cast("bigint").alias("changed"))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_forms": p5_forms}
ORACLE: dict[str, str] = {}
