"""Queries of problem 6: labels that are no labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm.residue import find_residue, without_residue


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/label_fill.parquet").select("seq", "hpo_id", "jp_final")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose label is, or holds, something that is no finished label."""
    return find_residue(_labels(spark, sf), "jp_final").select("seq")


def p6_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The labels that remain: rows with a label and without residue."""
    return without_residue(_labels(spark, sf).where(F.col("jp_final").rlike(r"(?U)\S")), "jp_final").select("seq", "hpo_id", "jp_final")


QUERIES = {"p6_found": p6_found, "p6_labels": p6_labels}
ORACLE: dict[str, str] = {}
