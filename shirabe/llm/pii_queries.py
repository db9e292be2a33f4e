"""Queries of problem 3: personal items in histories and name fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shirabe.llm.pii import find_items, learn_names

_FIELDS = {"medical_history_nobr": "text", "patient_name": "name"}


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/eval_cases.parquet").select("case_no", "patient_name", "family_name", "medical_history_nobr")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each personal item, as written."""
    cases = _cases(spark, sf)
    learned = learn_names(cases, "patient_name", "family_name", "medical_history_nobr")
    return find_items(cases, ["case_no"], _FIELDS, learned)


def p3_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Each field with typed placeholders in place of the items."""
    cases = _cases(spark, sf)
    learned = learn_names(cases, "patient_name", "family_name", "medical_history_nobr")
    return find_items(cases, ["case_no"], _FIELDS, learned, placeholder=True)


QUERIES = {"p3_found": p3_found, "p3_masked": p3_masked}
ORACLE: dict[str, str] = {}
