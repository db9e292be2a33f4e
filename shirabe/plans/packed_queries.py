"""Queries on fields that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.operators.packed import infer_separators, split_packed


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row per id held in ``eval_cases.hpo_ids``, with its position."""
    cases = spark.read.parquet(f"{sf}/eval_cases.parquet").select("case_no", "hpo_ids")
    return split_packed(cases, "case_no", "hpo_ids").distinct()


def p1_separators(spark: SparkSession, sf: str) -> DataFrame:
    """The separator characters inferred for ``eval_cases.hpo_ids`` (code points)."""
    cases = spark.read.parquet(f"{sf}/eval_cases.parquet").select("hpo_ids")
    seps = infer_separators(cases, "hpo_ids")
    rows = [(ord(c),) for c in seps.get((), [])]
    return spark.createDataFrame(rows, "code_point bigint")


def p1_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Values of two sources with habits of their own, each split by its own separators."""
    cases = spark.read.parquet(f"{sf}/eval_cases.parquet").select(F.lit("cases").alias("src"), F.col("case_no").alias("key"), F.col("hpo_ids").alias("field"))
    parents = spark.read.parquet(f"{sf}/hpo_master.parquet").select(F.lit("parents").alias("src"), F.col("seq").alias("key"), F.col("parents").alias("field"))
    rows = cases.unionByName(parents).withColumn("at", F.struct("src", "key"))
    return split_packed(rows, "at", "field", ["src"]).select("at.src", "at.key", "item_pos", "item_text").distinct()


QUERIES = {"p1_found": p1_found, "p1_separators": p1_separators, "p1_sources": p1_sources}

_FOUND = r"""
WITH f AS (
  SELECT case_no, regexp_replace(hpo_ids, '^[\s　]+|[\s　]+$', '', 'g') AS t FROM eval_cases
  WHERE regexp_matches(hpo_ids, '[^\s　]')),
u AS (
  SELECT case_no, CASE WHEN regexp_full_match(t, '(?s)\[[^\[\]]*\][\s,;]*')
    THEN regexp_extract(t, '(?s)\[([^\[\]]*)\]', 1) ELSE t END AS t FROM f),
r AS (
  SELECT case_no, regexp_extract_all(t, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^\s　,;|/、，；｜・]+') AS xs FROM u),
e AS (
  SELECT case_no, unnest(range(1, len(xs) + 1)) AS i, unnest(xs) AS x FROM r),
c AS (
  SELECT case_no, i, CASE
    WHEN len(x) > 1 AND x[1] = '"' AND x[-1] = '"' THEN replace(x[2:-2], '""', '"')
    WHEN len(x) > 1 AND x[1] = '''' AND x[-1] = '''' THEN replace(x[2:-2], '''''', '''') ELSE x END AS x FROM e)
SELECT case_no, CAST(row_number() OVER (PARTITION BY case_no ORDER BY i) AS BIGINT) AS item_pos, trim(x) AS item_text
FROM c WHERE trim(x) <> ''
"""

ORACLE = {
    "p1_found": _FOUND,
    "p1_sources": f"""
SELECT 'cases' AS src, case_no AS key, item_pos, item_text FROM ({_FOUND})
UNION ALL SELECT 'parents', seq, CAST(i AS BIGINT), trim(xs[i]) FROM (SELECT seq, list_filter(string_split(parents, '|'), lambda x: trim(x) <> '') AS xs FROM hpo_master WHERE parents IS NOT NULL), unnest(range(1, len(xs) + 1)) AS t(i)
""",
    "p1_separators": r"""
SELECT DISTINCT CAST(unicode(c) AS BIGINT) AS code_point FROM (
  SELECT unnest(string_split(regexp_replace(regexp_replace(regexp_replace(
    hpo_ids, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''', '', 'g'), '^[\s　]+|[\s　]+$', '', 'g'), '[A-Za-z0-9:_\[\]]', '', 'g'), '')) AS c
  FROM eval_cases WHERE hpo_ids IS NOT NULL) WHERE c <> ''
""",
}
