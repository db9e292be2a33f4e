"""Queries of problem 10: passages that stand in more than one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm.spans import covered, expand_pairs, shared_intervals, shared_links, text_classes, without_repeats
from shirabe.session import materialize

MIN_CHARS = 200


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that share at least 200 consecutive characters."""
    docs = _documents(spark, sf)
    links = shared_links(docs, "doc_id", "text", MIN_CHARS)
    return expand_pairs(links, text_classes(docs, "doc_id", "text", MIN_CHARS), "doc_id_a", "doc_id_b")


def p10_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: characters, characters inside shared passages, characters left after removal of repeats."""
    docs = _documents(spark, sf)
    intervals = materialize(shared_intervals(docs, "doc_id", "text", MIN_CHARS), "intervals")
    return covered(intervals, text_classes(docs, "doc_id", "text", MIN_CHARS), docs, "doc_id", "text")


def p10_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the sentences that a document of a smaller id has already."""
    return without_repeats(_documents(spark, sf), "doc_id", "text", MIN_CHARS).select("doc_id", "kept")


def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Per document that shares a passage or is a copy: its class and the number of texts it is linked with."""
    docs = _documents(spark, sf)
    links = materialize(shared_links(docs, "doc_id", "text", MIN_CHARS), "span-links")
    classes = text_classes(docs, "doc_id", "text", MIN_CHARS)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
    own = classes.groupBy("rep").agg(F.count("*").alias("n"))
    rows = classes.join(own, "rep").join(both, "rep", "left").where((F.col("n") > 1) | F.col("n_links").isNotNull())
    return rows.select(F.col("k").alias("doc_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


QUERIES = {"p10_found": p10_found, "p10_coverage": p10_coverage, "p10_kept": p10_kept, "p10_classes": p10_classes}
_SHARED = f"""
WITH w AS (SELECT doc_id AS k, i, md5(substr(text, i, {MIN_CHARS})) AS h FROM documents, unnest(range(1, length(text) - {MIN_CHARS - 2})) AS r(i) WHERE length(text) >= {MIN_CHARS}),
s AS (SELECT h, min(k) AS lo FROM w GROUP BY h HAVING min(k) < max(k)),
e AS (SELECT w.k, w.i, w.h, s.lo FROM w JOIN s ON w.h = s.h)"""
_STEPS = f"sum(least({MIN_CHARS}, coalesce(nxt - i, {MIN_CHARS})))"

ORACLE: dict[str, str] = {
    "p10_found": _SHARED + " SELECT DISTINCT a.k AS doc_id_a, b.k AS doc_id_b FROM e a JOIN e b ON a.h = b.h AND a.k < b.k",
    "p10_coverage": _SHARED + f""",
a AS (SELECT k, CAST({_STEPS} AS BIGINT) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM e) GROUP BY 1),
b AS (SELECT k, CAST({_STEPS} AS BIGINT) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM e WHERE lo < k) GROUP BY 1)
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, coalesce(a.n, 0) AS shared_chars, CAST(coalesce(length(text), 0) AS BIGINT) - coalesce(b.n, 0) AS first_chars FROM documents d LEFT JOIN a ON a.k = d.doc_id LEFT JOIN b ON b.k = d.doc_id
""",
    "p10_classes": _SHARED + f""",
c AS (SELECT doc_id AS k, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE length(text) >= {MIN_CHARS}),
l AS (SELECT x.rep, count(DISTINCT y.rep) AS n_links FROM e a JOIN e b ON a.h = b.h JOIN c x ON x.k = a.k JOIN c y ON y.k = b.k WHERE x.rep <> y.rep GROUP BY 1)
SELECT c.k AS doc_id, c.rep AS class_id, coalesce(l.n_links, 0) AS n_links FROM c LEFT JOIN l ON l.rep = c.rep WHERE c.n > 1 OR l.n_links IS NOT NULL
""",
}
