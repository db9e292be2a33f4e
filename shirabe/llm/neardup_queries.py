"""Queries of problem 2: records that share most of their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm.neardup import near_groups, near_pairs
from shirabe.llm.spans import expand_pairs


def _expr(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/expr_records.parquet").select(F.col("seq").alias("key"), F.array("expr").alias("v"))


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/expression_master.parquet").select(F.col("master_row").alias("key"), F.col("patient_expressions").alias("v"))


_FIELDS = {"expr": _expr, "patient_expressions": _lists}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records whose sets of adjacent characters have a similarity of at least 0.8."""
    out = None
    for fld, rows in _FIELDS.items():
        links, classes = near_pairs(rows(spark, sf), "key", "v")
        found = expand_pairs(links, classes, "key_a", "key_b").select(F.lit(fld).alias("fld"), "key_a", "key_b")
        out = found if out is None else out.unionByName(found)
    return out


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Per record: the group it belongs to and how many other records are near it."""
    out = None
    for fld, rows in _FIELDS.items():
        found = near_groups(rows(spark, sf), "key", "v").select(F.lit(fld).alias("fld"), "key", "group_key", "n_links")
        out = found if out is None else out.unionByName(found)
    return out


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
_SOME = r"[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

ORACLE: dict[str, str] = {
    "p2_found": f"""
WITH t AS (SELECT 'expr' AS fld, seq AS k, [expr] AS v FROM expr_records UNION ALL SELECT 'patient_expressions', master_row, patient_expressions FROM expression_master),
r AS (SELECT * FROM t WHERE len(list_filter(v, lambda x: regexp_matches(x, '{_SOME}'))) > 0),
c AS (SELECT *, min(k) OVER (PARTITION BY fld, v) AS rep FROM r),
g AS (SELECT DISTINCT fld, k, substr(x, i, 2) AS b FROM (SELECT fld, k, unnest(v) AS x FROM c WHERE k = rep), unnest(range(1, length(x))) AS s(i)),
n AS (SELECT fld, k, count(*) AS n FROM g GROUP BY 1, 2),
o AS (SELECT g.fld, g.k, g.b, n.n, row_number() OVER (PARTITION BY g.fld, g.k ORDER BY f.f, g.b) AS place FROM g JOIN n ON g.fld = n.fld AND g.k = n.k JOIN (SELECT fld, b, count(*) AS f FROM g GROUP BY 1, 2) f ON f.fld = g.fld AND f.b = g.b),
q AS (SELECT * FROM o WHERE place <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
m AS (SELECT DISTINCT x.fld, x.k AS a, y.k AS b FROM q x JOIN q y ON x.fld = y.fld AND x.b = y.b AND x.k < y.k AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
p AS (SELECT m.fld, m.a, m.b, count(*) AS c FROM m JOIN g x ON x.fld = m.fld AND x.k = m.a JOIN g y ON y.fld = m.fld AND y.k = m.b AND y.b = x.b GROUP BY 1, 2, 3),
l AS (SELECT p.fld, p.a, p.b FROM p JOIN n x ON x.fld = p.fld AND x.k = p.a JOIN n y ON y.fld = p.fld AND y.k = p.b WHERE 5 * p.c >= 4 * (x.n + y.n - p.c)
  UNION ALL SELECT DISTINCT fld, rep, rep FROM c)
SELECT l.fld, least(x.k, y.k) AS key_a, greatest(x.k, y.k) AS key_b FROM l JOIN c x ON x.fld = l.fld AND x.rep = l.a JOIN c y ON y.fld = l.fld AND y.rep = l.b WHERE l.a < l.b OR x.k < y.k
""",
}
