"""Queries of problems 8 and 9: token ids, and containers of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm.bpe import count_column, encode_column
from shirabe.llm.packing import pack

CAPACITY = 2048


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_column(_documents(spark, sf), "doc_id", "text")


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of 2,048 tokens: container, doc_id, piece, n_tokens."""
    return pack(count_column(_documents(spark, sf), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are: their number, the tokens, and the fewest containers possible."""
    used = p9_containers(spark, sf).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / CAPACITY).cast("bigint").alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("fullest"))


QUERIES = {"p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill}
ORACLE: dict[str, str] = {}
