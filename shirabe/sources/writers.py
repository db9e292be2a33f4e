"""Writers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions.text import int_key


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite", bom: bool = False) -> None:
    """CSV with a header; with ``bom`` the first header starts with a byte order mark."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    plain = {"emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # values as they are
    out.write.mode(mode).options(**plain).csv(path, header=True, sep=sep, quoteAll=False, escape='"')


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = True) -> None:
    """One object per line, characters as they are, null keys kept."""
    df.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_master(df: DataFrame, path: str, key: str, lists: tuple[str, ...] = ("patient_expressions", "doctor_expressions")) -> None:
    """Rows with at least one expression, sorted by key across the files."""
    size = sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(0))
    write_jsonl(df.where(size > 0).orderBy(key), path)


def write_removed(df: DataFrame, path: str, reason: str = "reason") -> bool:
    """The removed rows with their reasons; nothing is written if there are none."""
    gone = df.where(F.col(reason).isNotNull())
    if gone.isEmpty():
        return False
    write_jsonl(gone, path)
    return True


def write_index_map(df: DataFrame, path: str, index: str = "row_idx", text: str = "text") -> None:
    """TSV of index and text; tabs and line ends in the text become spaces."""
    write_csv(df.select(F.col(index).alias("index"), F.translate(text, "\t\n\r", "   ").alias("text")), path, sep="\t")


def write_npy(df: DataFrame, path: str, order: str = "row_idx", vec: str = "embedding") -> int:
    """A float32 matrix file from rows in order, streamed partition by partition; for export only.

    Returns the number of rows.  The shape is counted first, so rows go straight into the file.
    """
    import numpy as np

    n = df.count()
    width = df.select(F.size(vec)).first()
    out = np.lib.format.open_memmap(path, mode="w+", dtype=np.float32, shape=(n, width[0] if width else 0))
    for i, row in enumerate(df.orderBy(order).select(vec).toLocalIterator()):
        out[i] = row[0]
    out.flush()
    return n


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSONL log."""
    write_jsonl(df, path, "append")


def write_by_round(df: DataFrame, path: str, value: Column) -> None:
    """One folder per whole-number key of ``value``; anything else under "unknown"."""
    df.withColumn("round_key", int_key(value)).write.mode("overwrite").partitionBy("round_key").json(path)


def read_shards(spark: SparkSession, paths: list[str], fmt: str = "json") -> DataFrame:
    """All shards as one table; a missing shard is an error."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        target = jvm.org.apache.hadoop.fs.Path(p)
        if not target.getFileSystem(conf).exists(target):
            raise FileNotFoundError(os.fspath(p))
    return spark.read.format(fmt).load(paths)
