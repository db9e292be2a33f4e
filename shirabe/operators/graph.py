"""Ontology graphs: edges, and everything above or below a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.session import materialize


def edges(df: DataFrame, child: str, parents: Column) -> DataFrame:
    """``child``, ``parent`` rows from an array of parents; blanks and repeats are dropped."""
    return df.select(F.col(child).alias("child"), F.explode(parents).alias("parent")).where((F.trim("parent") != "") & (F.trim("child") != "")).distinct()


def closure(edge: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node``, ``ancestor``: all pairs along one edge or more; safe on cycles.

    Each round joins only the pairs found last with all pairs known and keeps the new ones, so the
    path length covered doubles per round.  A round is written to the shared folder: plans stay
    short and lost executors cost one round.  A term is its own ancestor only on a cycle.  Descendants are the same pairs read the other way.
    """
    frontier = materialize(edge.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct(), "closure")
    every = frontier
    for _ in range(max_rounds):
        rest = every.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"))
        found = frontier.join(rest, "ancestor").select("node", F.col("far").alias("ancestor")).distinct()
        frontier = materialize(found.join(every, ["node", "ancestor"], "left_anti"), "closure")
        if frontier.isEmpty():
            return every
        every = every.unionByName(frontier)
    raise RuntimeError("the closure did not settle")
