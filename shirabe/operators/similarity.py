"""Closeness of short texts, and diverse selections."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.functions.text import let
from shirabe.session import materialize

# Signs that do not count at the edges of a span.
EDGE_SIGNS = " \t\r\n、。.,()（）[]【】「」『』:：;；"


def edge_free(col: Column) -> Column:
    """Plain spaces taken out, then signs and spaces off both ends; null gives ''."""
    cls = "".join(f"\\x{{{ord(c):x}}}" for c in EDGE_SIGNS)
    return F.regexp_replace(F.replace(F.coalesce(col, F.lit("")), F.lit(" "), F.lit("")), f"^[{cls}]+|[{cls}]+$", "")


def bigrams(col: Column) -> Column:
    """Distinct pairs of adjacent characters; fewer than two characters give none."""
    return F.when(F.length(col) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(col) - 1), lambda i: F.substring(col, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def _pair_share(x: Column, y: Column) -> Column:
    """Share of common pairs of two texts without edges."""

    def sets(p: Column, q: Column) -> Column:
        return let(F.size(F.array_intersect(p, q)), lambda n: F.when((F.size(p) == 0) | (F.size(q) == 0), 0.0).otherwise(n / (F.size(p) + F.size(q) - n)))

    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(let(bigrams(x), lambda p: let(bigrams(y), lambda q: sets(p, q))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """1 for equal texts, else the share of common pairs; 0 if either is empty or has no pair."""
    return let(edge_free(a), lambda x: let(edge_free(b), lambda y: _pair_share(x, y)))


def lexical_similarity(a: Column, b: Column) -> Column:
    """Pair overlap, or the ratio of lengths if one text holds the other and that is more."""

    def judged(x: Column, y: Column) -> Column:
        inside = F.contains(x, y) | F.contains(y, x)
        ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
        return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(inside, F.greatest(_pair_share(x, y), ratio)).otherwise(_pair_share(x, y))

    return let(edge_free(a), lambda x: let(edge_free(b), lambda y: judged(x, y)))


def short_penalty(span: Column, entry: Column) -> Column:
    """How much shorter the entry is than the span, as a share of the span; 0 if it is not."""
    s, e = F.length(edge_free(span)), F.length(edge_free(entry))
    return F.when((s > 0) & (e < s), (s - e) / s).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def matcher_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio; the order of the arguments matters, null gives null."""
    return _ratio(a, b)


HOT = 100_000  # texts of one key from which on they are not sent to one task


def _hot_picks(rows: DataFrame, k: int, threshold: float, n_order: int) -> DataFrame:
    """``g``, ``x``, ``p`` for keys with very many texts, one place per pass over them."""
    place = F.struct(*[f"r{i}" for i in range(n_order)], "s")
    rows = materialize(rows.select("g", "x", place.alias("at")), "hot-texts")
    taken = rows.select("g", F.array().cast("array<struct<x:string,diverse:boolean>>").alias("taken")).distinct()
    for diverse in (True, False):
        for _ in range(k):
            names = F.transform("taken", lambda t: t["x"])
            able = rows.join(taken.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).where((F.size("taken") < k) & ~F.array_contains(names, F.col("x")))
            if diverse:
                able = able.where(_differs(F.col("x"), names, F.lit(threshold)))
            first = able.groupBy("g").agg(F.min_by("x", "at").alias("x")).select(F.col("g").alias("_g"), "x")
            joined = taken.join(first, F.col("g").eqNullSafe(F.col("_g")), "left")
            grown = materialize(joined.select("g", F.when(F.col("x").isNotNull(), F.concat("taken", F.array(F.struct("x", F.lit(diverse).alias("diverse"))))).otherwise(F.col("taken")).alias("taken"), F.col("x").isNotNull().alias("more")), "hot-picks")
            more = not grown.where("more").isEmpty()
            taken = grown.select("g", "taken")
            if not more:
                break
    return taken.select("g", F.posexplode("taken").alias("p", "t")).select("g", F.col("t.x").alias("x"), (F.col("p") + 1).cast("int").alias("p"))


@F.pandas_udf(T.BooleanType())
def _differs(x: pd.Series, taken: pd.Series, threshold: pd.Series) -> pd.Series:
    return pd.Series([all(SequenceMatcher(None, a, t).ratio() < h for t in ts) for a, ts, h in zip(x, taken, threshold)], dtype="bool")


def diverse_top_k(df: DataFrame, key: str, text: str, k: int, threshold: float = 0.7, order: list[Column] | None = None, seq: str = "seq", dedupe: bool = True, out: str = "pick") -> DataFrame:
    """``key``, ``text``, ``pick`` (from 1): up to k texts per key that differ enough.

    Texts are trimmed, blanks dropped, exact repeats too if ``dedupe``.  A key with at most k texts
    keeps them in input order.  Otherwise texts come in ``order`` (length, then text, if not given),
    one is taken if its ratio to every text taken is below the threshold, and free places are
    filled from the front, no text twice.  Rows stream in order through each partition: a task
    holds k picks per key and never a whole group.  A key of more than ``HOT`` texts is not sent to
    one task: there each of the k places is settled for all such keys at once, by the first text in
    order that differs from those taken (an aggregate that combines before the shuffle).
    """
    rows = df.select(F.col(key).alias("g"), F.trim(text).alias("x"), F.col(seq).alias("s"), *[o.alias(f"o{i}") for i, o in enumerate(order or [])]).where(F.col("x") != "")
    if dedupe:
        whole = F.struct("g", "x", "s", *[f"o{i}" for i in range(len(order or []))])
        rows = rows.groupBy("g", "x").agg(F.min_by(whole, "s").alias("w")).select("w.*")
    count = rows.groupBy("g").agg(F.count("*").alias("n"))
    rows = rows.join(count, "g")
    own = [F.col(f"o{i}") for i in range(len(order))] if order else [F.length("x"), F.col("x")]
    few = F.when(F.col("n") <= k, F.col("s"))
    sent = rows.select("g", "x", "n", few.alias("f"), "s", *[o.alias(f"r{i}") for i, o in enumerate(own)])
    hot = sent.where((F.col("n") > HOT) & (F.col("n") > k))
    picked = _hot_picks(hot, k, threshold, len(own)) if count.where(F.col("n") > HOT).limit(1).count() else None
    sent = sent.where((F.col("n") <= HOT) | (F.col("n") <= k)).repartition("g").sortWithinPartitions("g", "f", *[f"r{i}" for i in range(len(own))], "s")

    def run(batches):
        group, taken, spare, n = object(), [], [], 0

        def flush():
            for x in spare:
                if len(taken) >= k:
                    break
                if x not in taken:
                    taken.append(x)
            return [(group, x, i + 1) for i, x in enumerate(taken)]

        for pdf in batches:
            out_rows: list[tuple] = []
            for g, x, size in zip(pdf["g"], pdf["x"], pdf["n"]):
                if g != group:
                    if taken or spare:
                        out_rows += flush()
                    group, taken, spare, n = g, [], [], size
                if size <= k:
                    taken.append(x)
                    continue
                if len(spare) < 2 * k:
                    spare.append(x)
                if len(taken) < k and all(SequenceMatcher(None, x, t).ratio() < threshold for t in taken):
                    taken.append(x)
            yield pd.DataFrame(out_rows, columns=["g", "x", "p"])
        if taken or spare:
            yield pd.DataFrame(flush(), columns=["g", "x", "p"])

    schema = T.StructType([T.StructField("g", df.schema[key].dataType), T.StructField("x", T.StringType()), T.StructField("p", T.IntegerType())])
    few = sent.select("g", "x", "n").mapInPandas(run, schema)
    return (few if picked is None else few.unionByName(picked)).select(F.col("g").alias(key), F.col("x").alias(text), F.col("p").alias(out))
