"""Propose, judge and refine: batched model steps in bounded rounds over a state table.

Models are functions from table to table: a proposer adds ``text`` to rows (id, cand_no, attempt,
prompt), a judge adds match, simplicity, overall and too_technical to rows with ``text``, a refiner
replaces ``text``.  Each round's state is written to the shared folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.functions.judge import good_verdict
from shirabe.operators.similarity import diverse_top_k
from shirabe.session import materialize
from shirabe.sources.writers import append_log

Step = Callable[[DataFrame], DataFrame]
SCORES = ["match", "simplicity", "overall", "too_technical"]


def replicate(df: DataFrame, n: int, index: str = "cand_no") -> DataFrame:
    """n rows per row, numbered from 1; the prompt is rendered before, so once per row."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(1), F.lit(n))))


def call_rows(df: DataFrame, column: str, call: Callable[[dict], str | None], out: str = "text", error: str = "error", retries: int = 0, in_flight: int = 1, wait: float = 1.0, longest: float = 60.0, pause: float = 0.0, on_error: str | None = None) -> DataFrame:
    """A remote call per row inside the executors; a failed row gets ``on_error`` and its error, after ``retries``.

    Up to ``in_flight`` calls of a task run at once (a table of p partitions makes at most
    p x ``in_flight`` calls at a time).  Before the n-th retry a call waits ``wait`` x 2^(n-1) seconds, at
    most ``longest``; ``pause`` seconds pass between the calls of a thread.  Rows keep their order.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])

    def one(row: dict) -> tuple[str | None, str | None]:
        why = None
        for attempt in range(retries + 1):
            if attempt:
                time.sleep(min(wait * 2 ** (attempt - 1), longest))
            try:
                return call(row), None
            except Exception as e:
                why = f"{type(e).__name__}: {e}"
            finally:
                if pause:
                    time.sleep(pause)
        return on_error, why

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(in_flight, 1)) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf.to_dict("records")))
                yield pdf.assign(**{out: [g[0] for g in got], error: [g[1] for g in got]})

    return df.mapInPandas(run, schema)


def call_batches(df: DataFrame, column: str, call: Callable[[list[str]], list[str | None]], size: int = 32, out: str = "text", error: str = "error") -> DataFrame:
    """A model call per ``size`` rows of a partition; a batch that fails is tried row by row, so one bad row spoils only itself."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts: list[str | None] = []
            errors: list[str | None] = []
            values = pdf[column].tolist()
            for lo in range(0, len(values), size):
                part = values[lo : lo + size]
                try:
                    got = call(part)
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} answers to {len(part)} prompts")
                    texts += got
                    errors += [None] * len(part)
                except Exception:
                    for v in part:
                        try:
                            texts += call([v])
                            errors.append(None)
                        except Exception as e:
                            texts.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{out: texts, error: errors})

    return df.mapInPandas(run, schema)


def generate_unique(prompts: DataFrame, propose: Step, per_id: int, attempts: int = 3, key: str = "id") -> DataFrame:
    """Up to ``per_id`` distinct texts per id: missing or repeated ones are proposed again, a bounded number of times."""
    todo = replicate(prompts, per_id)
    have: DataFrame | None = None
    for attempt in range(attempts):
        made = propose(todo.withColumn("attempt", F.lit(attempt))).where(F.col("text").rlike(r"(?U)\S"))
        first = made.groupBy(key, "text").agg(F.min("cand_no").alias("cand_no"))
        fresh = first if have is None else first.join(have.select(key, "text"), [key, "text"], "left_anti")
        have = materialize(fresh if have is None else have.unionByName(fresh.select(*have.columns)), "unique")
        todo = replicate(prompts, per_id).join(have.select(key, "cand_no"), [key, "cand_no"], "left_anti")
        if todo.isEmpty():
            break
    return have


def judge_refine(candidates: DataFrame, judge: Step, refine: Step, target: int, least: tuple[int, int, int] = (4, 4, 3), max_rounds: int = 3, accept: str = "improve", fallback: str = "none", retries: int = 3, key: str = "id", threshold: float = 0.7, log: str | None = None) -> DataFrame:
    """``key``, ``text``, ``pick``, ``refine_round``, ``overall``: the chosen texts per id.

    Groups that reach ``target`` good rows, or have no bad ones, stop.  A refinement must be new in
    its group (tried ``retries`` times, else the text stays) and with ``accept="improve"`` counts
    only if the overall score rises; "always" takes it.  If a group ends without a good row,
    ``fallback="all"`` chooses among all.  ``max_rounds`` of 0 only judges, -1 does not even judge.
    With ``log`` every round's rows are appended to that folder as JSON lines, with their round and
    whether they are good; ``aggregate.round_stats`` sums them up.
    """
    state = candidates.select(key, "cand_no", F.col("text").alias("original"), "text", F.lit(0).alias("refine_round"))
    if max_rounds < 0:
        rows = state.withColumn("overall", F.lit(0))
        picks = diverse_top_k(rows, key, "text", target, threshold, seq="cand_no")
        return rows.join(picks, [key, "text"]).select(key, "text", "pick", "refine_round", "overall")

    def good():
        return good_verdict(F.col("match"), F.col("simplicity"), F.col("overall"), F.col("too_technical"), *least)

    def note(n: int) -> None:
        if log:
            append_log(state.select(F.lit(n).alias("round"), "*", good().alias("good")), log)

    state = materialize(judge(state), "judged")
    note(0)
    for n in range(1, max_rounds + 1):
        sizes = state.groupBy(key).agg(F.count_if(good()).alias("g"), F.count_if(~good()).alias("b"))
        active = sizes.where((F.col("g") < target) & (F.col("b") > 0)).select(key)
        bad = state.where(~good()).join(active, key, "left_semi")
        if bad.isEmpty():
            break
        used = state.select(key, "text").distinct()
        done, open_rows = None, bad
        for attempt in range(retries):
            made = refine(open_rows.withColumn("attempt", F.lit(attempt)).withColumn("before", F.col("text")))
            new = made.where(F.col("text").rlike(r"(?U)\S")).join(used, [key, "text"], "left_anti")
            one = new.groupBy(key, "text").agg(F.min("cand_no").alias("cand_no"))
            part = materialize(open_rows.drop("text", *SCORES).join(one, [key, "cand_no"]), "refined")
            done = part if done is None else done.unionByName(part)
            used = used.unionByName(part.select(key, "text"))
            open_rows = open_rows.join(part.select(key, "cand_no"), [key, "cand_no"], "left_anti")
            if open_rows.isEmpty():
                break
        scored = judge(done).select(key, "cand_no", F.col("text").alias("n_text"), *[F.col(s).alias(f"n_{s}") for s in SCORES])
        both = state.join(scored, [key, "cand_no"], "left")
        take = F.col("n_text").isNotNull() & (F.lit(accept == "always") | (F.col("n_overall") > F.col("overall")))
        state = materialize(both.select(key, "cand_no", "original", F.when(take, F.col("n_text")).otherwise(F.col("text")).alias("text"), F.when(take, F.lit(n)).otherwise(F.col("refine_round")).alias("refine_round"), *[F.when(take, F.col(f"n_{s}")).otherwise(F.col(s)).alias(s) for s in SCORES]), "judged")
        note(n)
    rows = state.withColumn("good", good())
    if fallback == "all":
        some = rows.groupBy(key).agg(F.max("good").alias("any"))
        rows = rows.join(some, key).where(F.col("good") | ~F.col("any"))
    else:
        rows = rows.where("good")
    order = [-F.col("overall"), -F.col("match"), -F.col("simplicity"), F.col("cand_no")]
    picks = diverse_top_k(rows, key, "text", target, threshold, order=order, seq="cand_no")
    best = rows.groupBy(key, "text").agg(F.max_by(F.struct("refine_round", "overall"), F.struct("overall", -F.col("cand_no"))).alias("b"))
    return picks.join(best, [key, "text"]).select(key, "text", "pick", "b.refine_round", "b.overall")
