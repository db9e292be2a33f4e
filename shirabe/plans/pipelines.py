"""Whole pipelines: dictionary curation, training rows, label filling, evaluation, sweeps."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions.chat import expression_prompt
from shirabe.functions.text import clean_expression, clear_noise, compare_key, match_key
from shirabe.operators.dedupe import cross_group_duplicates, last_wins
from shirabe.operators.joins import inject_official, update_columns, work_list
from shirabe.operators.vector import hashed_embedding, own_and_other, similarity_reason
from shirabe.session import materialize


def source_of(score: Column, official: float = 10.0) -> Column:
    """"official" for the score that official labels carry, else "gen_filtered"."""
    return F.when(score == official, "official").otherwise("gen_filtered")


def removal_details(rows: DataFrame, labels: DataFrame, key: str = "hpo_id", label: str = "label") -> DataFrame:
    """Adds ``details``: own_sim, other_sim, margin (rounded), best_other and its label ('' if unknown)."""
    names = labels.select(F.col(key).alias("_k"), F.col(label).alias("_l"))
    joined = rows.join(names, F.col("best_other") == F.col("_k"), "left")
    parts = [F.round("own", 4).alias("own_sim"), F.round("other", 4).alias("other_sim"), F.round(F.col("other") - F.col("own"), 4).alias("margin"), F.col("best_other").alias("best_other_id"), F.coalesce("_l", F.lit("")).alias("best_other_label")]
    return joined.withColumn("details", F.struct(*parts)).drop("_k", "_l", "own", "other", "best_other")


def update_both(tables: list[DataFrame], labels: DataFrame, key: str, columns: list[str]) -> list[DataFrame]:
    """One patch, ``labels`` (unique keys), written into every table that has the key."""
    return [update_columns(t, labels, key, columns) for t in tables]


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is neither null nor blank."""
    return df.where(F.col(label).rlike(r"(?U)\S"))


def differing(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose two texts differ once compared alike, and one row with the counts ``before`` and ``after``."""
    keep = compare_key(F.col(a)) != compare_key(F.col(b))
    return df.where(keep), df.agg(F.count("*").alias("before"), F.count_if(keep).alias("after"))


def curate(records: DataFrame, ontology: DataFrame, policy: str = "drop_all", self_min: float = 0.4, other_margin: float = 0.15, ambiguous_gap: float = 0.05, official: bool = True, embed: Callable[[Column], Column] = hashed_embedding, mode: str = "patient", normal: Callable[[Column], Column] = match_key) -> tuple[DataFrame, DataFrame]:
    """Kept and removed expressions.

    ``records``: hpo_id, expr, score, mode, source, seq; ``ontology``: hpo_id, label, depth, seq.
    Stages in order, cheap before dear: equal to the own label, in several groups, similarity;
    then official labels are added and all texts cleaned again.  Rows removed by similarity carry
    ``details``: both similarities, their margin and the other label, rounded to four places.
    """
    meta = last_wins(ontology, ["hpo_id"])
    rows = records.withColumn("norm", normal(F.col("expr"))).join(meta.select("hpo_id", "label", "depth"), "hpo_id", "left").withColumn("label", F.coalesce("label", F.lit("")))
    rows = rows.withColumn("reason", F.when((F.col("label") != "") & (normal(F.col("label")) == F.col("norm")), "same_as_label"))
    first, same = rows.where(F.col("reason").isNull()).drop("reason"), rows.where(F.col("reason").isNotNull())
    second = materialize(cross_group_duplicates(first, "hpo_id", "norm", policy), "curate")
    rest, dup = second.where(F.col("reason").isNull()).drop("reason"), second.where(F.col("reason").isNotNull())
    if self_min > 0 or other_margin > 0:
        labels = meta.select("hpo_id", embed(F.col("label")).alias("vec"))
        texts = rest.select("seq", "hpo_id", embed(F.col("expr")).alias("vec"))
        sims = own_and_other(texts, labels, "seq", "hpo_id")
        scored = rest.join(sims, "seq", "left").withColumn("reason", similarity_reason(F.col("own"), F.col("other"), self_min, other_margin, ambiguous_gap))
        scored = materialize(scored, "scored")  # embedded and compared once, for the kept and the removed rows
        rest, far = scored.where(F.col("reason").isNull()).drop("reason", "own", "other", "best_other"), removal_details(scored.where(F.col("reason").isNotNull()), meta)
    else:
        far = rest.where(F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    kept = rest.select("hpo_id", "label", "expr", "score", "mode", F.lit(False).alias("is_official"))
    if official:
        universe = records.select("hpo_id")
        extra = {"label": F.col("label"), "score": F.lit(10.0), "mode": F.lit(mode), "is_official": F.lit(True)}
        kept = inject_official(kept, universe, meta, "hpo_id", "expr", "label", normal, extra)
    kept = kept.withColumn("expr", clean_expression(F.col("expr"), F.col("mode"))).withColumn("source", source_of(F.col("score")))
    gone = same.unionByName(dup, allowMissingColumns=True).unionByName(far, allowMissingColumns=True)
    return kept, gone


def training_rows(surfaces: DataFrame, names: DataFrame, ask: str, system: str, task: str, source: str) -> DataFrame:
    """Chat rows from a surface dictionary: surface differs from name, name looked up for id and definition.

    ``surfaces``: surface, standard_name; ``names``: label, hpo_id, definition, seq.  A matched name
    without a definition keeps its id; an unmatched one has a null id.
    """
    rows = surfaces.where(F.col("surface").rlike(r"(?U)\S") & F.col("standard_name").rlike(r"(?U)\S")).withColumn("_s", compare_key(F.col("surface"))).withColumn("_n", compare_key(F.col("standard_name"))).where(F.col("_s") != F.col("_n"))
    table = last_wins(names.where(F.col("label").rlike(r"(?U)\S")).withColumn("_l", F.trim("label")), ["_l"])
    found = rows.join(table.select("_l", "hpo_id", "definition"), F.col("_n") == F.col("_l"), "left")
    return found.select(expression_prompt(F.col("_n"), F.col("definition"), ask, system).alias("messages"), F.col("_s").alias("output"), F.lit(task).alias("task"), "hpo_id", F.coalesce(F.col("definition").rlike(r"(?U)\S"), F.lit(False)).alias("has_definition"), F.col("_n").alias("standard_name"), F.lit(source).alias("source"))


def fill_labels(master: DataFrame, log: DataFrame, generate: Callable[[DataFrame], DataFrame], key: str = "hpo_id", label: str = "jp_final", origin: str = "jp_source", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The master with missing labels filled, and the new log rows.

    Interface noise is cleared first; labels in the log are used before the model is asked; failed
    rows stay null and come up again next time.
    """
    rows = master.withColumn("_was", F.col(label)).withColumn(label, clear_noise(F.when(F.col(label).rlike(r"(?U)\S"), F.col(label)))).withColumn(origin, F.when(F.col("_was").rlike(r"(?U)\S") & F.col(label).isNull(), F.lit("llm_regen")).otherwise(F.col(origin))).drop("_was")
    todo = work_list(rows, log.select(key, label), key, label)
    todo = todo.orderBy("seq").limit(most) if most is not None else todo
    made = materialize(generate(todo.dropDuplicates([key])).select(key, label), "labels")
    cached = last_wins(log.where(F.col(label).rlike(r"(?U)\S")), [key]).select(key, label)
    every = cached.unionByName(made.where(F.col(label).rlike(r"(?U)\S")).join(cached.select(key), key, "left_anti"))
    missing = rows.where(F.col(label).isNull())
    done = rows.where(F.col(label).isNotNull()).unionByName(update_columns(missing, every, key, [label]).withColumn(origin, F.when(F.col(label).isNotNull(), F.coalesce(F.col(origin), F.lit("llm"))).otherwise(F.col(origin))))
    return done, made


def translate_definitions(master: DataFrame, cache: DataFrame, translate: Callable[[DataFrame], DataFrame], key: str = "hpo_id", category: str = "category", wanted: str = "symptom") -> DataFrame:
    """``definition_ja`` from the value there is, the cache, the translator, else ''; other categories get ''."""
    own = master.where(F.col(category) == wanted)
    todo = work_list(own, cache, key, "definition_ja").where(F.col("definition").rlike(r"(?U)\S"))
    made = translate(todo).select(key, F.col("definition_ja").alias("_new"))
    out = master.join(last_wins(cache, [key]).select(F.col(key).alias("_k"), F.col("definition_ja").alias("_old")), F.col(key) == F.col("_k"), "left").drop("_k").join(made, key, "left")
    value = F.coalesce(F.when(F.col("definition_ja").rlike(r"(?U)\S"), F.col("definition_ja")), F.col("_old"), F.col("_new"), F.lit(""))
    return out.withColumn("definition_ja", F.when(F.col(category) == wanted, value).otherwise(F.coalesce("definition_ja", F.lit("")))).drop("_old", "_new")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def run_steps(spark: SparkSession, steps: list[tuple[str, str, Callable[[], DataFrame]]], start: str | None = None, stop_on_error: bool = True) -> dict[str, str]:
    """Run (name, output path, maker) in order; finished outputs are kept, ``start`` begins at a later step.

    Returns per step: skipped, done, or the error (the rest then goes on unless ``stop_on_error``).
    """
    out: dict[str, str] = {}
    live = start is None
    for name, path, make in steps:
        live = live or name == start
        if not live or exists(spark, os_join(path, "_SUCCESS")):
            out[name] = "skipped"
            continue
        try:
            make().write.mode("overwrite").parquet(path)
            out[name] = "done"
        except Exception as e:
            out[name] = f"error: {e}"
            if stop_on_error:
                break
    return out


def os_join(path: str, name: str) -> str:
    return path.rstrip("/") + "/" + name


def sweep(grid: dict[str, list], run: Callable[[dict], DataFrame | None], done: Callable[[dict], bool] | None = None) -> list[tuple[dict, DataFrame | None]]:
    """Every combination of the grid's values, in order; combinations that ``done`` knows as finished are left out.

    With outputs in files, ``done`` is ``lambda s: finished(spark, path_of(s))``.
    """
    settings = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return [(s, run(s)) for s in settings if done is None or not done(s)]


def finished(spark: SparkSession, path: str) -> bool:
    """Was the table at this path written to its end?"""
    return exists(spark, os_join(path, "_SUCCESS"))


def summarize(kept: DataFrame, removed: DataFrame, metrics: DataFrame, condition: str, names: list[str]) -> DataFrame:
    """One row of a sweep's table: counts of kept (official and made) and removed rows, and the metrics."""
    k = kept.agg(F.count("*").alias("post_total"), F.count_if("is_official").alias("post_official"))
    r = removed.agg(F.count("*").alias("removed"))
    wide = metrics.groupBy().pivot("metric", names).agg(F.first("value"))
    return k.join(r).join(wide).select(F.lit(condition).alias("cond_tag"), "post_total", (F.col("post_total") - F.col("post_official")).alias("post_gen"), "post_official", "removed", *names)
