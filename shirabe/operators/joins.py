"""Keyed joins: enrichment, column updates, work lists, injection of official labels, merges.

Which side is broadcast is left to Spark, which knows the sizes; nothing here forces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.functions.text import first_present, strip
from shirabe.operators.dedupe import last_wins


def enrich(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, columns: dict[str, Column | None], seq: str | None = "seq") -> DataFrame:
    """Left join with the last lookup row per key; ``columns`` maps new columns to the default of a miss."""
    table = last_wins(lookup.where(F.col(lookup_key).isNotNull()), [lookup_key], seq) if seq else lookup
    side = table.select(F.col(lookup_key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = df.join(side, F.col(key) == F.col("_k"), "left")
    for c, default in columns.items():
        value = F.col(f"_new_{c}")
        out = out.withColumn(c, value if default is None else F.coalesce(value, default)).drop(f"_new_{c}")
    return out.drop("_k")


def left_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Plain left join; keys repeated on the right fan out."""
    return left.join(right, key, "left")


def update_columns(df: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` where the patch has a value, keep the rest; ``patch`` has unique keys."""
    side = patch.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    out = df.join(side, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_from_cache(df: DataFrame, cache: DataFrame, key: str, column: str, default: str = "") -> DataFrame:
    """The value there is, else the last cached one that is not blank, else the default."""
    hits = last_wins(cache.where(F.col(column).rlike(r"(?U)\S")), [key])
    side = hits.select(F.col(key).alias("_k"), F.col(column).alias("_c"))
    out = df.join(side, F.col(key) == F.col("_k"), "left")
    own = F.when(F.col(column).rlike(r"(?U)\S"), F.col(column))
    return out.withColumn(column, F.coalesce(own, F.col("_c"), F.lit(default))).drop("_k", "_c")


def work_list(df: DataFrame, cache: DataFrame, key: str, column: str) -> DataFrame:
    """Rows that still lack a value and have none in the cache."""
    missing = df.where(~F.coalesce(F.col(column).rlike(r"(?U)\S"), F.lit(False)))
    known = cache.where(F.col(column).rlike(r"(?U)\S")).select(F.col(key).alias("_k")).distinct()
    return missing.join(known, F.col(key) == F.col("_k"), "left_anti")


def only_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Semi join: rows whose key is listed."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def inject_official(records: DataFrame, universe: DataFrame, labels: DataFrame, group: str, text: str, label: str, norm, extra: dict[str, Column]) -> DataFrame:
    """Official labels added to the records where the group does not hold them yet.

    The groups are those of ``universe`` (the unfiltered records); blank labels and unknown groups
    are skipped.  ``norm`` maps a text column to its comparison key; ``extra`` gives the other
    columns of the new rows.
    """
    wanted = labels.where(F.col(label).rlike(r"(?U)\S")).join(universe.select(group).where(F.col(group).isNotNull()).distinct(), group, "left_semi")
    fresh = wanted.withColumn("_n", norm(F.col(label)))
    have = records.select(F.col(group).alias("_g"), norm(F.col(text)).alias("_h")).distinct()
    new = fresh.join(have, (F.col(group) == F.col("_g")) & (F.col("_n") == F.col("_h")), "left_anti")
    rows = new.select(*[F.col(group) if c == group else F.col(label).alias(c) if c == text else extra[c].alias(c) if c in extra else F.lit(None).cast(records.schema[c].dataType).alias(c) for c in records.columns])
    return records.unionByName(rows)


def back_reference(df: DataFrame, group: str, final: str, original: str, seq: str = "seq") -> DataFrame:
    """Per (group, final text) the original it was first made from; '' if there is none."""
    return df.where(F.col(final) != "").groupBy(group, final).agg(F.coalesce(F.min_by(original, seq), F.lit("")).alias(original))


def build_master(patient: DataFrame, doctor: DataFrame, master: DataFrame, key: str = "hpo_id", text: str = "expr", seq: str = "seq", info: tuple[str, ...] = ("name_ja", "name_en", "category"), flags: tuple[str, ...] = ("is_leaf", "self_reportable")) -> DataFrame:
    """One row per id that has expressions: facts, and the distinct expressions in arrival order.

    Patient records come before doctor records; the first record of an id gives fallback facts,
    the master's win where not blank; blank flags become 0; ids unknown to the master stay.
    """
    both = patient.withColumn("_side", F.lit(0)).unionByName(doctor.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rows = both.withColumn("_x", strip(F.coalesce(F.col(text), F.lit("")))).where((F.col("_x") != "") & F.col(key).rlike(r"(?U)\S"))
    order = F.struct("_side", seq)
    facts = rows.groupBy(key).agg(F.count("*").alias("_n"), *[F.min_by(F.col(c), order).alias(f"_f_{c}") for c in info if c in rows.columns])
    firsts = rows.groupBy(key, "_side", "_x").agg(F.min(seq).alias("_s"))

    def arr(side: int) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == side, F.struct("_s", "_x")))), lambda s: s["_x"])

    lists = firsts.groupBy(key).agg(arr(0).alias("patient_expressions"), arr(1).alias("doctor_expressions"))
    last = last_wins(master.where(F.col(key).rlike(r"(?U)\S")), [key], seq)
    side = last.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_m_{c}") for c in (*info, *flags) if c in master.columns])
    out = lists.join(facts, key).join(side, F.col(key) == F.col("_k"), "left")
    def fact(c: str) -> Column:
        parts = [F.col(f"_m_{c}")] * (c in master.columns) + [F.col(f"_f_{c}")] * (c in rows.columns)
        return F.coalesce(first_present(*parts), F.lit("")).alias(c)

    flag = [F.coalesce(F.col(f"_m_{c}").try_cast("double").try_cast("int"), F.lit(0)).alias(c) for c in flags if c in master.columns]
    return out.select(key, *[fact(c) for c in info], *flag, "patient_expressions", "doctor_expressions")
