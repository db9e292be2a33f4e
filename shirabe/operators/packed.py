"""Several values packed in one field: infer the separators of each source, then split.

The separators are not given.  Every character that is neither letter nor digit and stands
outside quotes is a candidate.  Starting from "all candidates separate", one candidate per round is
taken out of the set, judged by two scores over the counted forms of the source:

* Type regularity: the chance that two pieces have one type.  In ``HP:12;HP:7`` the pieces are all
  alike without the colon and of two types with it, so the colon goes.
* Piece-count consistency: whether the pieces that hold the candidate hold it equally often.  In
  ``12:30;8:15`` the types do not tell, but each piece has exactly one colon, while the number of
  semicolons differs from field to field: the colon goes, the semicolon stays.

Where a source leaves even this open (every field has the same shape), a fixed list of signs decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.session import materialize

# Pairs that may enclose a whole field.
BRACKETS = {"[": "]", "(": ")", "{": "}", "［": "］", "（": "）", "【": "】", "「": "」"}
_QUOTED = r'"(?:[^"]|"")*"|\x27(?:[^\x27]|\x27\x27)*\x27'
_BLANK = r"(?U)^\s+|\s+$"


def _class(chars: list[str]) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


def unwrap(col: Column) -> Column:
    """Trim, then drop one pair of brackets that encloses the whole field."""
    out = F.regexp_replace(col, _BLANK, "")
    pairs = "|".join(f"{_class([a])}[^{_class([a, b])}]*{_class([b])}" for a, b in BRACKETS.items())
    tail = r"[\s,;]*"  # a separator left behind the closing bracket
    core = F.regexp_replace(out, rf"(?Us){tail}$", "")
    return F.when(core.rlike(rf"(?s)^(?:{pairs})$"), F.regexp_replace(F.substring(core, 2, 1 << 30), r"(?s).$", "")).otherwise(out)


# Signs that belong to the value where nothing in the source tells.
INSIDE = ".:-_'+@#%&*=~^"


def _skeletons(df: DataFrame, field: str, source: list[str]) -> DataFrame:
    """Forms of the fields, counted: quoted parts are Q, letter runs A, digit runs 9."""
    form = unwrap(F.col(field))
    form = F.regexp_replace(form, _QUOTED, "\ue000")
    form = F.regexp_replace(form, r"\p{L}+", "A")
    form = F.translate(F.regexp_replace(form, r"\p{N}+", "9"), "\ue000", "Q")
    return df.select(*source, form.alias("form")).where(F.length("form") > 0).groupBy(*source, "form").agg(F.count("*").alias("n"))


def _cls(chars: Column) -> Column:
    """A character class of an array of characters, as a regular expression; one that never matches if empty."""
    parts = F.array_join(F.transform(chars, lambda c: F.concat(F.lit("\\x{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))), "")
    return F.when(F.size(chars) > 0, F.concat(F.lit("["), parts, F.lit("]"))).otherwise(F.lit("(?!)"))


def separator_table(df: DataFrame, field: str, source_cols: list[str] | None = None) -> DataFrame:
    """``source_cols`` and ``seps``: the separator characters of each source, as a sorted array.

    A source whose fields hold no sign has the empty array.  Each round scores every candidate of
    every source in one distributed pass over the counted forms and takes at most one out per
    source; what is gathered per source is one score for each of its candidates.  A candidate is a sign, or a group of signs whose numbers are in one proportion in all
    fields (the dashes, the space and the colon of a date with time).  The rounds end when no source
    changes, at the latest when no candidate is left.
    """
    named = list(source_cols or [])
    source = named or ["_all"]
    forms = materialize(_skeletons(df if named else df.withColumn("_all", F.lit(0)), field, source), "packed-forms")
    signs = F.array_distinct(F.filter(F.split(F.regexp_replace("form", r"[A9Q]", ""), ""), lambda c: F.length(c) > 0))
    held = forms.select(*source, "form", F.explode(signs).alias("c")).withColumn("k", F.length("form") - F.length(F.replace("form", F.col("c"), F.lit(""))))
    # signs in one proportion have one mean of any number drawn per form; one form alone shows no proportion
    means = [F.round(F.sum(F.pmod(F.xxhash64(F.lit(i), "form"), F.lit(1_000_003)) * F.col("k")) / F.sum("k"), 6) for i in (1, 2)]
    alike = held.groupBy(*source, "c").agg(F.struct(*means, F.when(F.count("*") < 2, F.col("c"))).alias("m")).groupBy(*source, "m").agg(F.array_sort(F.collect_list("c")).alias("g"))
    state = forms.select(*source).distinct().select(*(F.col(x).alias(f"_{x}") for x in source))
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in source]
    grouped = alike.groupBy(*source).agg(F.collect_list("g").alias("groups"))
    state = state.join(grouped, same, "left").select(*(F.col(f"_{x}").alias(x) for x in source), F.coalesce("groups", F.array().cast("array<array<string>>")).alias("groups"))
    state = state.select(*source, F.array_sort(F.flatten("groups")).alias("seps"), F.filter("groups", lambda g: F.size(g) > 1).alias("groups"))
    state = materialize(state.withColumn("live", F.size("seps") > 0), "packed-state")

    def inside(t: Column) -> Column:
        return F.forall(t, lambda c: F.instr(F.lit(INSIDE), c) > 0)

    while not state.where("live").isEmpty():
        tried = F.concat(F.array(F.array().cast("array<string>")), F.transform("seps", lambda c: F.array(c)), F.filter("groups", lambda g: F.size(F.array_except(g, F.col("seps"))) == 0))
        trial = state.where("live").select(*(F.col(x).alias(f"_{x}") for x in source), F.explode(F.transform(tried, lambda c: F.struct(c.alias("c"), F.array_except("seps", c).alias("rest")))).alias("t"))
        trial = trial.select(*(f"_{x}" for x in source), "t.c", _cls(F.col("t.rest")).alias("cls"))
        pieces = forms.join(trial, same).select(*source, "c", "n", F.explode(F.split("form", F.col("cls"))).alias("piece"))
        counts = pieces.groupBy(*source, "c", "piece").agg(F.sum("n").cast("double").alias("n"))
        some = F.col("piece") != ""
        often = F.length("piece") - F.length(F.replace("piece", F.coalesce(F.get("c", F.lit(0)), F.lit("")), F.lit("")))
        full = F.sum(F.when(some, F.col("n")).otherwise(0.0))
        # a quoted piece is a value of whatever type: it counts as one of the most frequent type
        quoted, typed = F.coalesce(F.sum(F.when(F.col("piece") == "Q", F.col("n"))), F.lit(0.0)), some & (F.col("piece") != "Q")
        most = F.coalesce(F.max(F.when(typed, F.col("n"))), F.lit(0.0))
        square = F.sum(F.when(typed, F.col("n") * F.col("n")).otherwise(0.0)) + 2 * most * quoted + quoted * quoted
        regular = square / (full * full) * (0.5 + 0.5 * full / F.sum("n"))
        score = counts.groupBy(*source, "c").agg(F.coalesce(F.when(full > 0, regular), F.lit(0.0)).alias("regular"), (F.min(F.when(often > 0, often)) == F.max(often)).alias("steady"))
        scores = score.groupBy(*source).agg(F.max(F.when(F.size("c") == 0, F.col("regular"))).alias("now"), F.collect_list(F.when(F.size("c") > 0, F.struct("regular", F.coalesce("steady", F.lit(False)).alias("steady"), inside(F.col("c")).alias("value"), "c"))).alias("all"))
        best = F.array_max("all")
        # equal types, and pieces that hold the candidate equally often
        even = F.array_max(F.filter("all", lambda x: (F.abs(x["regular"] - F.col("now")) < 1e-9) & x["steady"]))
        chosen = scores.select(*(F.col(x).alias(f"_{x}") for x in source), F.when(best["regular"] > F.col("now") + 1e-9, best["c"]).alias("b"), even["c"].alias("e"))
        # what would leave no separator only goes on even terms if it is made of signs of values
        gone = F.when(F.col("live"), F.coalesce("b", F.when((F.size("seps") > F.size("e")) | inside(F.col("e")), F.col("e"))))
        left = F.when(gone.isNotNull(), F.array_except("seps", gone)).otherwise(F.col("seps"))
        state = materialize(state.join(chosen, same, "left").select(*source, "groups", left.alias("seps"), (gone.isNotNull() & (F.size(left) > 0)).alias("live")), "packed-state")
    return state.select(*named, "seps")


def infer_separators(df: DataFrame, field: str, source_cols: list[str] | None = None) -> dict[tuple, list[str]]:
    """Separator characters per source, as a dictionary on the driver (the empty tuple if there is no source column)."""
    source = list(source_cols or [])
    return {tuple(r[x] for x in source): list(r["seps"]) for r in separator_table(df, field, source).collect()}


def split_packed(df: DataFrame, key: str, field: str, source_cols: list[str] | None = None, separators: dict[tuple, list[str]] | None = None, pos: str = "item_pos", item: str = "item_text") -> DataFrame:
    """One row per value of ``field``: ``key``, ``pos`` (from 1, non-empty values), ``item``.

    Null and blank fields give no row; what stands inside quotes is one value whatever it holds,
    a doubled quote inside counts as one; an unclosed quote is an ordinary character; empty
    quoted values are skipped and not counted.  Repeated rows repeat their values; other columns
    of ``df`` do not matter, whatever their names.
    """
    source = list(source_cols or [])
    rows = df.select(F.col(key).alias("_key"), *(F.col(s).alias(f"_s{i}") for i, s in enumerate(source)), F.col(field).alias("_field")).where(F.col("_field").rlike(r"(?U)\S"))
    named = [f"_s{i}" for i in range(len(source))]
    if source and separators is None:
        table = separator_table(rows, "_field", named).select(*(F.col(n).alias(f"t{n}") for n in named), _split_pattern(F.col("seps")).alias("_pat"))
    elif source:
        types = {f.name: f.dataType.simpleString() for f in rows.schema}
        table = df.sparkSession.createDataFrame([(*k, _pattern(v)) for k, v in separators.items()], ", ".join([*(f"t{s} {types[s]}" for s in named), "_pat string"]))
    if source:
        rows = rows.join(table, [F.col(n).eqNullSafe(F.col(f"t{n}")) for n in named], "left").select("_key", "_field", F.coalesce("_pat", F.lit(_pattern([]))).alias("_pat"))
    else:
        seps = separators if separators is not None else infer_separators(rows, "_field")
        rows = rows.withColumn("_pat", F.lit(_pattern(seps.get((), []))))
    raw = F.regexp_extract_all(unwrap(F.col("_field")), F.col("_pat"), F.lit(0))
    items = F.filter(F.transform(raw, _unquote), lambda x: F.length(x) > 0)
    return rows.select("_key", F.posexplode(items)).select(F.col("_key").alias(key), (F.col("pos") + 1).cast("bigint").alias(pos), F.col("col").alias(item))


def _pattern(seps: list[str]) -> str:
    if not seps:
        return rf"(?s){_QUOTED}|.+"
    cls = _class(seps)
    return rf"{_QUOTED}|[^{cls}]+"


def _split_pattern(seps: Column) -> Column:
    return F.when(F.size(seps) > 0, F.concat(F.lit(f"{_QUOTED}|[^"), F.substring(_cls(seps), 2, 1 << 30), F.lit("+"))).otherwise(F.lit(_pattern([])))


def _unquote(x: Column) -> Column:
    x = F.regexp_replace(x, _BLANK, "")
    inner = F.regexp_replace(x, r"(?s)^.|.$", "")
    clean = F.when(x.rlike(r'(?s)^".*"$') & (F.length(x) > 1), F.regexp_replace(inner, '""', '"')).when(x.rlike(r"(?s)^'.*'$") & (F.length(x) > 1), F.regexp_replace(inner, "''", "'")).otherwise(x)
    return F.regexp_replace(clean, _BLANK, "")
