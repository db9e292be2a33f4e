"""Readers.  Each attaches ``seq``, a sortable struct of file, block and line order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions.text import clean_expression, depth_of, detect_mode, first_present, strip

# The names under which producers write one thing, in the order they are tried.
ALIASES = {
    "hpo_id": ["HPO_ID", "hpo_id"],
    "expr": ["patient_expression_final", "doctor_expression_final", "expr", "final_text", "refined_text", "text", "patient_expression_original", "doctor_expression_original"],
    "name_ja": ["jp_final", "jp_label", "name_ja", "HPO_name_ja", "ja_2023", "ja_2017_expert"],
    "label": ["jp_final", "jp_label"],
    "cached_label": ["jp_label", "jp_final"],
    "category": ["category_v2", "category"],
    "definition": ["definition_ja", "definition"],
    "patient_expr": ["patient_expression_final", "patient_expression_original", "patient_expression", "expr", "text"],
    "doctor_expr": ["expression", "doctor_expression", "doctor_expression_final", "expr", "text"],
}
SCORE_PATHS = ["$.judge_overall", "$.judge.overall", "$.judge_result.overall_score", "$.score"]
ROUND_PATHS = ["$.round", "$.judge_round", "$.refine_round"]


class MissingColumns(ValueError):
    """A source lacks columns that it must have."""


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise MissingColumns(f"missing columns: {', '.join(lacking)}")
    return df


def with_seq(df: DataFrame, name: str = "seq") -> DataFrame:
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return df.select("*", order.alias(name))


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, required: list[str] | None = None, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """CSV with a header, all texts unless ``schema`` says otherwise; a byte order mark is dropped, blanks are null.

    With ``multi_line`` quoted values may hold line ends; every file is then one task.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, escape='"', sep=sep, encoding="UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return with_seq(require(df, required or []))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``text``, ``seq``: the lines that are not blank, trimmed."""
    return with_seq(spark.read.text(path)).select(strip(F.col("value")).alias("text"), "seq").where(F.col("text") != "")


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``v`` (VARIANT), ``seq``, ``file``: one row per line that is a JSON object; blank and broken lines are skipped.

    Keys keep their case, so producers that write one name in two cases do not collide.
    """
    rows = with_seq(spark.read.text(path)).select(F.try_parse_json("value").alias("v"), "seq", F.col("seq.file").alias("file"))
    return rows.where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def json_text(v: Column | str, *keys: str) -> Column:
    """The first of the keys with a value that is not empty, as text."""
    return first_present(*[F.try_variant_get(v, f"$.{k}", "string") for k in keys])


def json_number(v: Column | str, paths: list[str], default: float = 0.0) -> Column:
    """The number at the first path that is present; present but no number gives the default."""
    picks = [F.when(F.try_variant_get(v, p, "variant").isNotNull(), F.coalesce(F.try_variant_get(v, p, "string").try_cast("double"), F.lit(default))) for p in paths]
    return F.coalesce(*picks, F.lit(default))


def read_expressions(spark: SparkSession, path: str | list[str], mode: str = "patient") -> DataFrame:
    """Generated expressions of any producer: ``hpo_id``, ``expr``, ``original``, ``score``, ``mode``, ``source``, ``seq``.

    Cleaned by the record's mode; with mode "mixed" the record's own mode or source decides.
    Records without an id or without text left are dropped.
    """
    v = "v"
    rows = read_jsonl(spark, path).select(
        json_text(v, *ALIASES["hpo_id"]).alias("hpo_id"), json_text(v, *ALIASES["expr"]).alias("_raw"), json_number(v, SCORE_PATHS).alias("score"),
        json_text(v, "mode", "source").alias("_mode"), F.coalesce(json_text(v, "source"), F.lit("")).alias("source"),
        F.coalesce(json_text(v, "patient_expression_original", "doctor_expression_original"), F.lit("")).alias("original"), "seq")
    kind = detect_mode(F.col("_mode"), mode) if mode == "mixed" else F.lit(mode)
    out = rows.withColumn("mode", kind).withColumn("expr", clean_expression(F.col("_raw"), F.col("mode")))
    return out.where((F.coalesce(F.col("hpo_id"), F.lit("")) != "") & (F.col("expr") != "")).drop("_raw", "_mode")


def ontology_items(df: DataFrame, id_col: str = "HPO_ID", prefix: str | None = None, default_source: str = "", default_category: str = "Unknown", strict_depth: bool = False) -> DataFrame:
    """Master rows with aliases resolved: ``hpo_id``, ``name_ja``, ``name_en``, ``category``, ``definition``, ``source``, ``depth``, ``seq``.

    Rows with a blank id (or without ``prefix``) are skipped.
    """

    def pick(names: list[str]) -> Column:
        own = [strip(F.col(c)) for c in names if c in df.columns]
        return first_present(*own) if own else F.lit(None).cast("string")

    one = lambda c, default="": F.coalesce(pick([c]), F.lit(default))
    rows = df.withColumn("_id", strip(F.col(id_col))).where(F.col("_id") != "")
    if prefix:
        rows = rows.where(F.col("_id").startswith(prefix))
    depth = depth_of(F.col("depth"), strict=strict_depth) if "depth" in df.columns else F.lit(999)
    return rows.select(F.col("_id").alias("hpo_id"), F.coalesce(pick(ALIASES["name_ja"]), F.lit("")).alias("name_ja"), one("name_en").alias("name_en"), F.coalesce(pick(ALIASES["category"]), F.lit(default_category)).alias("category"), F.coalesce(pick(ALIASES["definition"]), F.lit("")).alias("definition"), one("source", default_source).alias("source"), depth.alias("depth"), "seq")


def read_log(spark: SparkSession, path: str | list[str], value_keys: list[str], id_keys: list[str] | None = None) -> DataFrame:
    """``hpo_id``, ``value``, ``seq`` of an append log, the last line per id; blank values are ignored."""
    from shirabe.operators.dedupe import last_wins

    rows = read_jsonl(spark, path).select(json_text("v", *(id_keys or ALIASES["hpo_id"])).alias("hpo_id"), strip(json_text("v", *value_keys)).alias("value"), "seq")
    return last_wins(rows.where((F.col("hpo_id") != "") & (F.col("value") != "")), ["hpo_id"])


def read_dictionary(spark: SparkSession, path: str | list[str], text_key: str = "text", id_key: str = "hpo_id", label_key: str = "hpo_label") -> DataFrame:
    """``hpo_id``, ``expr``, ``label``, ``seq``; the label is the first one of the id that is not blank."""
    rows = read_jsonl(spark, path).select(F.coalesce(json_text("v", id_key, *ALIASES["hpo_id"]), F.lit("")).alias("hpo_id"), strip(json_text("v", text_key)).alias("expr"), json_text("v", label_key).alias("_label"), "seq").where(F.col("expr") != "")
    labels = rows.where(strip(F.col("_label")) != "").groupBy("hpo_id").agg(F.min_by("_label", "seq").alias("label"))
    return rows.drop("_label").join(labels, "hpo_id", "left").withColumn("label", F.coalesce("label", F.lit("")))


def read_texts(spark: SparkSession, path: str | list[str], key: str) -> DataFrame:
    """``text``, ``seq``: the value of one key of each JSON line, trimmed; blank values are skipped."""
    return read_jsonl(spark, path).select(strip(json_text("v", key)).alias("text"), "seq").where(F.col("text") != "")


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """``v``, ``seq``, ``round``: JSON lines of files named ``round_<key>.jsonl``, the key as text."""
    return read_jsonl(spark, path).withColumn("round", F.regexp_extract("file", r"round_([^/]*?)\.jsonl?$", 1)).drop("file")


def read_obo(spark: SparkSession, path: str | list[str], terms_only: bool = True, drop_obsolete: bool = False, greedy_quote: bool = False) -> DataFrame:
    """``id``, ``name``, ``definition``, ``synonyms``, ``parents``, ``obsolete``, ``seq`` of an OBO file's stanzas.

    One parser for all uses: ``terms_only`` leaves out typedefs, ``greedy_quote`` ends a definition at
    the last quote of its line instead of the next unescaped one; modifiers in braces and comments
    never become part of a parent id.  A stanza begins at its header line, whatever stands before
    it, and ends at a blank line or the next header; line ends may be those of any system.
    """
    stanza = with_seq(spark.read.text(path, lineSep="\n[")).select(F.regexp_replace("value", r"\r\n?", "\n").alias("s"), "seq")
    stanza = stanza.where(F.col("s").rlike(r"^\[?\w+\]")).withColumn("s", F.regexp_replace("s", r"(?s)\n[ \t]*\n.*", ""))
    if terms_only:
        stanza = stanza.where(F.col("s").rlike(r"^\[?Term\]"))

    def line(key: str, body: str = r"(.*)") -> Column:
        return F.regexp_extract("s", rf"(?m)^{key}:[ \t]*{body}$", 1)

    quoted = r'"(.*)".*' if greedy_quote else r'"((?:[^"\\]|\\.)*)".*'
    out = stanza.select(
        strip(F.regexp_extract("s", r"(?m)^id:[ \t]*(\S+)", 1)).alias("id"), strip(line("name")).alias("name"),
        F.regexp_replace(line("def", quoted), r"\\(.)", "$1").alias("definition"),
        F.regexp_extract_all("s", F.lit(r'(?m)^synonym:[ \t]*"((?:[^"\\]|\\.)*)"'), F.lit(1)).alias("synonyms"),
        F.array_distinct(F.regexp_extract_all("s", F.lit(r"(?m)^is_a:[ \t]*([^\s!{]+)"), F.lit(1))).alias("parents"),
        (strip(line("is_obsolete")) == "true").alias("obsolete"), "seq").where(F.col("id") != "")
    return out.where(~F.col("obsolete")) if drop_obsolete else out


def read_gold(df: DataFrame, case: str, ids: str) -> DataFrame:
    """``case``, ``term`` from packed ids, the last row per case; a case without ids has one null term."""
    from shirabe.operators.dedupe import last_wins

    rows = last_wins(df.where(F.col(case).isNotNull()), [case])
    parts = F.array_distinct(F.filter(F.split(F.coalesce(F.col(ids), F.lit("")), r"(?U)\s+"), lambda x: x != ""))
    return rows.select(F.col(case).alias("case"), F.explode_outer(parts).alias("term"))


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``case``, ``term``, ``score``, ``status``, ``seq`` of annotated texts, the last line per case."""
    from shirabe.operators.dedupe import last_wins

    rows = last_wins(read_jsonl(spark, path).select(json_text("v", "input_id").alias("case"), "v", "seq").where(F.col("case") != ""), ["case"])
    items = F.from_json(F.try_variant_get("v", "$.annotations", "string"), "array<struct<hpo_id:string,score:double,status:string>>")
    one = rows.select("case", F.posexplode(items).alias("pos", "a"))
    return one.select("case", F.col("a.hpo_id").alias("term"), F.coalesce("a.score", F.lit(0.0)).alias("score"), F.coalesce("a.status", F.lit("present")).alias("status"), F.col("pos").alias("seq")).where(F.coalesce("term", F.lit("")) != "")


def read_chat(spark: SparkSession, path: str | list[str], validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid chat rows (``messages``, ``output``, ``seq``) and the count of bad lines.

    Without ``validate`` every line that is a JSON object counts as it is.
    """
    from shirabe.functions.chat import MESSAGES

    rows = with_seq(spark.read.text(path)).where(strip(F.col("value")) != "").select(F.from_json("value", f"messages {MESSAGES}, output string").alias("j"), F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)).alias("ok"), "seq")
    good = F.coalesce(F.size("j.messages") > 0, F.lit(False)) & F.col("j.output").rlike(r"(?U)\S") if validate else F.col("ok")
    ok = rows.where(good).select("j.messages", "j.output", "seq")
    return ok, rows.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"))


def read_instructions(spark: SparkSession, path: str | list[str], most: int | None = None) -> DataFrame:
    """``text_input``, ``output``, ``seq``: instruction and input joined by a blank line, blank outputs dropped.

    With ``most`` only the first lines count, blank and broken ones among them.
    """
    rows = read_jsonl(spark, path)
    if most is not None:
        last = with_seq(spark.read.text(path)).select("seq").orderBy("seq").limit(most).agg(F.max("seq").alias("_last"))
        rows = rows.join(F.broadcast(last), F.col("seq") <= F.col("_last"))  # one row
    text = lambda k: strip(F.coalesce(json_text("v", k), F.lit("")))
    both = F.concat_ws("\n\n", F.when(text("instruction") != "", text("instruction")), F.when(text("input") != "", text("input")))
    return rows.select(both.alias("text_input"), text("output").alias("output"), "seq").where(F.col("output") != "")


def union_tagged(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of all parts, each with its name in ``tag``; columns by name, missing ones null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that there are, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])
