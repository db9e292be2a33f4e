"""Queries that write tables in every supported form, read them back, and show what came back."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions import chat, text
from shirabe.operators import aggregate, evaluation, graph
from shirabe.plans import sql
from shirabe.session import shared_path
from shirabe.sources import formats, readers, writers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(own: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if own:
            ORACLE[fn.__name__] = own
        return fn

    return keep


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _json(df: DataFrame, path: str, order: str) -> str:
    """One column of JSON texts, in files whose names and lines keep the order."""
    df.orderBy(order).select("line").write.text(path)
    return path


@query("SELECT CAST(seq AS VARCHAR) AS seq, nullif(hpo_id, '') AS hpo_id, nullif(name_en, '') AS name_en, nullif(jp_final, '') AS jp_final, nullif(depth, '') AS depth FROM hpo_master")
def io_csv(spark, sf):
    path = shared_path(spark, "csv")
    rows = _t(spark, sf, "hpo_master").select(F.col("seq").alias("no"), "hpo_id", "name_en", "jp_final", "depth")
    writers.write_csv(rows.where("no % 2 = 0"), f"{path}/a")
    writers.write_csv(rows.where("no % 2 = 1"), f"{path}/b", bom=True)
    back = readers.read_csv(spark, [f"{path}/a", f"{path}/b"], required=["hpo_id"], multi_line=True)
    return back.select(F.col("no").alias("seq"), "hpo_id", "name_en", "jp_final", "depth")


@query(f"""
SELECT trim(hpo_id) AS hpo_id, coalesce(nullif(trim(jp_final), ''), nullif(trim(jp_label), ''), '') AS name_ja, coalesce(nullif(trim(name_en), ''), '') AS name_en,
 coalesce(nullif(trim(category_v2), ''), nullif(trim(category), ''), 'Unknown') AS category, coalesce(nullif(trim(definition_ja), ''), nullif(trim(definition), ''), '') AS definition,
 coalesce(nullif(trim(source), ''), 'master') AS source, coalesce(CAST(trunc(TRY_CAST({sql.strip('depth')} AS DOUBLE)) AS INTEGER), 999) AS depth FROM hpo_master WHERE trim(hpo_id) <> '' AND trim(hpo_id) LIKE 'HP:%'
""")
def io_ontology(spark, sf):
    path = shared_path(spark, "items")
    rows = _t(spark, sf, "hpo_master").select(F.col("hpo_id").alias("HPO_ID"), "jp_final", "jp_label", "name_en", "category_v2", "category", "definition_ja", "definition", "source", "depth")
    writers.write_csv(rows, path, bom=True)
    items = readers.ontology_items(readers.read_csv(spark, path, required=["HPO_ID"], multi_line=True), prefix="HP:", default_source="master")
    return items.drop("seq")


_ALIASED = """
WITH r AS (SELECT *, CASE WHEN seq % 3 = 1 THEN 'doctor' ELSE 'patient' END AS kind FROM expr_records),
c AS (SELECT hpo_id, CASE WHEN kind = 'patient' THEN {patient} ELSE {doctor} END AS expr, coalesce(score, 0.0) AS score, kind AS mode FROM r)
SELECT hpo_id, expr, score, mode FROM c WHERE coalesce(hpo_id, '') <> '' AND expr <> ''
"""


@query(_ALIASED.format(patient=sql.clean_expression("expr", "patient"), doctor=sql.clean_expression("expr", "doctor")))
def io_expressions(spark, sf):
    kind = F.when(F.col("seq") % 3 == 1, "doctor").otherwise("patient")
    one = F.to_json(F.struct(F.col("hpo_id").alias("HPO_ID"), F.col("expr").alias("patient_expression_final"), F.col("score").alias("judge_overall"), kind.alias("mode")))
    two = F.to_json(F.struct("hpo_id", "expr", F.struct(F.col("score").alias("overall")).alias("judge"), kind.alias("mode")))
    three = F.to_json(F.struct("hpo_id", F.col("expr").alias("text"), "score", F.concat(F.lit("from_"), kind).alias("source")))
    rows = _t(spark, sf, "expr_records").select("seq", F.when(F.col("seq") % 3 == 0, one).when(F.col("seq") % 3 == 1, two).otherwise(three).alias("line"))
    broken = rows.select("seq", F.lit('{"hpo_id": "x", "expr": ').alias("line")).limit(3)
    path = _json(rows.unionByName(broken), shared_path(spark, "expressions"), "seq")
    return readers.read_expressions(spark, path, "mixed").select("hpo_id", "expr", "score", "mode")


@query(f"SELECT {sql.strip('expr')} AS text, count(*) AS n FROM expr_records WHERE {sql.some('expr')} GROUP BY 1")
def io_texts(spark, sf):
    rows = _t(spark, sf, "expr_records").select("seq", F.to_json(F.struct("expr", "score")).alias("line"))
    path = _json(rows, shared_path(spark, "texts"), "seq")
    return readers.read_texts(spark, path, "expr").groupBy("text").agg(F.count("*").alias("n"))


@query(f"SELECT {sql.strip('ref_label')} AS text FROM label_ref WHERE {sql.some('ref_label')}")
def io_lines(spark, sf):
    path = shared_path(spark, "lines")
    rows = _t(spark, sf, "label_ref").select(F.concat(F.lit("  "), "ref_label", F.lit("　")).alias("value"))
    rows.unionByName(rows.limit(2).select(F.lit(" ").alias("value"))).write.text(path)
    return readers.read_lines(spark, path).select("text")


@query("""
WITH r AS (SELECT seq, coalesce(nullif(hpo_id, ''), '') AS hpo_id, trim(expr) AS expr, nullif(hpo_label, '') AS label FROM expr_records WHERE trim(coalesce(nullif(expr, ''), '')) <> ''),
l AS (SELECT hpo_id, arg_min(label, seq) AS label FROM r WHERE trim(label) <> '' GROUP BY 1)
SELECT r.hpo_id, r.expr, coalesce(l.label, '') AS label FROM r LEFT JOIN l ON r.hpo_id = l.hpo_id
""")
def io_dictionary(spark, sf):
    rows = _t(spark, sf, "expr_records").select("seq", F.to_json(F.struct("hpo_id", F.col("expr").alias("text"), "hpo_label")).alias("line"))
    path = _json(rows, shared_path(spark, "dictionary"), "seq")
    return readers.read_dictionary(spark, path).select("hpo_id", "expr", "label")


@query("SELECT hpo_id, arg_max(trim(jp_final), seq) AS value FROM label_fill WHERE coalesce(hpo_id, '') <> '' AND trim(coalesce(jp_final, '')) <> '' GROUP BY 1")
def io_log(spark, sf):
    path = shared_path(spark, "log")
    rows = _t(spark, sf, "label_fill").select("seq", "hpo_id", "jp_final")
    top = rows.agg(F.max("seq")).first()[0] or 0
    for part, (lo, hi) in enumerate([(0, top // 2), (top // 2, top)]):
        writers.append_log(rows.where((F.col("seq") > lo) & (F.col("seq") <= hi)).orderBy("seq").select("hpo_id", "jp_final"), f"{path}/{part}")
    return readers.read_log(spark, [f"{path}/0", f"{path}/1"], ["jp_final"]).select("hpo_id", "value")


_LAST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hpo_id ORDER BY seq DESC) AS r FROM hpo_master WHERE regexp_full_match(hpo_id, '[A-Za-z0-9:_]+')) WHERE r = 1"


def _obo(spark, sf, windows: bool) -> str:
    last = _t(spark, sf, "hpo_master").where(F.col("hpo_id").rlike("^[A-Za-z0-9:_]+$")).groupBy("hpo_id").agg(F.max_by(F.struct("name_en", "definition", "parents"), "seq").alias("m")).select("hpo_id", "m.*")
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\r\n"\\]', ""))
    up = F.transform(F.filter(F.split(F.coalesce("parents", F.lit("")), r"\|"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("is_a: "), x, F.lit(' {source="x"} ! parent')))
    end = "\r" if windows else ""
    lines = F.concat_ws(f"{end}\n", F.lit("[Term]"), F.concat(F.lit("id: "), "hpo_id"), F.concat(F.lit("name: "), clean(F.col("name_en"))), F.concat(F.lit('def: "'), clean(F.col("definition")), F.lit('" [x:1]')), up)
    path = shared_path(spark, "obo")
    # no blank line between the stanzas
    last.select(F.concat(lines, F.lit(end)).alias("value")).write.text(path)
    return path


@query(f"SELECT hpo_id AS id, trim(regexp_replace(coalesce(name_en, ''), '[\\r\\n\"\\\\]', '', 'g')) AS name, trim(regexp_replace(coalesce(definition, ''), '[\\r\\n\"\\\\]', '', 'g')) AS definition, CAST(len(list_distinct(list_filter(string_split(coalesce(parents, ''), '|'), lambda x: trim(x) <> ''))) AS INTEGER) AS n_parents FROM ({_LAST})")
def io_obo(spark, sf):
    return readers.read_obo(spark, _obo(spark, sf, True)).select("id", "name", "definition", F.size("parents").alias("n_parents"))


@query(f"""
WITH RECURSIVE m AS ({_LAST}), e AS (SELECT DISTINCT hpo_id AS child, parent FROM (SELECT hpo_id, unnest(string_split(coalesce(parents, ''), '|')) AS parent FROM m) WHERE trim(parent) <> ''),
c AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON c.ancestor = e.child) SELECT node, count(*) AS n_above FROM c GROUP BY 1
""")
def io_obo_closure(spark, sf):
    rows = readers.read_obo(spark, _obo(spark, sf, False), terms_only=False, greedy_quote=True)
    return graph.closure(graph.edges(rows, "id", F.col("parents"))).groupBy("node").agg(F.count("*").alias("n_above"))


@query(f"SELECT case_no AS \"case\", CAST(len(list_distinct(list_filter(regexp_split_to_array(coalesce(hpo_ids, ''), '{sql.SPACE}+'), lambda x: x <> ''))) AS BIGINT) AS n_terms FROM eval_cases WHERE case_no IS NOT NULL")
def io_gold(spark, sf):
    gold = readers.read_gold(_t(spark, sf, "eval_cases").select("case_no", "hpo_ids", F.col("case_no").alias("seq")), "case_no", "hpo_ids")
    return gold.groupBy("case").agg(F.count("term").alias("n_terms"))


@query("""
WITH p AS (SELECT CAST(l_orderkey AS VARCHAR) AS c, CAST(l_partkey AS VARCHAR) AS t, l_quantity AS s, CASE WHEN l_linenumber % 4 = 0 THEN 'absent' ELSE 'present' END AS st,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
r AS (SELECT c, t, row_number() OVER (PARTITION BY c ORDER BY s DESC, pos) AS rank FROM p WHERE st = 'present') SELECT c AS "case", t AS term, CAST(rank AS INTEGER) AS rank FROM r
""")
def io_predictions(spark, sf):
    items = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))).alias("x"))
    made = F.transform("x", lambda i: F.struct(i["l_partkey"].cast("string").alias("hpo_id"), i["l_quantity"].cast("double").alias("score"), F.when(i["l_linenumber"] % 4 == 0, "absent").when(i["l_linenumber"] % 4 == 1, "present").alias("status")))
    line = lambda arr: F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("input_id"), arr.alias("annotations")))
    stale = items.select((F.col("l_orderkey") * 2).alias("at"), line(F.slice(made, 1, 1)).alias("line"))
    rows = stale.unionByName(items.select((F.col("l_orderkey") * 2 + 1).alias("at"), line(made).alias("line")))
    path = _json(rows, shared_path(spark, "predictions"), "at")
    return evaluation.ranked(readers.read_predictions(spark, path), "case", "term", "score", statuses=("status", "present"))


_GOOD = f"messages IS NOT NULL AND len(messages) > 0 AND {sql.some('output')}"


@query(f"SELECT count(*) FILTER ({_GOOD}) AS good, count(*) FILTER (NOT coalesce({_GOOD}, FALSE)) + 2 AS bad, (SELECT count(*) FROM sft_rows) AS unchecked FROM sft_rows")
def io_chat(spark, sf):
    path = shared_path(spark, "chat")
    rows = _t(spark, sf, "sft_rows").select(F.to_json(F.struct("messages", "output")).alias("value"))
    rows.unionByName(spark.createDataFrame([("{broken",), ("[1]",)], "value string")).write.text(path)
    ok, bad = readers.read_chat(spark, path)
    plain, _ = readers.read_chat(spark, path, validate=False)
    return ok.agg(F.count("*").alias("good")).join(bad).join(plain.agg(F.count("*").alias("unchecked")))


@query("SELECT CASE WHEN messages IS NULL THEN 'missing_key' ELSE 'ok' END AS kind, count(*) AS n FROM sft_rows GROUP BY 1 UNION ALL SELECT 'bad_json', 1 UNION ALL SELECT 'bad_type', 1 UNION ALL SELECT 'bad_messages', 1")
def io_line_quality(spark, sf):
    rows = _t(spark, sf, "sft_rows").select(F.to_json(F.struct("messages", F.coalesce("output", F.lit("")).alias("output"))).alias("line"))
    odd = spark.createDataFrame([("{broken",), ("[1]",), ('{"messages": 3, "output": ""}',)], "line string")
    return aggregate.quality_of_lines(rows.unionByName(odd), "line")


@query("""
WITH r AS (SELECT trim(coalesce(hpo_id, '')) AS i, trim(coalesce(standard_name, '')) AS n, trim(coalesce(output, '')) AS o FROM sft_rows)
SELECT CASE WHEN i <> '' AND n <> '' THEN i || chr(10) || chr(10) || n ELSE i || n END AS text_input, o AS output FROM r WHERE o <> ''
""")
def io_instructions(spark, sf):
    rows = _t(spark, sf, "sft_rows").select("seq", F.to_json(F.struct(F.col("hpo_id").alias("instruction"), F.col("standard_name").alias("input"), "output")).alias("line"))
    return readers.read_instructions(spark, _json(rows, shared_path(spark, "instructions"), "seq")).select("text_input", "output")


@query("""
WITH m AS (SELECT seq, list_filter(messages, lambda x: coalesce(x.content, '') <> '') AS m FROM sft_rows WHERE messages IS NOT NULL AND len(messages) > 0 AND regexp_matches(output, '[^\\s\\x{3000}\\x{a0}]'))
SELECT trim(array_to_string(list_transform(m, lambda x: coalesce(x.role, 'user') || ': ' || x.content), chr(10))) AS text_input, count(*) AS n FROM m GROUP BY 1
""")
def io_chat_pairs(spark, sf):
    whole = F.concat("messages", F.array(chat.message("assistant", F.coalesce("output", F.lit("")))))
    rows = _t(spark, sf, "sft_rows").where(F.col("messages").isNotNull()).select("seq", F.to_json(F.struct(whole.alias("messages"), "output")).alias("line"))
    ok, _ = readers.read_chat(spark, _json(rows, shared_path(spark, "pairs"), "seq"))
    return ok.where(F.size("messages") > 1).select(chat.flatten(F.col("messages")).alias("f")).groupBy("f.text_input").agg(F.count("*").alias("n"))


@query("SELECT coalesce(CAST(TRY_CAST(TRY_CAST(depth AS DOUBLE) AS BIGINT) AS VARCHAR), 'unknown') AS round, count(*) AS n FROM hpo_master GROUP BY 1")
def io_rounds(spark, sf):
    path = shared_path(spark, "rounds")
    writers.write_by_round(_t(spark, sf, "hpo_master").select("seq", "hpo_id", "depth"), path, F.col("depth"))
    return readers.read_jsonl(spark, f"{path}/*").select(F.regexp_extract("file", "round_key=([^/]+)/", 1).alias("round")).groupBy("round").agg(F.count("*").alias("n"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN score < 2 THEN 'low' WHEN score IS NULL THEN 'none' END AS reason FROM expr_records) WHERE reason IS NOT NULL GROUP BY 1")
def io_removed(spark, sf):
    path = shared_path(spark, "removed")
    rows = _t(spark, sf, "expr_records").withColumn("reason", F.when(F.col("score") < 2, "low").when(F.col("score").isNull(), "none"))
    if not writers.write_removed(rows, path):
        return rows.where("false").groupBy("reason").agg(F.count("*").alias("n"))
    return readers.read_jsonl(spark, path).select(readers.json_text("v", "reason").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT master_row, CAST(row_number() OVER (ORDER BY master_row) AS BIGINT) - 1 AS place FROM expression_master WHERE coalesce(len(patient_expressions), 0) + coalesce(len(doctor_expressions), 0) > 0")
def io_master(spark, sf):
    from shirabe.operators.dedupe import with_index

    path = shared_path(spark, "master")
    writers.write_master(_t(spark, sf, "expression_master").select("master_row", "patient_expressions", "doctor_expressions"), path, "master_row")
    back = readers.with_seq(spark.read.text(path)).select(F.get_json_object("value", "$.master_row").cast("bigint").alias("master_row"), "seq")
    return with_index(back, ["seq"], "place").select("master_row", "place")


@query("SELECT CAST(seq AS VARCHAR) AS \"index\", nullif(translate(expr, chr(9) || chr(10) || chr(13), '   '), '') AS text FROM expr_records WHERE expr IS NOT NULL")
def io_index_map(spark, sf):
    path = shared_path(spark, "index")
    writers.write_index_map(_t(spark, sf, "expr_records").where(F.col("expr").isNotNull()), path, "seq", "expr")
    return spark.read.options(header=True, sep="\t", escape='"').schema("index string, text string").csv(path)


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS energy FROM embeddings")
def io_npy(spark, sf):
    from shirabe.operators.vector import dot

    formats.register(spark)
    path = shared_path(spark, "npy") + ".npy"
    rows = _t(spark, sf, "embeddings")
    writers.write_npy(rows.select("vec_id", "embedding"), path.removeprefix("file://"), "vec_id", "embedding")
    vectors = spark.read.format("npy").option("rows", 1000).load(path)
    from shirabe.operators.dedupe import with_index

    ids = with_index(rows.select("vec_id"), ["vec_id"], "row_idx")
    return formats.with_vectors(ids, vectors).select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 4).alias("energy"))


@query("SELECT ref_id, ref_label, ref_kana FROM label_ref")
def io_xlsx(spark, sf):
    formats.register(spark)
    path = shared_path(spark, "xlsx") + ".xlsx"
    rows = [("ref_id", "ref_label", "ref_kana"), *map(tuple, _t(spark, sf, "label_ref").select("ref_id", "ref_label", "ref_kana").collect())]  # a workbook is small and made on the driver
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda c, r, v: "" if v is None else f'<c r="{c}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    body = "".join(f'<row r="{i}">{"".join(cell(c, i, v) for c, v in zip("ABC", row))}</row>' for i, row in enumerate(rows, 1))
    with zipfile.ZipFile(path.removeprefix("file://"), "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
    return spark.read.format("xlsx").load(path).drop("seq")


@query("SELECT metric, value FROM (SELECT unnest(['n', 'mean', 'longest']) AS metric, unnest([CAST(count(*) AS DOUBLE), round(avg(length(expr)), 6), CAST(max(length(expr)) AS DOUBLE)]) AS value FROM expr_records WHERE expr IS NOT NULL)")
def io_metrics(spark, sf):
    path = shared_path(spark, "metrics")
    wide = _t(spark, sf, "expr_records").where(F.col("expr").isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(F.length("expr")), 6).alias("mean"), F.max(F.length("expr")).alias("longest"))
    writers.write_csv(aggregate.unpivot_metrics(wide, ["n", "mean", "longest"]), path, sep="\t")
    return spark.read.options(header=True, sep="\t").schema("metric string, value double").csv(path)


@query("SELECT mode, count(*) AS n FROM expr_records GROUP BY 1")
def io_shards(spark, sf):
    path = shared_path(spark, "shards")
    rows = _t(spark, sf, "expr_records").select("seq", "mode")
    for k in range(3):
        writers.write_jsonl(rows.where(F.col("seq") % 3 == k), f"{path}/{k}")
    return writers.read_shards(spark, [f"{path}/{k}" for k in range(3)]).groupBy("mode").agg(F.count("*").alias("n"))


@query(f"SELECT seq, CAST(length({sql.strip('coalesce(jp_final, chr(32))')}) AS INTEGER) AS n FROM label_fill ORDER BY seq LIMIT 25")
def io_head(spark, sf):
    """The first rows in order: the feature is the limit."""
    return _t(spark, sf, "label_fill").orderBy("seq").limit(25).select("seq", F.length(text.strip(F.coalesce("jp_final", F.lit(" ")))).alias("n"))
