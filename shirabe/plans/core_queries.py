"""Registered queries of the relational, vector, graph, span and evaluation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions import chat, judge, text
from shirabe.operators import aggregate, dedupe, evaluation, graph, joins, similarity, spans, vector
from shirabe.operators.annotate import annotate
from shirabe.plans import packed_queries, pipelines, sql
from shirabe.sources import readers
from shirabe.streaming.annotate import event_counts, last_by_key

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _key(col):
    return text.no_spaces(col)


# --- duplicates, winners, shards -------------------------------------------------------------

_DUP = """
WITH d AS (SELECT doc_id, source, n_chars, replace(replace(text, ' ', ''), '　', '') AS t, CAST(n_chars % 7 AS DOUBLE) AS score FROM documents),
m AS (SELECT t FROM d WHERE t IS NOT NULL GROUP BY t HAVING count(DISTINCT source) > 1),
w AS (SELECT d.doc_id, row_number() OVER (PARTITION BY d.t ORDER BY {order}, d.doc_id) AS r FROM d JOIN m ON d.t = m.t)
SELECT d.doc_id, CASE WHEN w.doc_id IS NOT NULL AND {gone} THEN '{name}' END AS reason FROM d LEFT JOIN w ON d.doc_id = w.doc_id
"""


def _dup(policy: str, order: str):
    name = "cross_hpo_duplicate" + ("" if policy == "drop_all" else f"_{policy}")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _t(spark, sf, "documents").select("doc_id", "source", "n_chars", _key(F.col("text")).alias("t"), (F.col("n_chars") % 7).cast("double").alias("score"))
        return dedupe.cross_group_duplicates(rows, "source", "t", policy, "n_chars", "score", "doc_id").select("doc_id", "reason")

    run.__name__ = f"dup_{policy}"
    query(_DUP.format(order=order, gone="TRUE" if policy == "drop_all" else "w.r > 1", name=name))(run)


for _policy, _order in {"drop_all": "d.doc_id", "keep_shallow": "d.n_chars", "keep_deep": "d.n_chars DESC", "keep_best_score": "d.score DESC"}.items():
    _dup(_policy, _order)


@query("SELECT hpo_id, seq, jp_final FROM (SELECT *, row_number() OVER (PARTITION BY hpo_id ORDER BY seq DESC) AS r FROM hpo_master) WHERE r = 1")
def last_wins(spark, sf):
    return dedupe.last_wins(_t(spark, sf, "hpo_master").select("hpo_id", "seq", "jp_final"), ["hpo_id"]).select("hpo_id", "seq", "jp_final")


@query("SELECT hpo_id, seq, jp_final FROM (SELECT *, row_number() OVER (PARTITION BY hpo_id ORDER BY seq) AS r FROM label_fill WHERE regexp_matches(jp_final, '[^\\s\\x{3000}\\x{a0}]')) WHERE r = 1")
def first_wins(spark, sf):
    return dedupe.first_wins(_t(spark, sf, "label_fill").select("hpo_id", "seq", "jp_final"), ["hpo_id"], skip_blank="jp_final").select("hpo_id", "seq", "jp_final")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_custkey IS NOT NULL) WHERE r <= 3")
def stratified_cap(spark, sf):
    return dedupe.capped(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 3, "o_orderkey")


@query("SELECT seq, standard_name FROM (SELECT *, row_number() OVER (PARTITION BY standard_name ORDER BY md5('42:' || seq), seq) AS r FROM sft_rows WHERE standard_name IS NOT NULL) WHERE r <= 2")
def stratified_cap_seeded(spark, sf):
    return dedupe.capped(_t(spark, sf, "sft_rows").select("seq", "standard_name"), "standard_name", 2, "seq", seed=42)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 10 = 3")
def shard_mod(spark, sf):
    return dedupe.shard(_t(spark, sf, "documents").select("doc_id"), ["doc_id"], 10, 3)


# --- filters and predicates ------------------------------------------------------------------


@query("SELECT seq FROM expr_records WHERE replace(replace(coalesce(expr, ''), ' ', ''), '　', '') <> '' AND replace(replace(coalesce(hpo_label, ''), ' ', ''), '　', '') <> replace(replace(expr, ' ', ''), '　', '')")
def not_same_as_label(spark, sf):
    rows = _t(spark, sf, "expr_records")
    e, n = _key(text.safe_str(F.col("expr"))), _key(text.safe_str(F.col("hpo_label")))
    return rows.where((e != "") & (e != n)).select("seq")


@query("""
WITH r AS (SELECT *, TRY_CAST(trim(depth) AS DOUBLE) AS d FROM hpo_master)
SELECT seq, hpo_id FROM r WHERE d >= 3 AND self_reportable = '1'
""")
def depth_filter(spark, sf):
    rows = _t(spark, sf, "hpo_master")
    deep = text.strip(F.col("depth")).try_cast("double")
    return rows.where((deep >= 3) & (F.col("self_reportable") == "1")).select("seq", "hpo_id")


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS cleared FROM (SELECT CASE WHEN NOT (contains(jp_final, 'シェアする') OR contains(jp_final, '広告を')) THEN jp_final END AS v FROM label_fill)")
def noise_null(spark, sf):
    rows = _t(spark, sf, "label_fill").select(text.clear_noise(F.col("jp_final"), ["シェアする", "広告を"]).alias("v"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("v").isNull().cast("bigint")).alias("cleared"))


@query("SELECT o_orderkey FROM orders WHERE trim(o_orderpriority) IN ('1-URGENT', '2-HIGH') AND (o_orderstatus LIKE 'F%' OR o_orderstatus LIKE 'P%')")
def trust_and_prefix(spark, sf):
    rows = _t(spark, sf, "orders")
    prefix = F.col("o_orderstatus").startswith("F") | F.col("o_orderstatus").startswith("P")
    return rows.where(F.trim("o_orderpriority").isin("1-URGENT", "2-HIGH") & prefix).select("o_orderkey")


@query("""
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN event_id % 21 = 20 THEN 0 ELSE CAST((event_id % 21 + 1) AS INTEGER) END AS bucket FROM events) GROUP BY bucket
""")
def frequency_bucket(spark, sf):
    i = F.col("event_id") % 21
    word = F.when(i == 20, F.lit(" 出現なし ")).otherwise(F.concat((i * 5).cast("string"), F.lit("-"), (i * 5 + 5).cast("string"), F.lit("%")))
    return _t(spark, sf, "events").select(text.frequency_rank(word).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT seq, coalesce(output, '') AS e, coalesce(standard_name, '') AS n FROM sft_rows)
SELECT seq FROM r WHERE n <> '' AND e <> '' AND e <> n AND NOT contains(e, n) AND length(e) BETWEEN 2 AND 40
AND NOT (length(e) <= 6 AND regexp_matches(e, '(症|炎|障害|癌|腫瘍|腫瘤|病)$'))
AND NOT regexp_matches(e, 'ヘルニア|症候群|再発|手術|術|切除|腫瘍|腫瘤|癌|がん|悪性|良性|既往|合併症|検査|治療')
AND NOT (e LIKE '%です' OR e LIKE '%ます')
""")
def rule_cascade(spark, sf):
    return _t(spark, sf, "sft_rows").where(text.everyday(F.col("output"), F.col("standard_name"), 40)).select("seq")


# --- joins -----------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT hpo_id AS id, jp_label, category FROM (SELECT *, row_number() OVER (PARTITION BY hpo_id ORDER BY seq DESC) AS r FROM hpo_master WHERE hpo_id IS NOT NULL) WHERE r = 1)
SELECT e.seq, coalesce(l.jp_label, '') AS jp_label, l.category FROM expr_records e LEFT JOIN l ON e.hpo_id = l.id
""")
def enrich_records(spark, sf):
    rows = _t(spark, sf, "expr_records").select("seq", "hpo_id")
    return joins.enrich(rows, _t(spark, sf, "hpo_master"), "hpo_id", "hpo_id", {"jp_label": F.lit(""), "category": None}).select("seq", "jp_label", "category")


@query("""
WITH p AS (SELECT hpo_id AS id, arg_max(jp_final, seq) AS v FROM label_fill WHERE jp_final IS NOT NULL AND hpo_id IS NOT NULL GROUP BY 1)
SELECT m.seq, m.hpo_id, coalesce(p.v, m.jp_final) AS jp_final FROM hpo_master m LEFT JOIN p ON m.hpo_id = p.id
""")
def update_join(spark, sf):
    patch = dedupe.last_wins(_t(spark, sf, "label_fill").where(F.col("jp_final").isNotNull() & F.col("hpo_id").isNotNull()).select("hpo_id", "seq", "jp_final"), ["hpo_id"])
    return joins.update_columns(_t(spark, sf, "hpo_master").select("seq", "hpo_id", "jp_final"), patch, "hpo_id", ["jp_final"])


@query("""
WITH c AS (SELECT DISTINCT hpo_id AS id FROM label_fill WHERE regexp_matches(jp_final, '[^\\s\\x{3000}\\x{a0}]') AND hpo_id IS NOT NULL)
SELECT seq, hpo_id FROM hpo_master m WHERE NOT coalesce(regexp_matches(jp_final, '[^\\s\\x{3000}\\x{a0}]'), FALSE) AND NOT EXISTS (SELECT 1 FROM c WHERE c.id = m.hpo_id)
""")
def work_list(spark, sf):
    return joins.work_list(_t(spark, sf, "hpo_master").select("seq", "hpo_id", "jp_final"), _t(spark, sf, "label_fill").select("hpo_id", "jp_final"), "hpo_id", "jp_final").select("seq", "hpo_id")


@query("""
WITH c AS (SELECT hpo_id AS id, arg_max(jp_final, seq) AS v FROM label_fill WHERE regexp_matches(jp_final, '[^\\s\\x{3000}\\x{a0}]') AND hpo_id IS NOT NULL GROUP BY 1)
SELECT m.seq, CASE WHEN regexp_matches(m.jp_final, '[^\\s\\x{3000}\\x{a0}]') THEN m.jp_final ELSE coalesce(c.v, '') END AS jp_final FROM hpo_master m LEFT JOIN c ON c.id = m.hpo_id
""")
def fill_from_cache(spark, sf):
    cache = _t(spark, sf, "label_fill").where(F.col("hpo_id").isNotNull()).select("hpo_id", "seq", "jp_final")
    return joins.fill_from_cache(_t(spark, sf, "hpo_master").select("seq", "hpo_id", "jp_final"), cache, "hpo_id", "jp_final").select("seq", "jp_final")


@query("SELECT seq FROM expr_records e WHERE EXISTS (SELECT 1 FROM hpo_master m WHERE m.hpo_id = e.hpo_id)")
def semi_known_ids(spark, sf):
    return joins.only_keys(_t(spark, sf, "expr_records").select("seq", "hpo_id"), _t(spark, sf, "hpo_master"), "hpo_id").select("seq")


@query("""
WITH l AS (SELECT hpo_id, jp_label FROM (SELECT *, row_number() OVER (PARTITION BY hpo_id ORDER BY seq DESC) AS r FROM hpo_master WHERE hpo_id IS NOT NULL) WHERE r = 1 AND regexp_matches(jp_label, '[^\\s\\x{3000}]')),
n AS (SELECT l.hpo_id, l.jp_label AS expr FROM l WHERE EXISTS (SELECT 1 FROM expr_records e WHERE e.hpo_id = l.hpo_id)
  AND NOT EXISTS (SELECT 1 FROM expr_records e WHERE e.hpo_id = l.hpo_id AND replace(replace(e.expr, ' ', ''), '　', '') = replace(replace(l.jp_label, ' ', ''), '　', '')))
SELECT hpo_id, expr, score FROM expr_records UNION ALL SELECT hpo_id, expr, 10.0 FROM n
""")
def official_inject(spark, sf):
    records = _t(spark, sf, "expr_records").select("hpo_id", "expr", "score")
    labels = dedupe.last_wins(_t(spark, sf, "hpo_master").where(F.col("hpo_id").isNotNull()).select("hpo_id", "seq", "jp_label"), ["hpo_id"])
    return joins.inject_official(records, records, labels, "hpo_id", "expr", "jp_label", _key, {"score": F.lit(10.0)})


@query("""
WITH r AS (SELECT hpo_id, mode, trim(coalesce(expr, '')) AS x, seq FROM expr_records WHERE regexp_matches(hpo_id, '[^\\s]') AND mode IN ('patient', 'doctor')),
f AS (SELECT hpo_id, mode, x, min(seq) AS s FROM r WHERE x <> '' GROUP BY 1, 2, 3),
g AS (SELECT hpo_id, coalesce(string_agg(x, '|' ORDER BY s) FILTER (mode = 'patient'), '') AS patient, coalesce(string_agg(x, '|' ORDER BY s) FILTER (mode = 'doctor'), '') AS doctor FROM f GROUP BY 1),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hpo_id ORDER BY seq DESC) AS k FROM hpo_master WHERE regexp_matches(hpo_id, '[^\\s]')) WHERE k = 1)
SELECT g.hpo_id, coalesce(m.name_en, '') AS name_en, coalesce(CAST(TRY_CAST(m.is_leaf AS DOUBLE) AS INTEGER), 0) AS is_leaf, g.patient, g.doctor FROM g LEFT JOIN m ON g.hpo_id = m.hpo_id
""")
def master_build(spark, sf):
    rows = _t(spark, sf, "expr_records").select("hpo_id", "mode", "expr", "seq")
    out = joins.build_master(rows.where(F.col("mode") == "patient"), rows.where(F.col("mode") == "doctor"), _t(spark, sf, "hpo_master"), info=("name_en",))
    return out.select("hpo_id", "name_en", "is_leaf", F.array_join("patient_expressions", "|").alias("patient"), F.array_join("doctor_expressions", "|").alias("doctor"))


@query("SELECT hpo_id, lower(expr) AS final, coalesce(arg_min(expr, seq), '') AS original FROM expr_records WHERE expr <> '' GROUP BY 1, 2")
def back_reference(spark, sf):
    rows = _t(spark, sf, "expr_records").select("hpo_id", F.lower("expr").alias("final"), F.col("expr").alias("original"), "seq")
    return joins.back_reference(rows, "hpo_id", "final", "original")


# --- aggregates ------------------------------------------------------------------------------


@query("SELECT hpo_id, string_agg(expr, '|' ORDER BY s) AS texts FROM (SELECT hpo_id, expr, min(seq) AS s FROM expr_records WHERE expr IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def ordered_collect(spark, sf):
    out = aggregate.ordered_distinct(_t(spark, sf, "expr_records").select("hpo_id", "expr", "seq"), "hpo_id", "expr", out="texts")
    return out.select("hpo_id", F.array_join("texts", "|").alias("texts"))


@query("SELECT source, count(*) AS n FROM expr_records GROUP BY 1")
def counts_by_source(spark, sf):
    return aggregate.counts_by(_t(spark, sf, "expr_records").select("source"), "source")


@query("SELECT hpo_id, CAST(sum(CASE WHEN score >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_good, coalesce(sum(CASE WHEN score >= 4 THEN 1 ELSE 0 END), 0) >= 3 AS finished FROM expr_records GROUP BY 1")
def good_groups(spark, sf):
    return aggregate.good_groups(_t(spark, sf, "expr_records").select("hpo_id", "score"), "hpo_id", F.col("score") >= 4, 3)


@query("SELECT coalesce(CAST(TRY_CAST(TRY_CAST(depth AS DOUBLE) AS BIGINT) AS VARCHAR), 'unknown') AS depth_key, count(*) AS n FROM hpo_master GROUP BY 1")
def partition_counts(spark, sf):
    rows = _t(spark, sf, "hpo_master").select(text.int_key(F.col("depth")).alias("depth_key"))
    return aggregate.counts_by(rows, "depth_key").orderBy(*aggregate.int_then_text("depth_key"))


@query("""
WITH l AS (SELECT CAST(coalesce(length(text), 0) AS DOUBLE) AS n FROM documents)
SELECT count(*) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS least, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3, max(n) AS most FROM l
""")
def text_profile(spark, sf):
    return aggregate.length_profile(_t(spark, sf, "documents").select("text"), "text").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT doc_id, left(regexp_extract(text, '(?s)^([^。]*。?)', 1), 100) AS head FROM documents WHERE text IS NOT NULL")
def truncate_sentence(spark, sf):
    return _t(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", text.first_sentence(F.col("text")).alias("head"))


@query("SELECT round((1 - sum(length(left(regexp_extract(text, '(?s)^([^。]*。?)', 1), 100))) / sum(length(text))) * 100, 6) AS reduction FROM documents")
def reduction_rate(spark, sf):
    return aggregate.reduction_rate(_t(spark, sf, "documents").select("text"), F.col("text"), text.first_sentence(F.col("text"))).select(F.round("reduction", 6).alias("reduction"))


@query("SELECT list_sort(list(length(text)))[CAST(floor(count(text) * 0.95) AS BIGINT) + 1] AS p95 FROM documents WHERE text IS NOT NULL")
def nearest_rank(spark, sf):
    return aggregate.nearest_rank(_t(spark, sf, "documents").select("text"), F.length("text").cast("bigint"), 0.95, "p95")


@query("""
WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events)
SELECT least(CAST(floor((value - a) / ((b - a) / 50)) AS INTEGER), 49) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1
""")
def value_histogram(spark, sf):
    return aggregate.histogram(_t(spark, sf, "events").select("value"), F.col("value")).select("bin", "n")


@query("SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def metric_pivot(spark, sf):
    rows = _t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return aggregate.pivot_metrics(rows, "user_id", "event_type", "value", ["click", "view", "error"])


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return event_counts(_t(spark, sf, "events").select("ts", "event_type"), "ts", "event_type")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def last_event(spark, sf):
    return last_by_key(_t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT origin, count(*) AS n, count(label) AS labelled FROM (SELECT 'fill' AS origin, jp_final AS label FROM label_fill UNION ALL SELECT 'master', jp_final FROM hpo_master) GROUP BY 1")
def union_tagged(spark, sf):
    parts = {"fill": _t(spark, sf, "label_fill").select(F.col("jp_final").alias("label")), "master": _t(spark, sf, "hpo_master").select(F.col("jp_final").alias("label"))}
    return readers.union_tagged(parts, "origin").groupBy("origin").agg(F.count("*").alias("n"), F.count("label").alias("labelled"))


# --- text, chat and verdicts -----------------------------------------------------------------


@query("""
WITH r AS (SELECT seq, output AS o FROM sft_rows WHERE output IS NOT NULL AND output <> '')
SELECT seq, regexp_replace(regexp_replace(trim(o), '^[\\s]+|[\\s]+$', '', 'g'), '[」『』｡]$', '') AS expr FROM r
""")
def clean_expressions(spark, sf):
    rows = _t(spark, sf, "sft_rows").where(F.col("output") != "").select("seq", F.concat(F.lit("患者:  「"), F.col("output"), F.lit("」\nassistant: 次です")).alias("raw"))
    return rows.select("seq", text.clean_expression(F.col("raw"), "patient").alias("expr"))


@query("SELECT seq, regexp_replace(regexp_replace(trim(jp_final), '。$', ''), '\\s+$', '') AS label FROM label_fill WHERE regexp_matches(jp_final, '^[ぁ-んァ-ヶ一-龠A-Za-z 　]+。?$')")
def clean_labels(spark, sf):
    rows = _t(spark, sf, "label_fill").where(F.col("jp_final").rlike("^[ぁ-んァ-ヶ一-龠A-Za-z 　]+。?$"))
    return rows.select("seq", text.clean_label(F.concat(F.lit('- "'), F.trim("jp_final"), F.lit('"\n説明'))).alias("label"))


@query()
def clean_labels_all(spark, sf):
    """Every row of the table; ``clean_labels`` is the part of it that the SQL can follow."""
    return _t(spark, sf, "label_fill").select("seq", text.clean_label(F.col("jp_final")).alias("label"))


@query("SELECT seq, CASE WHEN contains(lower(coalesce(mode, source, '')), 'doctor') THEN 'doctor' WHEN contains(lower(coalesce(mode, source, '')), 'patient') THEN 'patient' ELSE 'mixed' END AS mode FROM expr_records")
def detect_mode(spark, sf):
    return _t(spark, sf, "expr_records").select("seq", text.detect_mode(F.coalesce("mode", "source"), "mixed").alias("mode"))


@query("""
WITH r AS (SELECT seq, output, list_filter(messages, lambda m: coalesce(m.content, '') <> '') AS m FROM sft_rows WHERE messages IS NOT NULL)
SELECT seq, trim(array_to_string(list_transform(m, lambda x: coalesce(x.role, 'user') || ': ' || x.content), chr(10))) AS text_input, trim(coalesce(output, '')) AS output FROM r
""")
def chat_flatten(spark, sf):
    whole = F.concat("messages", F.array(chat.message("assistant", F.coalesce("output", F.lit("")))))
    return _t(spark, sf, "sft_rows").where(F.col("messages").isNotNull()).select("seq", chat.flatten(whole).alias("f")).select("seq", "f.text_input", "f.output")


@query("""
SELECT seq, '<|begin_of_text|>' || array_to_string(list_transform(messages, lambda m: '<|start_header_id|>' || coalesce(m.role, '') || '<|end_header_id|>' || chr(10) || chr(10) || coalesce(m.content, '') || '<|eot_id|>'), '') || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt
FROM sft_rows WHERE messages IS NOT NULL
""")
def chat_template(spark, sf):
    return _t(spark, sf, "sft_rows").where(F.col("messages").isNotNull()).select("seq", chat.render_headers(F.col("messages"), True).alias("prompt"))


@query("SELECT seq, array_to_string(list_transform(messages, lambda m: upper(coalesce(m.role, 'user')) || ': ' || coalesce(m.content, '')), chr(10)) || chr(10) || 'ASSISTANT:' AS prompt FROM sft_rows WHERE messages IS NOT NULL")
def chat_roles(spark, sf):
    return _t(spark, sf, "sft_rows").where(F.col("messages").isNotNull()).select("seq", chat.render_roles(F.col("messages")).alias("prompt"))


@query("""
SELECT seq, CAST(CASE WHEN seq % 5 = 4 THEN 1 ELSE seq % 5 + 1 END AS INTEGER) AS match, CAST(CASE WHEN seq % 5 = 4 THEN 1 ELSE 3 END AS INTEGER) AS simplicity,
 CAST(CASE WHEN seq % 5 = 4 THEN 1 ELSE 4 END AS INTEGER) AS overall, seq % 5 = 2 AS too_technical, CASE WHEN seq % 5 IN (0, 1, 2) THEN 'json' ELSE 'text' END AS how FROM expr_records
""")
def judge_parse(spark, sf):
    n = (F.col("seq") % 5 + 1).cast("string")
    body = F.concat(F.lit('{"match_score": '), n, F.lit(', "simplicity_score": 3, "overall_score": 4, "too_technical": '), F.when(F.col("seq") % 5 == 2, F.lit('"true"')).otherwise(F.lit('"false"')), F.lit(', "comment": "x"}'))
    raw = F.when(F.col("seq") % 5 == 0, body).when(F.col("seq") % 5 == 1, F.concat(F.lit("評価です\n```json\n"), body, F.lit("\n```"))).when(F.col("seq") % 5 == 2, F.concat(F.lit("前置き "), body, F.lit(" 以上"))).when(F.col("seq") % 5 == 3, F.concat(F.lit("match_score＝"), n, F.lit(' simplicity_score: 3 "overall_score": 4'))).otherwise(F.lit(""))
    return _t(spark, sf, "expr_records").select("seq", judge.parse_verdict(raw).alias("j")).select("seq", "j.match", "j.simplicity", "j.overall", "j.too_technical", "j.how")


@query(f"""
WITH r AS (SELECT {sql.compare_key('output')} AS s, {sql.compare_key('standard_name')} AS n FROM sft_rows WHERE {sql.some('output')} AND {sql.some('standard_name')}),
l AS (SELECT trim(jp_final) AS l, arg_max(struct_pack(i := hpo_id, d := definition_ja), seq) AS m FROM hpo_master WHERE {sql.some('jp_final')} GROUP BY 1)
SELECT 'SYSTEM: 症状を言い換える係です。' || chr(10) || 'USER: 患者さんの言葉で書いてください。' || chr(10) || '名称: ' || n || CASE WHEN {sql.some('l.m.d')} THEN chr(10) || '説明: ' || l.m.d ELSE '' END || chr(10) || 'ASSISTANT:' AS prompt,
 s AS output, 'patient_expression' AS task, l.m.i AS hpo_id, {sql.some('l.m.d')} AS has_definition, n AS standard_name, 'dict_patient' AS source FROM r LEFT JOIN l ON r.n = l.l WHERE s <> n
""")
def training_rows(spark, sf):
    surfaces = _t(spark, sf, "sft_rows").select(F.col("output").alias("surface"), "standard_name")
    names = _t(spark, sf, "hpo_master").select(F.col("jp_final").alias("label"), "hpo_id", F.col("definition_ja").alias("definition"), "seq")
    rows = pipelines.training_rows(surfaces, names, "患者さんの言葉で書いてください。", "症状を言い換える係です。", "patient_expression", "dict_patient")
    return rows.select(chat.render_roles(F.col("messages")).alias("prompt"), "output", "task", "hpo_id", "has_definition", "standard_name", "source")


# --- similarity and vectors ------------------------------------------------------------------

_CLEAN = "trim(replace({}, ' ', ''), ' \t\r\n、。.,()（）[]【】「」『』:：;；')"


@query(f"""
WITH p AS (SELECT a.p_partkey AS k, {_CLEAN.format('a.p_name')} AS x, {_CLEAN.format('b.p_name')} AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
g AS (SELECT k, x, y, list_distinct([x[i:i+1] FOR i IN range(1, length(x))]) AS p, list_distinct([y[i:i+1] FOR i IN range(1, length(y))]) AS q FROM p)
SELECT k, round(CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 ELSE len(list_intersect(p, q)) / (len(p) + len(q) - len(list_intersect(p, q))) END, 6) AS jaccard FROM g
""")
def bigram_jaccard(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("x"))
    q = _t(spark, sf, "part").select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("y"))
    return p.join(q, "k").select("k", F.round(similarity.bigram_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query(f"""
WITH h AS (SELECT a.p_partkey AS query_id, b.p_partkey AS entry_no, i AS rank, 1.0::DOUBLE - i / 20.0::DOUBLE AS score, {_CLEAN.format('a.p_name')} AS x, {_CLEAN.format('b.p_name')} AS y FROM part a JOIN (SELECT p_partkey, p_name, unnest([1, 2, 3, 4, 5]) AS i FROM part) b ON a.p_partkey = b.p_partkey - b.i),
g AS (SELECT *, list_distinct([x[i:i+1] FOR i IN range(1, length(x))]) AS p, list_distinct([y[i:i+1] FOR i IN range(1, length(y))]) AS q FROM h),
j AS (SELECT *, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 ELSE len(list_intersect(p, q)) / (len(p) + len(q) - len(list_intersect(p, q))) END AS jac FROM g),
s AS (SELECT *, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN greatest(jac, least(length(x), length(y)) / greatest(length(x), length(y))) ELSE jac END AS lex, CASE WHEN length(x) > 0 AND length(y) < length(x) THEN (length(x) - length(y)) / length(x) ELSE 0.0 END AS short FROM j),
c AS (SELECT *, score + 0.35::DOUBLE * lex - 0.40::DOUBLE * short AS combined FROM s WHERE lex >= 0.20)
SELECT query_id, entry_no, round(combined, 6) AS combined FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, rank) AS r FROM c) WHERE r = 1 AND score >= 0.70
""")
def lexical_rerank(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("span"))
    q = _t(spark, sf, "part").select(F.col("p_partkey").alias("entry_no"), F.col("p_name").alias("expr"), F.explode(F.array(*[F.struct((F.col("p_partkey") - i).alias("query_id"), F.lit(i).alias("rank"), F.lit(1.0 - i / 20).alias("score")) for i in range(1, 6)])).alias("h")).select("entry_no", "expr", "h.*")
    hits = p.join(q.hint("merge"), "query_id")  # both sides grow with the data, and their estimated size is that of compressed files
    return vector.rerank(hits, "query_id", "score", similarity.lexical_similarity(F.col("span"), F.col("expr")), similarity.short_penalty(F.col("span"), F.col("expr"))).select("query_id", "entry_no", F.round("combined", 6).alias("combined"))


@query("""
WITH s AS (SELECT q.vec_id AS qid, b.vec_id AS bid, list_inner_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, bid) AS rank FROM s)
SELECT qid, bid, round(s, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def knn_topk(spark, sf):
    base = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("bid"), F.col("embedding").alias("vec"))
    queries = base.where(F.col("bid") % 100 == 0).withColumnRenamed("bid", "qid")
    return vector.knn(queries, base, 5).withColumn("score", F.round("score", 4))


@query("""
WITH l AS (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY 1),
s AS (SELECT e.vec_id, e.label AS own_label, l.label, list_inner_product(e.embedding::DOUBLE[], l.v) AS s FROM embeddings e, l)
SELECT vec_id, round(max(s) FILTER (label = own_label), 4) AS own, round(max(s) FILTER (label <> own_label), 4) AS other, arg_max(label, s) FILTER (label <> own_label) AS best_other FROM s GROUP BY 1
""")
def own_vs_other(spark, sf):
    rows = _t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    labels = rows.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec"))
    return vector.own_and_other(rows, labels, "vec_id", "label").select("vec_id", F.round("own", 4).alias("own"), F.round("other", 4).alias("other"), "best_other")


@query("""
WITH l AS (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY 1),
s AS (SELECT e.vec_id, e.label AS own_label, l.label, list_inner_product(e.embedding::DOUBLE[], l.v) AS s FROM embeddings e, l),
m AS (SELECT vec_id, max(s) FILTER (label = own_label) AS own, max(s) FILTER (label <> own_label) AS other FROM s GROUP BY 1)
SELECT vec_id, CASE WHEN own < 0.1 THEN 'low_self_sim' WHEN other - own > 0.15 THEN 'high_other_sim' WHEN own - other < 0.05 THEN 'ambiguous_top1_top2' END AS reason FROM m
""")
def similarity_filter(spark, sf):
    rows = _t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    labels = rows.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec"))
    sims = vector.own_and_other(rows, labels, "vec_id", "label")
    return sims.select("vec_id", vector.similarity_reason(F.col("own"), F.col("other"), 0.1, 0.15, 0.05).alias("reason"))


@query("""
SELECT label, count(*) AS n, round(sum(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 3) AS energy FROM embeddings GROUP BY 1
""")
def vector_norms(spark, sf):
    rows = _t(spark, sf, "embeddings")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(vector.dot(F.col("embedding"), F.col("embedding"))), 3).alias("energy"))


@query()
def diverse_topk(spark, sf):
    rows = _t(spark, sf, "expr_records").where(F.col("hpo_id").isNotNull()).select("hpo_id", "expr", "seq")
    return similarity.diverse_top_k(rows, "hpo_id", "expr", 5)


# --- graph and evaluation --------------------------------------------------------------------


def _edges(spark, sf):
    rows = dedupe.last_wins(_t(spark, sf, "hpo_master").where(F.col("hpo_id").rlike(r"\S")).select("hpo_id", "seq", "parents"), ["hpo_id"])
    return graph.edges(rows, "hpo_id", F.split(F.coalesce("parents", F.lit("")), r"\|"))


_CLOSURE = """
WITH RECURSIVE m AS (SELECT hpo_id, parents FROM (SELECT *, row_number() OVER (PARTITION BY hpo_id ORDER BY seq DESC) AS r FROM hpo_master WHERE regexp_matches(hpo_id, '\\S')) WHERE r = 1),
e AS (SELECT DISTINCT hpo_id AS child, parent FROM (SELECT hpo_id, unnest(string_split(coalesce(parents, ''), '|')) AS parent FROM m) WHERE trim(parent) <> ''),
c AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON c.ancestor = e.child)
"""


@query(_CLOSURE + "SELECT node, ancestor FROM c")
def closure_ancestors(spark, sf):
    return graph.closure(_edges(spark, sf))


@query(_CLOSURE + "SELECT ancestor AS node, count(*) AS n_below FROM c GROUP BY 1")
def descendant_counts(spark, sf):
    return graph.closure(_edges(spark, sf)).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_below"))


def _gold_pred(spark, sf):
    items = _t(spark, sf, "lineitem")
    gold = items.where(F.col("l_linenumber") <= 3).select(F.col("l_orderkey").alias("case"), F.col("l_partkey").cast("string").alias("term"))
    raw = items.where(F.col("l_linenumber") >= 2).select(F.col("l_orderkey").alias("case"), F.col("l_partkey").cast("string").alias("term"), F.col("l_quantity").alias("score"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    return gold, evaluation.ranked(raw, "case", "term", "score")


_EVAL = """
WITH g AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS t FROM lineitem WHERE l_linenumber <= 3),
p AS (SELECT l_orderkey AS c, l_partkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem WHERE l_linenumber >= 2),
b AS (SELECT c, t, min(r) AS r FROM p GROUP BY 1, 2)
"""


@query(_EVAL + """,
f AS (SELECT g.t AS gt, q.t AS pt FROM g FULL JOIN (SELECT * FROM b WHERE c IN (SELECT c FROM g)) q ON g.c = q.c AND g.t = q.t),
s AS (SELECT count(*) FILTER (gt IS NOT NULL AND pt IS NOT NULL) AS tp, count(*) FILTER (gt IS NULL) AS fp, count(*) FILTER (pt IS NULL) AS fn FROM f)
SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM s
""")
def pr_exact(spark, sf):
    gold, pred = _gold_pred(spark, sf)
    return evaluation.exact_scores(gold, pred, "case", "term").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(_EVAL + """,
h AS (SELECT g.c, avg(CASE WHEN b.r <= 1 THEN 1.0 ELSE 0 END) AS r1, avg(CASE WHEN b.r <= 3 THEN 1.0 ELSE 0 END) AS r3, avg(CASE WHEN b.r <= 5 THEN 1.0 ELSE 0 END) AS r5 FROM g LEFT JOIN b ON g.c = b.c AND g.t = b.t GROUP BY 1)
SELECT 1 AS k, round(avg(r1), 9) AS recall FROM h UNION ALL SELECT 3, round(avg(r3), 9) FROM h UNION ALL SELECT 5, round(avg(r5), 9) FROM h
""")
def recall_at_k(spark, sf):
    gold, pred = _gold_pred(spark, sf)
    return evaluation.recall_at(gold, pred, "case", "term", [1, 3, 5]).withColumn("recall", F.round("recall", 9))


@query(_EVAL + """,
f AS (SELECT g.c, min(b.r) AS r FROM g JOIN b ON g.c = b.c AND g.t = b.t GROUP BY 1)
SELECT round(coalesce(avg(r), 0), 9) AS mean_rank, count(r) AS hits, (SELECT count(DISTINCT c) FROM g) AS cases FROM f
""")
def min_k(spark, sf):
    gold, pred = _gold_pred(spark, sf)
    return evaluation.first_hits(gold, pred, "case", "term").withColumn("mean_rank", F.round("mean_rank", 9))


@query(_CLOSURE + f""", u AS (SELECT regexp_extract(node, '\\d+') AS x, regexp_extract(ancestor, '\\d+') AS y FROM c), r AS (SELECT x, y FROM u UNION SELECT y, x FROM u),
g AS (SELECT DISTINCT case_no AS k, regexp_extract(item_text, '\\d+') AS t FROM ({packed_queries._FOUND})),
p AS (SELECT doc_id AS k, regexp_extract(hpo_id, '\\d+') AS t FROM documents WHERE hpo_id IS NOT NULL AND regexp_extract(hpo_id, '\\d+') <> '' AND doc_id IN (SELECT k FROM g)),
s AS (SELECT (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.k = p.k AND (g.t = p.t OR EXISTS (SELECT 1 FROM r WHERE r.x = g.t AND r.y = p.t)))) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)
SELECT tp, np - tp AS fp, ng - tp AS fn, round(CASE WHEN np > 0 THEN tp / np ELSE 0.0 END, 9) AS precision, round(CASE WHEN ng > 0 THEN tp / ng ELSE 0.0 END, 9) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) ELSE 0.0 END, 9) AS f1 FROM s
""")
def pr_hierarchical(spark, sf):
    from shirabe.operators.packed import split_packed

    gold = split_packed(_t(spark, sf, "eval_cases").select("case_no", "hpo_ids"), "case_no", "hpo_ids").select(F.col("case_no").alias("case"), F.regexp_extract("item_text", r"\d+", 0).alias("term"))
    docs = _t(spark, sf, "documents").where(F.col("hpo_id").isNotNull()).select(F.col("doc_id").alias("case"), F.regexp_extract("hpo_id", r"\d+", 0).alias("term"), F.lit(1.0).alias("score"), F.col("doc_id").alias("seq"))
    up = graph.closure(_edges(spark, sf)).select(F.regexp_extract("node", r"\d+", 0).alias("node"), F.regexp_extract("ancestor", r"\d+", 0).alias("ancestor"))
    return evaluation.hierarchical_scores(gold, evaluation.ranked(docs, "case", "term", "score"), up, "case", "term").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


# --- spans -----------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
r AS (SELECT p_partkey, i, n, w FROM t, unnest(range(0, len(w))) AS a(i), unnest(range(1, 4)) AS b(n) WHERE i + n <= len(w))
SELECT p_partkey, CAST(i AS INTEGER) AS start, CAST(i + n AS INTEGER) AS stop, array_to_string(w[i + 1 : i + n], '') AS span FROM r
""")
def ngram_spans(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", spans.tokenize(F.col("p_name")).alias("tok"))
    return spans.ngrams(rows, "tok", 3, ["p_partkey"]).select("p_partkey", "start", "stop", "span")


def _in(words):
    return ", ".join("'" + w + "'" for w in words)


@query(f"""
WITH r AS (SELECT ref_id, substr(ref_label, i, n) AS s FROM label_ref, unnest(range(1, length(ref_label) + 1)) AS a(i), unnest(range(1, 5)) AS b(n) WHERE i + n - 1 <= length(ref_label)),
a AS (SELECT DISTINCT s, trim(s, '{spans.SPAN_SIGNS.replace(chr(39), chr(39) * 2)}') AS b FROM r),
p AS (SELECT s, b, {' '.join(f"CASE WHEN b LIKE '%{x}' AND length(b) > {len(x)} THEN left(b, length(b) - {len(x)}) ELSE" for x in spans.PARTICLES)} b {'END ' * len(spans.PARTICLES)} AS c FROM a),
q AS (SELECT s, b, CASE WHEN trim(c, '{spans.SPAN_SIGNS.replace(chr(39), chr(39) * 2)}') <> '' THEN trim(c, '{spans.SPAN_SIGNS.replace(chr(39), chr(39) * 2)}') ELSE b END AS k FROM p)
SELECT s AS span FROM q WHERE NOT (b = '' OR (length(k) = 1 AND k NOT IN ({_in(spans.SINGLE_ALLOWED)})) OR (regexp_full_match(k, '[ぁ-ゖー]+') AND length(k) <= 3)
 OR k IN ({_in(spans.STOP_WORDS)}) OR regexp_matches(k, '{spans.TEMPORAL}') OR b IN ({_in(spans.STOP_PHRASES)}))
""")
def trivial_spans(spark, sf):
    rows = _t(spark, sf, "label_ref").select("ref_label", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("ref_label")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.struct(i.alias("i"), n.alias("n")))))).alias("r"))
    parts = rows.where(F.col("r.i") + F.col("r.n") - 1 <= F.length("ref_label")).select(F.substr("ref_label", F.col("r.i"), F.col("r.n")).alias("span")).distinct()
    return parts.where(~spans.is_trivial(F.col("span")))


def _token_near(words: list[str]) -> str:
    """Does one of the words stand as a token of its own that overlaps the window (lo, hi) of text?"""
    space = sql.SPACE
    one = []
    for w in words:
        n = len(w)
        part = f"substr(text, greatest(lo - {n}, 0) + 1, least(hi + {n}, length(text)) - greatest(lo - {n}, 0))"
        one.append(f"regexp_matches({part}, '{space}{w}{space}') OR (lo <= {n} AND regexp_matches({part}, '^{w}{space}')) OR (hi + {n} >= length(text) AND regexp_matches({part}, '{space}{w}$')) OR text = '{w}'")
    return " OR ".join(one)


@query(f"""
WITH r AS (SELECT doc_id, text, i - 1 AS b FROM documents, unnest(range(1, length(text) + 1)) AS t(i) WHERE substr(text, i, 1) = '、'),
w AS (SELECT doc_id, text, b, greatest(b - 20, 0) AS lo, least(b + 21, length(text)) AS hi FROM r),
c AS (SELECT *, substr(text, lo + 1, hi - lo) AS x FROM w)
SELECT doc_id, CAST(b AS INTEGER) AS begin, CASE WHEN regexp_matches(x, '{'|'.join(f'(?:{p})' for p in spans.UNCERTAIN)}') THEN 'uncertain' WHEN regexp_matches(x, '{'|'.join(f'(?:{p})' for p in spans.ABSENT)}') OR {_token_near(spans.ABSENT_TOKENS)} THEN 'absent' ELSE 'present' END AS status FROM c
""")
def assertion_status(spark, sf):
    """Every comma of every document, by the default lists and tokens."""
    commas = lambda t: [(i, i + 1) for i, c in enumerate(t) if c == "、"]
    rows = _t(spark, sf, "documents").where(F.contains("text", F.lit("、"))).select("doc_id", spans.mentions(F.col("text"), commas).alias("m"))
    return rows.select("doc_id", F.explode("m").alias("m")).select("doc_id", F.col("m.begin").alias("begin"), spans.mention_status(F.col("m")).alias("status"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(x, 'green') THEN 'uncertain' WHEN regexp_matches(x, 'red') OR t THEN 'absent' ELSE 'present' END AS status FROM (SELECT p_partkey, substr(p_name, greatest(3 - 4, 0) + 1, least(5 + 4, length(p_name)) - greatest(3 - 4, 0)) AS x, length(p_name) - length(ltrim(p_name)) = 0 AND string_split(p_name, ' ')[1] IN ('almond', 'blue') AS t FROM part)")
def assertion_of_spans(spark, sf):
    """The status of one span per text, with lists of one's own."""
    rows = _t(spark, sf, "part").select("p_partkey", "p_name", spans.tokenize(F.col("p_name")).alias("tok"))
    first = rows.withColumn("tok", F.slice("tok", 1, 1))
    return first.select("p_partkey", spans.assertion(F.col("p_name"), F.lit(3), F.lit(5), F.col("tok"), window=4, uncertain=["green"], absent=["red"], absent_tokens=["almond", "blue"]).alias("status"))


@query()
def span_selection(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", spans.tokenize(F.col("p_name")).alias("tok"))
    grams = spans.ngrams(rows, "tok", 3, ["p_partkey"]).select("p_partkey", F.struct("start", "stop", F.col("span").alias("text"), (F.pmod(F.xxhash64("span"), F.lit(100)) / 100).alias("score")).alias("s"))
    lists = grams.groupBy("p_partkey").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    return spans.select_spans(lists, "p_partkey", "spans").select("p_partkey", F.posexplode("chosen").alias("pos", "c")).select("p_partkey", "pos", "c.start", "c.stop", "c.text")


@query()
def annotate_labels(spark, sf):
    entries = _t(spark, sf, "label_ref").select(F.regexp_extract("ref_id", r"\d+", 0).cast("bigint").alias("entry_no"), F.col("ref_id").alias("hpo_id"), F.col("ref_label").alias("label"), F.col("ref_label").alias("expr"))
    docs = _t(spark, sf, "label_fill").select("seq", "jp_final")
    return annotate(docs, entries, "seq", "jp_final", tokenizer=spans.script_tokenizer).select("seq", F.posexplode("annotations").alias("pos", "a")).select("seq", "pos", "a.hpo_id", "a.status", "a.evidence_span", F.round("a.score", 4).alias("score"))


@query()
def curated_dictionary(spark, sf):
    e = _t(spark, sf, "expr_records").where(F.col("hpo_id").isNotNull() & F.col("expr").rlike(r"(?U)\S")).select("seq", "hpo_id", "expr", "score", "mode", "source")
    m = _t(spark, sf, "hpo_master").where(F.col("hpo_id").isNotNull()).select("seq", "hpo_id", F.coalesce("jp_label", F.lit("")).alias("label"), text.depth_of(F.col("depth")).alias("depth"))
    kept, gone = pipelines.curate(e, m, self_min=0.05, other_margin=0.6, ambiguous_gap=0.0)
    return kept.groupBy(F.lit("kept").alias("what"), F.col("source").alias("why")).agg(F.count("*").alias("n")).unionByName(gone.groupBy(F.lit("removed").alias("what"), F.col("reason").alias("why")).agg(F.count("*").alias("n")))
