"""Queries of the steps that call models, with scripted models, and of prompts, masks and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions import chat, judge, text
from shirabe.operators import aggregate, dedupe, evaluation, graph, iterate, joins, spans, vector
from shirabe.plans import pipelines, sql
from shirabe.session import shared_path
from shirabe.sources import readers

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


# --- loops over scripted models --------------------------------------------------------------


def _prompts(spark, sf) -> DataFrame:
    return _t(spark, sf, "label_ref").select(F.col("ref_id").alias("id"), F.col("ref_label").alias("prompt"))


def _propose(rows: DataFrame) -> DataFrame:
    """The third candidate repeats the second one at first and is new when asked again; the fourth is never anything."""
    n = F.when(F.col("cand_no") == 4, F.lit(None)).otherwise(F.floor(F.col("cand_no") / 2) + 2 * F.col("attempt"))
    return rows.withColumn("text", F.concat("prompt", F.lit("-"), n.cast("string")))


@query("SELECT ref_id AS id, ref_label || '-' || n AS text, CAST(c AS INTEGER) AS cand_no FROM label_ref, (VALUES (1, '0'), (2, '1'), (3, '3')) AS v(c, n)")
def loop_generate(spark, sf):
    return iterate.generate_unique(_prompts(spark, sf), _propose, 4, attempts=3).select("id", "text", "cand_no")


def _candidates(spark, sf) -> DataFrame:
    return _prompts(spark, sf).select("id", F.posexplode(F.array(*[F.concat("prompt", F.lit(x)) for x in ("甲", "乙", "丙", "丁")])).alias("n", "text")).select("id", (F.col("n") + 1).alias("cand_no"), "text")


def _judge(rows: DataFrame) -> DataFrame:
    """Good are the texts that end in 甲 or were refined; the refinement of 丁 is as bad as before."""
    good = F.col("text").endswith("甲") | F.col("text").endswith("乙改") | F.col("text").endswith("丙改")
    s = F.when(good, 5).otherwise(2)
    return rows.withColumns({"match": s, "simplicity": s, "overall": s, "too_technical": F.lit(False)})


def _refine(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.concat("text", F.lit("改")))


@query("SELECT ref_id AS id, ref_label || x AS text, CAST(p AS INTEGER) AS pick, CAST(r AS INTEGER) AS refine_round, 5 AS overall FROM label_ref, (VALUES (1, '甲', 0), (2, '乙改', 1), (3, '丙改', 1)) AS v(p, x, r)")
def loop_judge_refine(spark, sf):
    return iterate.judge_refine(_candidates(spark, sf), _judge, _refine, 4)


@query("SELECT ref_id AS id, ref_label || x AS text, CAST(p AS INTEGER) AS pick, 0 AS refine_round, 0 AS overall FROM label_ref, (VALUES (1, '甲'), (2, '乙'), (3, '丙'), (4, '丁')) AS v(p, x)")
def loop_generate_only(spark, sf):
    return iterate.judge_refine(_candidates(spark, sf), _judge, _refine, 4, max_rounds=-1)


@query("SELECT ref_id AS id, ref_label || x AS text, CAST(p AS INTEGER) AS pick, 3 AS refine_round, 2 AS overall FROM label_ref, (VALUES (1, '乙改改改'), (2, '丙改改改')) AS v(p, x)")
def loop_always_replace(spark, sf):
    """Every refinement replaces its text, none is ever good, so the choice is among all."""
    two = _candidates(spark, sf).where(F.col("cand_no").isin(2, 3))

    def never(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"match": F.lit(2), "simplicity": F.lit(2), "overall": F.lit(2), "too_technical": F.lit(False)})

    return iterate.judge_refine(two, never, _refine, 2, accept="always", fallback="all")


@query("SELECT CAST(r AS INTEGER) AS round, n * (SELECT count(*) FROM label_ref) AS n, g * (SELECT count(*) FROM label_ref) AS n_good, m AS mean_overall FROM (VALUES (0, 4, 1, 2.75), (1, 4, 3, 4.25), (2, 4, 3, 4.25), (3, 4, 3, 4.25)) AS v(r, n, g, m)")
def loop_round_log(spark, sf):
    path = shared_path(spark, "round-log")
    iterate.judge_refine(_candidates(spark, sf), _judge, _refine, 4, log=path)
    rows = spark.read.schema("round int, match int, simplicity int, overall int, good boolean").json(path)
    return aggregate.round_stats(rows, "round", F.col("good")).select("round", "n", "n_good", "mean_overall")


@query("SELECT seq, CASE WHEN seq % 7 = 3 THEN '' ELSE upper(coalesce(hpo_id, 'none')) END AS text, seq % 7 = 3 AS failed FROM label_fill")
def loop_calls(spark, sf):
    def call(row: dict) -> str:
        if row["seq"] % 7 == 3:
            raise ValueError("refused")
        return (row["hpo_id"] or "none").upper()

    rows = iterate.call_rows(_t(spark, sf, "label_fill").select("seq", "hpo_id"), "hpo_id", call, retries=1, in_flight=4, wait=0.0, on_error="")
    return rows.select("seq", "text", F.col("error").isNotNull().alias("failed"))


@query("SELECT seq, CASE WHEN seq % 50 = 7 THEN NULL ELSE CAST(length(coalesce(jp_final, '')) AS VARCHAR) END AS text FROM label_fill")
def loop_batches(spark, sf):
    def call(values: list[str]) -> list[str]:
        if any(v.startswith("!") for v in values):
            raise ValueError("refused")
        return [str(len(v)) for v in values]

    bad = F.when(F.col("seq") % 50 == 7, F.lit("!")).otherwise(F.coalesce("jp_final", F.lit("")))
    return iterate.call_batches(_t(spark, sf, "label_fill").select("seq", bad.alias("v")), "v", call, size=16).select("seq", "text")


_NOISE = " OR ".join(f"contains(jp_final, {sql.quoted(w)})" for w in text.SITE_NOISE)


@query(f"""
WITH r AS (SELECT seq, hpo_id, CASE WHEN {sql.some('jp_final')} AND NOT ({_NOISE}) THEN jp_final END AS v FROM hpo_master),
c AS (SELECT hpo_id AS k, arg_max(jp_final, seq) AS v FROM label_fill WHERE {sql.some('jp_final')} AND hpo_id IS NOT NULL GROUP BY 1)
SELECT r.seq, coalesce(r.v, c.v, CASE WHEN r.hpo_id IS NOT NULL THEN '訳:' || r.hpo_id END) AS jp_final FROM r LEFT JOIN c ON r.hpo_id = c.k
""")
def loop_fill_labels(spark, sf):
    """Missing labels from the log, else from a scripted model."""
    master = _t(spark, sf, "hpo_master").select("seq", "hpo_id", "jp_final", "jp_source")
    log = _t(spark, sf, "label_fill").where(F.col("hpo_id").isNotNull()).select("seq", "hpo_id", "jp_final")
    done, _ = pipelines.fill_labels(master, log, lambda todo: todo.withColumn("jp_final", F.concat(F.lit("訳:"), F.col("hpo_id"))))
    return done.select("seq", "jp_final")


@query(f"""
WITH c AS (SELECT hpo_id AS k, arg_max(jp_final, seq) AS v FROM label_fill WHERE {sql.some('jp_final')} AND hpo_id IS NOT NULL GROUP BY 1)
SELECT m.seq, CASE WHEN coalesce(category, '') <> '神経系' THEN coalesce(definition_ja, '') WHEN {sql.some('definition_ja')} THEN definition_ja ELSE coalesce(c.v, CASE WHEN {sql.some('definition')} THEN 'T:' || definition END, '') END AS definition_ja
FROM hpo_master m LEFT JOIN c ON c.k = m.hpo_id
""")
def loop_translate(spark, sf):
    """Missing definitions of one category from the cache, else translated; the key is the row."""
    master = _t(spark, sf, "hpo_master").select("seq", F.col("seq").cast("string").alias("row"), "hpo_id", "category", "definition", "definition_ja")
    cached = dedupe.last_wins(_t(spark, sf, "label_fill").where(F.col("jp_final").rlike(r"(?U)\S") & F.col("hpo_id").isNotNull()).select("hpo_id", "seq", "jp_final"), ["hpo_id"])
    cache = master.select("row", "hpo_id").join(cached, "hpo_id").select("row", "seq", F.col("jp_final").alias("definition_ja"))
    out = pipelines.translate_definitions(master, cache, lambda todo: todo.withColumn("definition_ja", F.concat(F.lit("T:"), "definition")), key="row", wanted="神経系")
    return out.select("seq", "definition_ja")


@query("SELECT 't' || t AS cond_tag, m AS mode, count(*) AS n FROM expr_records, (VALUES (2), (3), (4)) AS a(t), (VALUES ('patient'), ('doctor')) AS b(m) WHERE score >= t AND mode = m AND NOT (t = 3 AND m = 'doctor') GROUP BY 1, 2")
def loop_sweep(spark, sf):
    """All settings but one that is finished already."""
    rows = _t(spark, sf, "expr_records")
    runs = pipelines.sweep({"t": [2, 3, 4], "m": ["patient", "doctor"]}, lambda s: rows.where((F.col("score") >= s["t"]) & (F.col("mode") == s["m"])).groupBy(F.lit(f"t{s['t']}").alias("cond_tag"), F.col("mode")).agg(F.count("*").alias("n")), done=lambda s: s == {"t": 3, "m": "doctor"})
    out = runs[0][1]
    for _, made in runs[1:]:
        out = out.unionByName(made)
    return out


@query("SELECT unnest(['first', 'second']) AS step, unnest(['done', 'skipped']) AS what, (SELECT count(*) FROM label_ref) AS n")
def loop_steps(spark, sf):
    """A step that runs, and the same step again, which is skipped."""
    path = shared_path(spark, "step")
    rows = _t(spark, sf, "label_ref")
    first = pipelines.run_steps(spark, [("s", path, lambda: rows)])["s"]
    second = pipelines.run_steps(spark, [("s", path, lambda: rows.where("false"))])["s"]
    return spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.explode(F.array(F.struct(F.lit("first").alias("step"), F.lit(first).alias("what")), F.struct(F.lit("second").alias("step"), F.lit(second).alias("what")))).alias("s"), "n").select("s.*", "n")


# --- prompts, masks, small functions ---------------------------------------------------------


@query(f"""
WITH s AS (SELECT seq, coalesce(name_en, '') AS n, CASE WHEN {sql.some('definition')} THEN CASE WHEN length(definition) > 30 THEN left(definition, 30) || ' …' ELSE definition END ELSE '(なし)' END AS d,
 list_filter(string_split(coalesce(parents, ''), '|'), lambda x: x <> '')[1:2] AS p FROM hpo_master)
SELECT seq, 'SYSTEM: 医学用語を和訳する係です。' || chr(10) || 'USER: 英名: ' || n || chr(10) || '同義語: ' || CASE WHEN len(p) > 0 THEN array_to_string(p, ', ') ELSE '(なし)' END || chr(10) || '説明: ' || d || chr(10) || '日本語の標準的な名称を一つだけ返してください。' || chr(10) || 'ASSISTANT:' AS prompt FROM s
""")
def fn_label_prompt(spark, sf):
    names = F.filter(F.split(F.coalesce("parents", F.lit("")), r"\|"), lambda x: x != "")
    msgs = chat.label_prompt(F.coalesce("name_en", F.lit("")), F.col("definition"), names, most_synonyms=2, longest=30)
    return _t(spark, sf, "hpo_master").select("seq", chat.render_roles(msgs).alias("prompt"))


@query(f"""
WITH s AS (SELECT seq, coalesce(jp_final, '') AS n, CASE WHEN {sql.some('definition_ja')} THEN definition_ja ELSE '(なし)' END AS d FROM hpo_master)
SELECT seq, 'USER: 名称: ' || n || chr(10) || '説明: ' || d || chr(10) || '表現: x' || chr(10) || '一致、平易さ、総合を1から5で採点し、JSONだけを返してください。' AS judge,
 '名称: ' || n || chr(10) || '説明: ' || d || chr(10) || '今の表現: x' || chr(10) || '指摘: (なし)' || chr(10) || '指摘を直した表現を一行で返してください。' AS refine, '次の文を日本語に訳してください。' || chr(10) || n AS translate FROM s
""")
def fn_prompts(spark, sf):
    n = F.coalesce("jp_final", F.lit(""))
    rows = _t(spark, sf, "hpo_master").select("seq", chat.judge_prompt(n, F.col("definition_ja"), F.lit("x")).alias("j"), chat.refine_prompt(n, F.col("definition_ja"), F.lit("x"), F.lit(None).cast("string")).alias("r"), chat.translation_prompt(n).alias("t"))
    return rows.select("seq", F.concat(F.lit("USER: "), F.col("j")[1]["content"]).alias("judge"), F.col("r")[1]["content"].alias("refine"), F.col("t")[1]["content"].alias("translate"))


@query("""
WITH r AS (SELECT seq, mode, left(coalesce(expr, ''), 5) AS p, left(coalesce(expr, ''), 40) AS f FROM expr_records), w AS (SELECT mode, max(length(f)) AS w FROM r GROUP BY 1)
SELECT seq, CAST(w.w AS INTEGER) AS width, CAST(w - length(f) AS INTEGER) AS n_pad, CAST(length(p) + w - length(f) AS INTEGER) AS n_ignored FROM r JOIN w ON r.mode IS NOT DISTINCT FROM w.mode
""")
def fn_collate(spark, sf):
    rows = _t(spark, sf, "expr_records").select("seq", "mode", F.left(F.coalesce("expr", F.lit("")), F.lit(5)).alias("p"), F.col("expr").alias("f"))
    out = chat.collate(rows, "p", "f", lambda s: [ord(c) for c in s], "mode", longest=40)
    count = lambda c, v: F.size(F.filter(c, lambda x: x == v))
    return out.select("seq", F.size("input_ids").alias("width"), count(F.col("attention_mask"), 0).alias("n_pad"), count(F.col("labels"), -100).alias("n_ignored"))


@query(f"""
SELECT seq, {sql.compare_key('standard_name')} AS compare_key, coalesce(standard_name, '') AS safe, coalesce(TRY_CAST(CASE WHEN regexp_full_match(output, '[0-9]+') THEN output END AS INTEGER), 0) AS number,
 CASE WHEN NOT {sql.some('output')} THEN '-' WHEN length(output) > 12 THEN left(output, 12) || ' …' ELSE output END AS short, coalesce(nullif(standard_name, ''), nullif(hpo_id, ''), 'x') AS name,
 translate(coalesce(hpo_id, ''), '/-', '__') || '_' || translate(coalesce(source, ''), '/-', '__') AS tag, round(ln(1 + length(coalesce(output, ''))), 6) AS log_length FROM sft_rows
""")
def fn_small(spark, sf):
    c = F.col
    return _t(spark, sf, "sft_rows").select("seq", text.compare_key(c("standard_name")).alias("compare_key"), text.safe_str(c("standard_name")).alias("safe"), text.safe_int(c("output")).alias("number"), text.shorten(c("output"), 12, default="-").alias("short"),
        F.coalesce(text.first_present(c("standard_name"), c("hpo_id")), F.lit("x")).alias("name"), text.tag(F.coalesce("hpo_id", F.lit("")), F.coalesce("source", F.lit(""))).alias("tag"), F.round(text.log_length(c("output")), 6).alias("log_length"))


@query(f"SELECT seq, {sql.clean_expression('raw', 'doctor')} AS doctor, {sql.clean_expression('raw', 'patient', False)} AS patient FROM (SELECT seq, CASE seq % 4 WHEN 0 THEN '医師所見: 所見:「' WHEN 1 THEN '  患者: 「' WHEN 2 THEN chr(10) || '『' ELSE '' END || output || CASE seq % 3 WHEN 0 THEN '」｡' WHEN 1 THEN ' Assistant: 次' ELSE chr(10) || '二行目' END AS raw FROM sft_rows)")
def fn_expressions(spark, sf):
    head = F.when(F.col("seq") % 4 == 0, "医師所見: 所見:「").when(F.col("seq") % 4 == 1, "  患者: 「").when(F.col("seq") % 4 == 2, "\n『").otherwise("")
    tail = F.when(F.col("seq") % 3 == 0, "」｡").when(F.col("seq") % 3 == 1, " Assistant: 次").otherwise("\n二行目")
    raw = F.concat(head, "output", tail)
    return _t(spark, sf, "sft_rows").select("seq", text.clean_expression(raw, "doctor").alias("doctor"), text.clean_expression(raw, "patient", cut_inside=False).alias("patient"))


@query(f"SELECT seq, {sql.clean_label('raw')} AS label FROM (SELECT seq, CASE seq % 5 WHEN 0 THEN '- \"' || jp_final || '\"。' WHEN 1 THEN '1.「' || jp_final || '」' WHEN 2 THEN '・' || jp_final || ' 。' WHEN 3 THEN '''' || jp_final || '''' ELSE jp_final END AS raw FROM label_fill)")
def fn_labels(spark, sf):
    """Every label, in several forms of answers."""
    j, k = F.col("jp_final"), F.col("seq") % 5
    raw = F.when(k == 0, F.concat(F.lit('- "'), j, F.lit('"。'))).when(k == 1, F.concat(F.lit("1.「"), j, F.lit("」"))).when(k == 2, F.concat(F.lit("・"), j, F.lit(" 。"))).when(k == 3, F.concat(F.lit("'"), j, F.lit("'"))).otherwise(j)
    return _t(spark, sf, "label_fill").select("seq", text.clean_label(raw).alias("label"))


@query(f"SELECT n.seq, replace(replace({sql.strip('lower(coalesce(n.v, chr(32)))')}, ' ', ''), '　', '') AS match_key, {sql.strip('coalesce(n.v, chr(32))')} AS plain FROM ({sql.nfkc('expr_records', 'seq', 'expr')}) n")
def fn_keys(spark, sf):
    """The comparison keys with the full compatibility form."""
    return _t(spark, sf, "expr_records").select("seq", text.match_key(F.col("expr")).alias("match_key"), text.plain_form(F.col("expr")).alias("plain"))


_KEY = f"replace(replace({sql.strip('lower(n.v)')}, ' ', ''), '　', '')"


@query(f"""
WITH k AS (SELECT n.seq, {_KEY} AS t FROM ({sql.nfkc('expr_records', 'seq', 'expr')}) n),
r AS (SELECT e.seq, e.hpo_id, coalesce(k.t, '') AS t FROM expr_records e JOIN k ON k.seq = e.seq WHERE e.hpo_id IS NOT NULL),
d AS (SELECT t FROM r GROUP BY t HAVING count(DISTINCT hpo_id) > 1)
SELECT CASE WHEN d.t IS NULL THEN 'kept' ELSE 'cross_hpo_duplicate' END AS what, count(*) AS n FROM r LEFT JOIN d ON r.t = d.t GROUP BY 1
""")
def fn_duplicates_by_key(spark, sf):
    """Duplicates across ids by the real comparison key."""
    rows = _t(spark, sf, "expr_records").where(F.col("hpo_id").isNotNull()).select("seq", "hpo_id", text.match_key(F.col("expr")).alias("t"))
    kept, gone = dedupe.split_by_reason(dedupe.cross_group_duplicates(rows, "hpo_id", "t"))
    return kept.groupBy(F.lit("kept").alias("what")).agg(F.count("*").alias("n")).unionByName(gone.groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n")))


@query(f"SELECT seq, coalesce(TRY_CAST({sql.strip('depth')} AS DOUBLE) >= 3, FALSE) AND coalesce(self_reportable = '1', FALSE) AS deep, coalesce({sql.strip('source')} IN ('expert', 'trans_a'), FALSE) AS trusted, coalesce(hpo_id LIKE 'HP:1%' OR hpo_id LIKE 'HP:7%', FALSE) AS prefixed FROM hpo_master")
def fn_filters(spark, sf):
    c = F.col
    return _t(spark, sf, "hpo_master").select("seq", text.at_least(c("depth"), 3, c("self_reportable") == "1").alias("deep"), text.listed(c("source"), ["expert", "trans_a"]).alias("trusted"), text.begins_with_any(c("hpo_id"), ["HP:1", "HP:7"]).alias("prefixed"))


@query(f"SELECT count(*) AS before, count(*) FILTER ({sql.compare_key('output')} <> {sql.compare_key('standard_name')}) AS after, count(*) FILTER ({sql.some('standard_name')}) AS labelled FROM sft_rows")
def fn_differing(spark, sf):
    rows = _t(spark, sf, "sft_rows")
    _, counts = pipelines.differing(rows, "output", "standard_name")
    return counts.join(pipelines.drop_unlabelled(rows, "standard_name").agg(F.count("*").alias("labelled")))


@query("SELECT seq, CASE WHEN score = 5.0 THEN 'official' ELSE 'gen_filtered' END AS source, CASE WHEN score > 0 THEN round(2.0 / score, 4) ELSE 0.0 END AS share, overall >= 4 AND m >= 4 AND s >= 3 AND NOT t AS good FROM (SELECT seq, score, seq % 6 AS overall, seq % 5 + 1 AS m, seq % 4 + 1 AS s, seq % 11 = 0 AS t FROM expr_records WHERE score IS NOT NULL)")
def fn_scores(spark, sf):
    rows, n = _t(spark, sf, "expr_records").where(F.col("score").isNotNull()), F.col("seq")
    good = judge.good_verdict(n % 5 + 1, n % 4 + 1, n % 6, n % 11 == 0, 4, 4, 3)
    return rows.select("seq", pipelines.source_of(F.col("score"), 5.0).alias("source"), text.share(F.lit(2.0), F.col("score")).alias("share"), good.alias("good"))


@query("SELECT hpo_id, mode, arg_min(expr, seq) AS expr FROM expr_records WHERE expr <> '' GROUP BY 1, 2")
def fn_first_of_two_keys(spark, sf):
    return dedupe.first_wins(_t(spark, sf, "expr_records").where(F.col("expr") != "").select("hpo_id", "mode", "expr", "seq"), ["hpo_id", "mode"]).select("hpo_id", "mode", "expr")


@query("SELECT hpo_id, string_agg(coalesce(mode, '?'), ',' ORDER BY seq) AS modes FROM expr_records GROUP BY 1")
def fn_records_of_ids(spark, sf):
    out = aggregate.collect_records(_t(spark, sf, "expr_records").select("hpo_id", "mode", "seq"), "hpo_id", ["mode"])
    return out.select("hpo_id", F.array_join(F.transform("records", lambda r: F.coalesce(r["mode"], F.lit("?"))), ",").alias("modes"))


@query("SELECT e.seq, m.seq AS line FROM expr_records e LEFT JOIN hpo_master m ON e.hpo_id = m.hpo_id")
def fn_left_merge(spark, sf):
    return joins.left_merge(_t(spark, sf, "expr_records").select("seq", "hpo_id"), _t(spark, sf, "hpo_master").select("hpo_id", F.col("seq").alias("line")), "hpo_id").select("seq", "line")


@query("""
WITH l AS (SELECT hpo_id AS id, arg_max(jp_final, seq) AS v FROM label_fill WHERE jp_final IS NOT NULL AND hpo_id IS NOT NULL GROUP BY 1)
SELECT 'master' AS tab, m.seq, coalesce(l.v, m.jp_final) AS label FROM hpo_master m LEFT JOIN l ON l.id = m.hpo_id UNION ALL SELECT 'fill', f.seq, coalesce(l.v, f.jp_final) FROM label_fill f LEFT JOIN l ON l.id = f.hpo_id
""")
def fn_update_both(spark, sf):
    fill = _t(spark, sf, "label_fill").select("seq", "hpo_id", "jp_final")
    patch = dedupe.last_wins(fill.where(F.col("jp_final").isNotNull() & F.col("hpo_id").isNotNull()), ["hpo_id"]).select("hpo_id", "jp_final")
    both = pipelines.update_both([_t(spark, sf, "hpo_master").select("seq", "hpo_id", "jp_final"), fill], patch, "hpo_id", ["jp_final"])
    return readers.union_tagged(dict(zip(["master", "fill"], both)), "tab").select("tab", "seq", F.col("jp_final").alias("label"))


@query("SELECT doc_id, CAST(sum(CASE WHEN i % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_allowed, count(*) AS n_tokens FROM (SELECT doc_id, i FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x1c-\\x1f]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), unnest(range(0, len(w))) AS t(i) WHERE len(w) > 1) GROUP BY 1")
def fn_regions(spark, sf):
    """Tokens within the ranges of a scripted tagger that tags every third token."""

    def tagger(t: str) -> list[tuple[str, int, int]]:
        return [(("B-DIS", "I-DIS", "O")[i % 3] if i % 3 != 1 else "B-DIS", b, e) if i % 3 == 1 else ("O", b, e) for i, (_, b, e) in enumerate(spans.whitespace_tokenizer(t))]

    rows = _t(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", spans.tokenize(F.col("text")).alias("tok"), spans.tag_regions(F.col("text"), tagger, ["DIS"]).alias("reg"))
    flags = rows.where(F.size("tok") > 1).select("doc_id", spans.region_flags(F.col("tok"), F.col("reg")).alias("f"))
    return flags.select("doc_id", F.size(F.filter("f", lambda x: x)).cast("bigint").alias("n_allowed"), F.size("f").cast("bigint").alias("n_tokens"))


_UP = """
WITH RECURSIVE m AS (SELECT hpo_id, parents FROM (SELECT *, row_number() OVER (PARTITION BY hpo_id ORDER BY seq DESC) AS r FROM hpo_master WHERE regexp_matches(hpo_id, '\\S')) WHERE r = 1),
e AS (SELECT DISTINCT hpo_id AS child, parent FROM (SELECT hpo_id, unnest(string_split(coalesce(parents, ''), '|')) AS parent FROM m) WHERE trim(parent) <> ''),
c AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON c.ancestor = e.child),
n AS (SELECT node AS x, ancestor AS y FROM c UNION SELECT ancestor, node FROM c),
g AS (SELECT DISTINCT hpo_id AS k, hpo_id AS t FROM label_fill WHERE hpo_id IS NOT NULL),
p AS (SELECT hpo_id AS k, hpo_id AS t, 3 AS r FROM label_fill WHERE hpo_id IS NOT NULL UNION SELECT g.k, n.y, 1 FROM g JOIN n ON g.t = n.x)
"""


def _related(spark, sf):
    last = dedupe.last_wins(_t(spark, sf, "hpo_master").where(F.col("hpo_id").rlike(r"\S")).select("hpo_id", "seq", "parents"), ["hpo_id"])
    up = graph.closure(graph.edges(last, "hpo_id", F.split(F.coalesce("parents", F.lit("")), r"\|")))
    gold = _t(spark, sf, "label_fill").where(F.col("hpo_id").isNotNull()).select(F.col("hpo_id").alias("case"), F.col("hpo_id").alias("term")).distinct()
    near = up.select(F.col("node").alias("case"), F.col("ancestor").alias("term")).unionByName(up.select(F.col("ancestor").alias("case"), F.col("node").alias("term"))).distinct()
    pred = gold.withColumn("rank", F.lit(3)).unionByName(near.join(gold.select("case"), "case", "left_semi").withColumn("rank", F.lit(1)))
    return up, gold, pred


@query(_UP + "SELECT round(avg(r), 9) AS mean_rank, count(*) AS hits, (SELECT count(DISTINCT k) FROM g) AS cases FROM (SELECT g.k, min(p.r) AS r FROM g JOIN p ON p.k = g.k AND (p.t = g.t OR EXISTS (SELECT 1 FROM n WHERE n.x = g.t AND n.y = p.t)) GROUP BY 1)")
def first_hits_hierarchical(spark, sf):
    up, gold, pred = _related(spark, sf)
    return evaluation.first_hits(gold, pred, "case", "term", up).withColumn("mean_rank", F.round("mean_rank", 9))


@query(_UP + "SELECT (SELECT count(*) FROM g) AS tp, (SELECT count(*) FROM (SELECT DISTINCT k, t FROM p)) - (SELECT count(*) FROM g) AS fp, CAST(0 AS BIGINT) AS fn")
def scores_hierarchical(spark, sf):
    """One gold term per case, so one prediction per case can meet it."""
    up, gold, pred = _related(spark, sf)
    return evaluation.hierarchical_scores(gold, pred, up, "case", "term").select("tp", "fp", "fn")


@query("SELECT count(*) AS n_rows, count(*) FILTER (score >= 4) AS n_good, count(*) FILTER (mode = 'doctor') AS n_doctor FROM expr_records")
def fn_observed(spark, sf):
    """Counters that fill while a table is written."""
    df, watch = aggregate.observed(_t(spark, sf, "expr_records"), "counters", n_good=F.coalesce(F.col("score") >= 4, F.lit(False)), n_doctor=F.coalesce(F.col("mode") == "doctor", F.lit(False)))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(watch.get["rows"], watch.get["n_good"], watch.get["n_doctor"])], "n_rows bigint, n_good bigint, n_doctor bigint")


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * CASE WHEN vec_id % 2 = 1 THEN 4 ELSE 1 END, 3) AS energy, 1.0::DOUBLE AS length FROM embeddings")
def fn_mean_pool(spark, sf):
    """Mean of the token vectors v and 3v, or of v alone where the mask hides the other, and its unit vector."""
    rows = _t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    tokens, mask = F.array("v", F.transform("v", lambda x: x * 3)), F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"))
    pooled = rows.select("vec_id", vector.mean_pool(tokens, mask).alias("m"))
    one = vector.unit(F.col("m"))
    return pooled.select("vec_id", F.round(vector.dot(F.col("m"), F.col("m")), 3).alias("energy"), F.round(vector.dot(one, one), 6).alias("length"))


@query(f"SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_name, '{sql.SPACE}+'), lambda x: x <> ''), ' ') AS joined FROM part")
def fn_joined_tokens(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", spans.tokenize(F.col("p_name")).alias("tok"))
    return rows.select("p_partkey", spans.joined_tokens(F.col("tok")).alias("joined"))


def _key_of(v: str) -> str:
    return f"replace(replace({sql.strip(f'lower(coalesce({v}, chr(32)))')}, ' ', ''), '　', '')"


@query(f"""
WITH l AS (SELECT hpo_id, arg_max(coalesce(jp_label, ''), seq) AS label FROM hpo_master WHERE hpo_id IS NOT NULL GROUP BY 1),
e AS (SELECT seq, hpo_id, expr FROM expr_records WHERE hpo_id IS NOT NULL AND {sql.some('expr')}),
ek AS (SELECT n.seq, {_key_of('n.v')} AS t FROM ({sql.nfkc('e', 'seq', 'expr')}) n), lk AS (SELECT n.hpo_id, {_key_of('n.v')} AS t, n.v FROM ({sql.nfkc('l', 'hpo_id', 'label')}) n),
r AS (SELECT e.seq, e.hpo_id, ek.t, coalesce(lk.v, '') <> '' AND lk.t = ek.t AS same FROM e JOIN ek ON ek.seq = e.seq LEFT JOIN lk ON lk.hpo_id = e.hpo_id),
d AS (SELECT t FROM r WHERE NOT coalesce(same, FALSE) GROUP BY t HAVING count(DISTINCT hpo_id) > 1)
SELECT CASE WHEN coalesce(same, FALSE) THEN 'same_as_label' ELSE 'cross_hpo_duplicate' END AS reason, count(*) AS n FROM r WHERE coalesce(same, FALSE) OR t IN (SELECT t FROM d) GROUP BY 1
""")
def fn_curation_reasons(spark, sf):
    """The whole curation with the similarity stage off: why rows go, by the real comparison key."""
    e = _t(spark, sf, "expr_records").where(F.col("hpo_id").isNotNull() & F.col("expr").rlike(r"(?U)\S")).select("seq", "hpo_id", "expr", "score", "mode", "source")
    m = _t(spark, sf, "hpo_master").where(F.col("hpo_id").isNotNull()).select("seq", "hpo_id", F.coalesce("jp_label", F.lit("")).alias("label"), text.depth_of(F.col("depth")).alias("depth"))
    _, gone = pipelines.curate(e, m, self_min=0.0, other_margin=0.0, ambiguous_gap=0.3)
    return gone.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT 'base' AS cond_tag, count(*) FILTER (score >= 2) AS post_total, count(*) FILTER (score >= 2 AND score <> 5) AS post_gen, count(*) FILTER (score = 5) AS post_official, count(*) FILTER (score < 2) AS removed, round(avg(score), 6) AS mean, CAST(count(DISTINCT hpo_id) AS DOUBLE) AS ids FROM expr_records")
def loop_summary(spark, sf):
    """One row of a sweep's summary table."""
    rows = _t(spark, sf, "expr_records")
    kept = rows.where("score >= 2").withColumn("is_official", F.col("score") == 5)
    metrics = aggregate.unpivot_metrics(rows.agg(F.round(F.avg("score"), 6).alias("mean"), F.countDistinct("hpo_id").cast("double").alias("ids")), ["mean", "ids"])
    return pipelines.summarize(kept, rows.where("score < 2"), metrics, "base", ["mean", "ids"])
