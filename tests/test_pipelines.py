from pyspark.sql import functions as F

from shirabe.plans import pipelines


def test_curation_keeps_or_explains_every_record(spark):
    onto = spark.createDataFrame([("A", "頭痛", 2, 1), ("B", "発熱", 3, 2), ("C", "", 1, 3)], "hpo_id string, label string, depth int, seq int")
    rows = [(1, "A", "頭 痛", 1.0), (2, "A", "頭痛がする", 2.0), (3, "B", "熱っぽい", 1.0), (4, "A", "熱っぽい", 1.0), (5, "B", "発熱あり", 3.0), (6, "Z", "頭がいたむ", 1.0), (7, "C", "何か別のこと", 1.0)]
    rec = spark.createDataFrame([(*r, "patient", "gen") for r in rows], "seq int, hpo_id string, expr string, score double, mode string, source string")
    kept, gone = pipelines.curate(rec, onto, self_min=0.2, other_margin=0.5, ambiguous_gap=0.0)
    reasons = {r.seq: r.reason for r in gone.collect()}
    assert reasons[1] == "same_as_label" and reasons[3] == reasons[4] == "cross_hpo_duplicate"
    made = kept.where("not is_official").collect()
    assert len(made) + len(reasons) == len(rows)
    assert any(r.hpo_id == "Z" for r in made)  # an unknown id passes the similarity stage
    official = {(r.hpo_id, r.expr, r.score) for r in kept.where("is_official").collect()}
    assert official == {("A", "頭痛", 10.0), ("B", "発熱", 10.0)}
    off, _ = pipelines.curate(rec, onto, policy="keep_best_score", self_min=0.0, other_margin=0.0, official=False)
    assert {r.expr for r in off.collect()} >= {"熱っぽい", "頭痛がする"}


def test_training_rows_look_names_up(spark):
    s = spark.createDataFrame([("頭 が　痛い", "頭痛"), ("頭痛", " 頭痛 "), ("熱", "発熱"), ("咳", "咳嗽"), (None, "x"), ("y", " ")], "surface string, standard_name string")
    n = spark.createDataFrame([("頭痛", "A", "痛む", 1), ("頭痛", "A2", "いたむ", 2), ("発熱", "B", None, 1)], "label string, hpo_id string, definition string, seq int")
    got = {r.output: r for r in pipelines.training_rows(s, n, "書いて", "係", "t", "d").collect()}
    assert set(got) == {"頭 が 痛い", "熱", "咳"}
    assert got["頭 が 痛い"].hpo_id == "A2" and got["頭 が 痛い"].has_definition and "いたむ" in got["頭 が 痛い"].messages[1].content
    assert got["熱"].hpo_id == "B" and not got["熱"].has_definition and got["咳"].hpo_id is None


def test_labels_from_log_then_model(spark):
    m = spark.createDataFrame([("A", "痛み", "m", 1), ("B", "単語を追加", "w", 2), ("C", None, None, 3), ("D", " ", None, 4), ("E", None, None, 5)], "hpo_id string, jp_final string, jp_source string, seq int")
    log = spark.createDataFrame([("C", "古い", 1), ("C", "新しい", 2), ("D", " ", 3)], "hpo_id string, jp_final string, seq int")
    model = lambda df: df.withColumn("jp_final", F.when(F.col("hpo_id") != "E", F.concat(F.lit("訳"), "hpo_id")))
    done, made = pipelines.fill_labels(m, log, model)
    got = {r.hpo_id: r.jp_final for r in done.collect()}
    assert got == {"A": "痛み", "B": "訳B", "C": "新しい", "D": "訳D", "E": None}
    assert {r.hpo_id for r in made.collect()} == {"B", "D", "E"}


def test_definitions_by_category(spark):
    m = spark.createDataFrame([("A", "symptom", "en", None), ("B", "other", "en", None), ("C", "symptom", None, None), ("D", "symptom", "en", "既にある"), ("E", "symptom", "en", None)], "hpo_id string, category string, definition string, definition_ja string")
    cache = spark.createDataFrame([("E", "保存", 1)], "hpo_id string, definition_ja string, seq int")
    got = {r.hpo_id: r.definition_ja for r in pipelines.translate_definitions(m, cache, lambda df: df.withColumn("definition_ja", F.lit("訳"))).collect()}
    assert got == {"A": "訳", "B": "", "C": "", "D": "既にある", "E": "保存"}


def test_summary_row(spark):
    kept = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "expr string, is_official boolean")
    gone = spark.createDataFrame([("x",)], "expr string")
    metrics = spark.createDataFrame([("f1_exact", 0.5), ("recall@1", 0.25)], "metric string, value double")
    row = pipelines.summarize(kept, gone, metrics, "tag", ["f1_exact", "recall@1"]).first()
    assert (row.cond_tag, row.post_total, row.post_gen, row.post_official, row.removed, row.f1_exact) == ("tag", 3, 2, 1, 1, 0.5)
