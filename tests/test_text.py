import pytest
from pyspark.sql import functions as F

from shirabe.functions import chat, judge, text


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [
    ("患者: 「頭が痛い」", "頭が痛い"), ("「頭が痛い", "頭が痛い"), ("頭が痛い assistant: 次", "頭が痛い"), ("ASSISTANT:", ""), ("一行目\n二行目", "一行目"), ("   ", ""), (None, ""), ("", ""), ("痛い｡", "痛い"), ("『痛い』", "痛い"),
])
def test_patient_expressions(spark, raw, want):
    assert one(spark, lambda c: text.clean_expression(c, "patient"), raw) == want


def test_doctor_expressions_and_trailing_cut(spark):
    assert one(spark, lambda c: text.clean_expression(c, "doctor"), "所見: “浮腫あり") == "浮腫あり"
    assert one(spark, lambda c: text.clean_expression(c, "patient", cut_inside=False), "痛い assistant:") == "痛い"
    assert one(spark, lambda c: text.clean_expression(c, "patient", cut_inside=False), "assistant が言う") == "assistant が言う"


@pytest.mark.parametrize(("raw", "want"), [("- \"頭痛\"\n説明", "頭痛"), ("・頭痛。", "頭痛"), ("1. 頭痛", "頭痛"), ("''", "''"), (None, ""), (" ", "")])
def test_labels(spark, raw, want):
    assert one(spark, text.clean_label, raw) == want


def test_every_label_is_cleaned(spark, tmp_path):
    from shirabe.plans import registry

    raw = {1: "・アレルギー性鼻炎。", 2: '"頭痛(右)"', 3: "- \"II型 糖尿病\"\n説明", 4: None, 5: "  ", 6: "頭痛。"}
    spark.createDataFrame(list(raw.items()), "seq long, jp_final string").write.parquet(f"{tmp_path}/label_fill.parquet")
    got = {r.seq: r.label for r in registry.QUERIES["clean_labels_all"](spark, str(tmp_path)).collect()}
    assert got == {1: "アレルギー性鼻炎", 2: "頭痛(右)", 3: "II型 糖尿病", 4: "", 5: "", 6: "頭痛"}


def test_keys_and_small_parsers(spark):
    assert one(spark, text.match_key, " ＡＢ　c d ") == "abcd"
    assert one(spark, text.match_key, None) == ""
    assert one(spark, text.compare_key, "a 　 b　") == "a b"
    assert one(spark, text.depth_of, "3.0") == 3 and one(spark, lambda c: text.depth_of(c, strict=True), "3.0") == 999
    assert one(spark, text.int_key, "2.0") == "2" and one(spark, text.int_key, "x") == "unknown" and one(spark, text.int_key, None) == "unknown"
    assert one(spark, text.frequency_rank, "95-100%") == 20 and one(spark, text.frequency_rank, "出現なし") == 0 and one(spark, text.frequency_rank, "?") == 0
    assert one(spark, text.first_sentence, "痛い。続く。") == "痛い。"
    assert one(spark, lambda c: text.shorten(c, 3, "…", "無"), "abcdef") == "abc…" and one(spark, lambda c: text.shorten(c, 3, "…", "無"), " ") == "無"


VERDICT = '{"match_score": 5, "simplicity_score": 4, "overall_score": 4, "too_technical": "false", "comment": "ok"}'


@pytest.mark.parametrize(("raw", "how", "match", "technical"), [
    (VERDICT, "json", 5, False), (f"x\n```json\n{VERDICT}\n```", "json", 5, False), (f"評価 {VERDICT} 以上", "json", 5, False),
    ('"match_score": 4, "too_technical": true', "text", 4, True), ("match_score＝3", "text", 3, False), ("[1, 2]", "text", 1, False), ("", "text", 1, False), (None, "failed", 1, True),
])
def test_verdicts(spark, raw, how, match, technical):
    got = one(spark, judge.parse_verdict, raw)
    assert (got.how, got.match, got.too_technical) == (how, match, technical)


def test_chat(spark):
    msgs = [("system", "s"), ("user", ""), ("user", "u"), ("assistant", "a"), ("user", "later"), ("model", " b "), ("user", "z")]
    df = spark.createDataFrame([(msgs,), ([("user", "x")],), ([],), ([("assistant", "first")],)], f"m {chat.MESSAGES}")
    got = [r[0] for r in df.select(chat.flatten(F.col("m"))).collect()]
    assert got[0] == ("system: s\nuser: u\nassistant: a\nuser: later", "b")
    assert got[1] == ("", "") and got[2] == ("", "") and got[3] == ("", "first")
    masked = spark.createDataFrame([([7, 8, 9],)], "i array<int>").select(chat.masked_labels(F.lit(2), F.col("i"), F.lit(5))).first()[0]
    assert masked == [-100, -100, 9, -100, -100]
