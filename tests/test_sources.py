import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from shirabe.operators import graph
from shirabe.operators.dedupe import last_wins
from shirabe.plans.pipelines import run_steps, sweep
from shirabe.sources import formats, readers, writers
from shirabe.streaming.annotate import annotate_stream

OBO = """format-version: 1.2

[Term]
id: T:1
name: root

[Term]
id: T:2
name: child
def: "A \\"quoted\\" thing." [x:y]
synonym: "kid" EXACT []
is_a: T:1 {source="z"} ! root
is_a: T:3 ! other

[Term]
id: T:3
is_obsolete: true

[Typedef]
id: part_of
is_a: T:9
"""


def test_csv_with_mark_and_aliases(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿HPO_ID,jp_final,jp_label,category_v2,category,depth\nT:1,,名,,c,3.0\n,x,,,,\nT:1,"二,つ",,v,c,x\n', encoding="utf-8")
    df = readers.read_csv(spark, str(p), required=["HPO_ID", "jp_final"])
    items = readers.ontology_items(df)
    assert [(r.name_ja, r.category, r.depth) for r in items.orderBy("seq").collect()] == [("名", "c", 3), ("二,つ", "v", 999)]
    assert last_wins(items, ["hpo_id"]).first().name_ja == "二,つ"
    with pytest.raises(readers.MissingColumns):
        readers.read_csv(spark, str(p), required=["absent"])


def test_expressions_of_several_producers(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    rows = [{"HPO_ID": "T:1", "patient_expression_final": "患者: 痛い", "judge_overall": 4}, {"hpo_id": "T:2", "expr": "腫れ", "judge": {"overall": 3}, "mode": "doctor"}, {"hpo_id": "T:3", "expr": "  "}, {"expr": "no id"}]
    p.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n{broken\n[1]\n", encoding="utf-8")
    got = [(r.hpo_id, r.expr, r.score, r["mode"]) for r in readers.read_expressions(spark, str(p), "mixed").orderBy("seq").collect()]
    assert got == [("T:1", "患者: 痛い", 4.0, "mixed"), ("T:2", "腫れ", 3.0, "doctor")]
    assert readers.read_expressions(spark, str(p), "patient").orderBy("seq").first().expr == "痛い"


def test_obo(spark, tmp_path):
    p = tmp_path / "o.obo"
    p.write_text(OBO)
    by = {r.id: r for r in readers.read_obo(spark, str(p)).collect()}
    assert set(by) == {"T:1", "T:2", "T:3"}
    assert by["T:2"].definition == 'A "quoted" thing.' and by["T:2"].synonyms == ["kid"] and by["T:2"].parents == ["T:1", "T:3"]
    assert readers.read_obo(spark, str(p), terms_only=False, drop_obsolete=True).count() == 3


@pytest.mark.parametrize("change", [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: t.replace("\n\n", "\n"), lambda t: t.replace("\n\n", "\n").replace("\n", "\r\n"), lambda t: t.split("\n\n", 1)[1]])
def test_obo_in_any_layout(spark, tmp_path, change):
    p = tmp_path / "o.obo"
    p.write_bytes(change(OBO).encode())
    rows = readers.read_obo(spark, str(p), terms_only=False)
    by = {r.id: r for r in rows.collect()}
    assert set(by) == {"T:1", "T:2", "T:3", "part_of"} and by["T:2"].parents == ["T:1", "T:3"] and by["T:2"].name == "child" and by["T:3"].obsolete
    assert readers.read_obo(spark, str(p)).count() == 3
    up = graph.closure(graph.edges(rows, "id", F.col("parents")))
    assert sorted(tuple(r) for r in up.collect()) == [("T:2", "T:1"), ("T:2", "T:3"), ("part_of", "T:9")]


def test_stray_lines_after_a_blank_line_belong_to_no_stanza(spark, tmp_path):
    p = tmp_path / "o.obo"
    p.write_text("[Term]\nid: T:1\n\nname: stray\n[Term]\nid: T:2\nname: two\n")
    assert {r.id: r.name for r in readers.read_obo(spark, str(p)).collect()} == {"T:1": "", "T:2": "two"}


def test_texts_rounds_and_line_caps(spark, tmp_path):
    (tmp_path / "round_2.jsonl").write_text('{"t": " a "}\n{"t": ""}\n{"u": 1}\n')
    (tmp_path / "round_x.jsonl").write_text('{"t": "b"}\n')
    assert sorted(r.text for r in readers.read_texts(spark, str(tmp_path), "t").collect()) == ["a", "b"]
    got = readers.read_rounds(spark, str(tmp_path)).select("round", F.coalesce(readers.json_text("v", "t"), F.lit("-")).alias("t"))
    assert sorted((r["round"], r["t"]) for r in got.collect()) == [("2", " a "), ("2", "-"), ("2", "-"), ("x", "b")]
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "i.jsonl").write_text('\n{"instruction": "a", "output": "x"}\nbroken\n{"instruction": "b", "input": "c", "output": "y"}\n')
    assert [r.output for r in readers.read_instructions(spark, str(tmp_path / "i"), most=3).collect()] == ["x"]
    assert [r.text_input for r in readers.read_instructions(spark, str(tmp_path / "i"), most=4).orderBy("seq").collect()] == ["a", "b\n\nc"]
    rows, bad = readers.read_chat(spark, str(tmp_path / "i"), validate=False)
    assert rows.count() == 2


def test_npy_round_trip(spark, tmp_path):
    formats.register(spark)
    df = spark.range(7).select(F.col("id").alias("row_idx"), F.array(F.col("id").cast("float"), F.lit(1.5).cast("float")).alias("embedding"))
    assert writers.write_npy(df, str(tmp_path / "m.npy")) == 7
    back = spark.read.format("npy").option("rows", 3).load(str(tmp_path / "m.npy"))
    assert sorted((r.row_idx, r.embedding) for r in back.collect()) == [(i, [float(i), 1.5]) for i in range(7)]
    assert np.load(tmp_path / "m.npy").shape == (7, 2)


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>標準病名</t></si><si><t>熱</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>出現形</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c></row><row r="3"><c r="B3"><v>4</v></c></row></sheetData></worksheet>')
    formats.register(spark)
    df = spark.read.format("xlsx").load(str(tmp_path / "b.xlsx"))
    assert [tuple(r) for r in df.orderBy("seq").collect()] == [("熱", "3", 0), (None, "4", 1)]


def test_logs_gold_predictions_and_writers(spark, tmp_path):
    log = spark.createDataFrame([("a", "x"), ("b", "y")], "HPO_ID string, jp_label string")
    writers.append_log(log, str(tmp_path / "log"))
    writers.append_log(spark.createDataFrame([("a", "z"), ("b", " ")], log.schema).coalesce(1), str(tmp_path / "log"))
    assert readers.read_log(spark, str(tmp_path / "log"), ["jp_label"]).count() == 2
    gold = readers.read_gold(spark.createDataFrame([("1", "a  b a", 1), ("1", "c", 2), ("2", None, 3)], "c string, ids string, seq int"), "c", "ids")
    assert sorted((r.case, r.term) for r in gold.collect() if r.term) == [("1", "c")] and gold.count() == 2
    (tmp_path / "p.jsonl").write_text('{"input_id": "1", "annotations": [{"hpo_id": "a", "score": 0.5}, {"hpo_id": "", "status": "absent"}]}\n{"input_id": "", "annotations": []}\n')
    assert [(r.case, r.term, r.status) for r in readers.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()] == [("1", "a", "present")]
    writers.write_by_round(spark.createDataFrame([(1.0, "a"), (None, "b")], "r double, t string"), str(tmp_path / "rounds"), F.col("r").cast("string"))
    assert {p.name for p in (tmp_path / "rounds").glob("round_key=*")} == {"round_key=1", "round_key=unknown"}
    with pytest.raises(FileNotFoundError):
        writers.read_shards(spark, [str(tmp_path / "log"), str(tmp_path / "missing")])


def test_steps_are_skipped_when_done(spark, tmp_path):
    calls = []
    steps = [("one", str(tmp_path / "one"), lambda: calls.append(1) or spark.range(3)), ("two", str(tmp_path / "two"), lambda: 1 / 0), ("three", str(tmp_path / "three"), lambda: spark.range(1))]
    assert run_steps(spark, steps, stop_on_error=False)["two"].startswith("error")
    assert run_steps(spark, steps, start="two", stop_on_error=False)["one"] == "skipped" and len(calls) == 1
    assert len(sweep({"a": [1, 2], "b": [3]}, lambda s: None)) == 2


def test_annotating_a_stream(spark, tmp_path):
    entries = spark.createDataFrame([(1, "T:1", "発熱", "発熱")], "entry_no bigint, hpo_id string, label string, expr string")
    spark.createDataFrame([(1, "発熱 です"), (2, "無関係")], "id int, t string").write.json(str(tmp_path / "in"))
    got = []
    q = annotate_stream(spark.readStream.schema("id int, t string").json(str(tmp_path / "in")), entries, "id", "t", lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r.id: len(r.annotations) for r in got} == {1: 1, 2: 0}
