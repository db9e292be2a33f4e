import itertools
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from shirabe.functions.text import no_spaces
from shirabe.operators import aggregate, dedupe, evaluation, graph, iterate, joins, similarity, spans, vector
from shirabe.operators.annotate import annotate


def test_cross_group_policies(spark):
    data = [(1, "A", "t", 3, 1.0), (2, "A", "t", 3, 2.0), (3, "B", "t", 1, 2.0), (4, "C", "u", 9, 0.0), (5, "C", "u", 9, 0.0), (6, None, "v", None, None), (7, "D", None, 2, 1.0)]
    df = spark.createDataFrame(data, "seq int, g string, t string, depth int, score double")
    for policy, kept in {"drop_all": {4, 5, 6, 7}, "keep_shallow": {3, 4, 5, 6, 7}, "keep_deep": {1, 4, 5, 6, 7}, "keep_best_score": {2, 4, 5, 6, 7}}.items():
        out = dedupe.cross_group_duplicates(df, "g", "t", policy)
        assert {r.seq for r in out.where("reason is null").collect()} == kept
        assert out.count() == len(data)
    with pytest.raises(ValueError):
        dedupe.cross_group_duplicates(df, "g", "t", "other")


def test_index_and_shards_cover_the_table(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    idx = dedupe.with_index(df, ["x"])
    assert all(r.x == r.row_no for r in idx.collect())
    parts = [sorted(r.x for r in dedupe.shard(df, ["x"], 3, k).collect()) for k in range(3)]
    assert sorted(itertools.chain(*parts)) == list(range(1000))
    assert dedupe.shard(df, ["x"], 1, 0).count() == 1000


def test_injection_and_updates(spark):
    rec = spark.createDataFrame([("A", "x y", 1.0), ("A", "z", 2.0), (None, "q", 1.0)], "g string, e string, s double")
    lab = spark.createDataFrame([("A", "xy"), ("B", "b"), ("A2", "n"), (None, "n")], "g string, l string")
    uni = spark.createDataFrame([("A",), ("A2",), (None,)], "g string")
    got = joins.inject_official(rec, uni, lab, "g", "e", "l", no_spaces, {"s": F.lit(10.0)})
    assert sorted((r.g or "", r.e) for r in got.where("s = 10.0").collect()) == [("A2", "n")]
    base = spark.createDataFrame([("A", "1", None), ("B", None, "k"), ("C", "c", "c")], "k string, u string, v string")
    patch = spark.createDataFrame([("A", None, "new"), ("B", "b", None)], "k string, u string, v string")
    assert sorted(map(tuple, joins.update_columns(base, patch, "k", ["u", "v"]).collect())) == [("A", "1", "new"), ("B", "b", "k"), ("C", "c", "c")]


def naive_diverse(texts, k, threshold):
    unique = list(dict.fromkeys(t.strip() for t in texts if t.strip()))
    if len(unique) <= k:
        return unique
    order = sorted(unique, key=lambda t: (len(t), t))
    taken = []
    for t in order:
        if len(taken) < k and all(SequenceMatcher(None, t, s).ratio() < threshold for s in taken):
            taken.append(t)
    for t in order:
        if len(taken) < k and t not in taken:
            taken.append(t)
    return taken


def test_diverse_selection_against_naive(spark):
    rng = random.Random(4)
    data, want = [], {}
    for g in range(8):
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 25))]
        data += [(str(g), t, i) for i, t in enumerate(texts)]
        want[str(g)] = naive_diverse(texts, 4, 0.7)
    df = spark.createDataFrame(data, "g string, t string, seq int")
    got = {}
    for r in similarity.diverse_top_k(df, "g", "t", 4).orderBy("g", "pick").collect():
        got.setdefault(r.g, []).append(r.t)
    assert got == {g: w for g, w in want.items() if w}


def test_knn_and_own_other_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5)).round(2)
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 4) for i, v in enumerate(m)] + [(99, None, 1)], "bid int, vec array<double>, g int")
    for hold in ("queries", "base"):
        got = vector.knn(df.where("bid % 10 = 0").select(F.col("bid").alias("qid"), "vec"), df.select("bid", "vec"), 5, block=2 if hold == "queries" else 25, hold=hold).collect()
        for q in range(0, 60, 10):
            score = m @ m[q]
            want = sorted(range(60), key=lambda i: (-score[i], i))[:5]
            assert [r.bid for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == want
    labels = df.where("bid < 3").select(F.col("bid").alias("g"), "vec")
    sims = {r.bid: r for r in vector.own_and_other(df, labels, "bid", "g", block=2).collect()}
    for i in range(60):
        s = {k: float(m[i] @ m[k]) for k in range(3)}
        own = s.pop(i % 4, None)
        best = max(s, key=lambda k: (s[k], -k))
        assert (sims[i].own is None) == (own is None) and (own is None or math.isclose(sims[i].own, own))
        assert math.isclose(sims[i].other, s[best]) and sims[i].best_other == best


def test_own_other_holds_equal_labels_once(spark, monkeypatch):
    m = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]]
    labels = [(f"g{i:02d}", m[i % 3]) for i in range(30)] + [("h", [-1.0, 0.0]), ("a", [0.8, 0.6])]
    rows = [(i, f"g{i % 32:02d}", m[i % 3] if i % 5 else m[(i + 1) % 3]) for i in range(64)] + [(64, "h", m[0]), (65, "a", m[2]), (66, None, m[1])]
    held, blocks = [], vector._blocks
    monkeypatch.setattr(vector, "_blocks", lambda df, size: (held.append(len(part)) or part for part in blocks(df, size)))
    got = {r.i: r for r in vector.own_and_other(spark.createDataFrame(rows, "i int, g string, vec array<double>"), spark.createDataFrame(labels, "g string, vec array<double>"), "i", "g", block=2).collect()}
    assert held == [2, 2, 1] and len(got) == len(rows)
    for i, g, v in rows:
        s = {k: sum(a * b for a, b in zip(x, v)) for k, x in labels}
        own = s.pop(g, None)
        best = min(s, key=lambda k: (-round(s[k], 12), k))
        assert got[i].own == (None if own is None else pytest.approx(own)) and got[i].other == pytest.approx(s[best]) and got[i].best_other == best


def test_rerank_query_sends_no_table_through_the_driver(spark, sf):
    from shirabe.plans.core_queries import lexical_rerank

    plan = lexical_rerank(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_similarity_measures(spark):
    df = spark.createDataFrame([("頭痛", "頭痛"), ("。頭痛 、", "頭痛"), ("激しい頭痛", "頭痛"), ("a", "b"), (None, "x"), ("", "")], "a string, b string")
    lex = [r[0] for r in df.select(similarity.lexical_similarity(F.col("a"), F.col("b"))).collect()]
    assert lex[0] == 1 and lex[1] == 1 and lex[2] == pytest.approx(0.4) and lex[3:] == [0, 0, 0]
    assert df.select(similarity.short_penalty(F.col("a"), F.col("b"))).collect()[2][0] == pytest.approx(0.6)
    assert df.select(similarity.matcher_ratio(F.col("a"), F.col("b"))).collect()[4][0] is None


def test_closure_with_diamond_and_cycle(spark):
    e = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {tuple(r) for r in graph.closure(e).collect()}
    assert got == {("d", "b"), ("d", "c"), ("d", "a"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}


def test_closure_of_nothing(spark):
    assert graph.closure(spark.createDataFrame([], "child string, parent string")).count() == 0


def weight_of(rows, pick):
    return sum(rows[i][2] for i in pick)


@pytest.mark.parametrize("adjacent", [False, True])
def test_disjoint_spans_against_brute_force(adjacent):
    rng = random.Random(7)
    for _ in range(150):
        rows = [(a := rng.randint(0, 8), a + rng.randint(1, 4), round(rng.random(), 3)) for _ in range(rng.randint(0, 9))]
        pick = spans.best_disjoint(rows, adjacent)
        gap = 1 if adjacent else 0
        chosen = [rows[i] for i in pick]
        assert all(a[1] + gap <= b[0] for a, b in zip(chosen, chosen[1:]))
        best = 0.0
        for n in range(len(rows) + 1):
            for c in itertools.combinations(sorted(rows, key=lambda r: (r[1], r[0])), n):
                if all(a[1] + gap <= b[0] for a, b in zip(c, c[1:])):
                    best = max(best, sum(r[2] for r in c))
        assert weight_of(rows, pick) == pytest.approx(best)


def test_trivial_spans_and_assertion(spark):
    cases = {"": True, "熱": False, "痛": True, "ここ": True, "検査で": True, "出生後に": True, "発熱": False, "。発熱、": False, "があり": True, "視力低下": False, None: True}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in df.select(spans.is_trivial(F.col("s"))).collect()] == list(cases.values())
    pad = "あ" * 20
    rows = [("発熱はない。", 0, 2, "absent"), ("発熱がある", 0, 2, "present"), ("発熱" + pad + "ない", 0, 2, "present"), ("発熱は否定できない", 0, 2, "uncertain"), ("陰性、発熱", 3, 5, "absent")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, b int, e int, w string").select(spans.assertion(F.col("t"), F.col("b"), F.col("e"))).collect()]
    assert got == [r[3] for r in rows]


def test_region_gate(spark):
    df = spark.createDataFrame([("aa bb cc", [(3, 5)]), ("aa bb", []), (None, None)], "t string, r array<struct<begin:int,end:int>>").withColumn("tok", spans.tokenize(F.col("t"))).withColumn("f", spans.region_flags(F.col("tok"), F.col("r")))
    assert [r.f for r in df.collect()] == [[False, True, False], [True, True], []]
    grams = spans.ngrams(df, "tok", 2, ["t"], "f", " ").where("t = 'aa bb cc'")
    assert {r.span for r in grams.collect()} == {"aa bb", "bb", "bb cc"}


def test_scores_on_a_small_tree(spark):
    up = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("s", "a")], "node string, ancestor string")
    gold = spark.createDataFrame([("1", "b"), ("1", "c"), ("2", "s"), ("3", None)], "case string, term string")
    raw = spark.createDataFrame([("1", "a", 0.9, 1), ("1", "c", 0.8, 2), ("1", "c", 0.7, 3), ("2", "b", 0.5, 1), ("3", "q", 0.1, 1), ("9", "a", 1.0, 1)], "case string, term string, score double, seq int")
    pred = evaluation.ranked(raw, "case", "term", "score")
    e = evaluation.exact_scores(gold, pred, "case", "term").first()
    assert (e.tp, e.fp, e.fn) == (1, 3, 2)
    h = evaluation.hierarchical_scores(gold, pred, up, "case", "term").first()
    assert (h.tp, h.fp, h.fn) == (2, 2, 1)
    assert [round(r.recall, 6) for r in evaluation.recall_at(gold, pred, "case", "term", [1, 2]).collect()] == [0.0, 0.25]
    f = evaluation.first_hits(gold, pred, "case", "term").first()
    assert (f.mean_rank, f.hits, f.cases) == (2.0, 1, 2)
    assert evaluation.first_hits(gold, pred, "case", "term", up).first().mean_rank == 1.0
    none = gold.where("false")
    assert evaluation.exact_scores(none, pred, "case", "term").first().f1 == 0.0


@pytest.mark.parametrize("wide", [1_000, 2])
def test_hierarchical_scores_against_a_loop(spark, monkeypatch, wide):
    monkeypatch.setattr(evaluation, "WIDE", wide)
    rng = random.Random(5)
    up = {(f"t{a:02d}", f"t{b:02d}") for a in range(40) for b in range(a) if rng.random() < 0.1} | {(f"t{a:02d}", "root") for a in range(40)}
    gold = sorted({(c, rng.choice(["root", *(f"t{i:02d}" for i in range(40))])) for c in range(12) for _ in range(6)})
    pred = [(c, f"t{t:02d}", r) for c in range(1, 14) for r, t in enumerate(rng.sample(range(40), rng.randint(1, 9)), 1)] + [(3, "root", 20), (4, "root", 0)]
    tp = 0
    for case in range(12):
        taken: set = set()
        for g in sorted(t for c, t in gold if c == case):
            hit = next((t for _, t in sorted((r, t) for c, t, r in pred if c == case) if t not in taken and (t == g or (t, g) in up or (g, t) in up)), None)
            taken |= {hit} - {None}
        tp += len(taken)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((gold, "case int, t string"), (pred, "case int, t string, rank int"), (sorted(up), "node string, ancestor string"))]
    scores = evaluation.hierarchical_scores(*frames, "case", "t")
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan  # no call per case
    got = scores.first()
    assert (got.tp, got.fp, got.fn) == (tp, sum(c < 12 for c, _, _ in pred) - tp, len(gold) - tp)


def test_judge_refine_with_a_scripted_model(spark):
    start = spark.createDataFrame([("g", i, f"text {i}") for i in range(4)] + [("h", 0, "good one"), ("h", 1, "good two")], "id string, cand_no int, text string")

    def judge(df):
        good = F.col("text").startswith("good")
        return df.select(*[c for c in df.columns if c not in iterate.SCORES], F.when(good, 5).otherwise(2).alias("match"), F.lit(5).alias("simplicity"), F.when(good, 5).otherwise(2).alias("overall"), F.lit(False).alias("too_technical"))

    def refine(df):
        return df.withColumn("text", F.concat(F.lit("good "), F.col("cand_no").cast("string"), F.lit(" "), F.md5(F.col("before"))))

    out = iterate.judge_refine(start, judge, refine, target=2, threshold=1.1)
    by = {k: [r for r in out.collect() if r.id == k] for k in "gh"}
    assert len(by["g"]) == 2 and all(r.refine_round == 1 and r.overall == 5 for r in by["g"])
    assert {r.text for r in by["h"]} == {"good one", "good two"}
    assert iterate.judge_refine(start, judge, refine, 2, max_rounds=0).where("id = 'g'").count() == 0
    assert iterate.judge_refine(start, judge, refine, 2, max_rounds=0, fallback="all").where("id = 'g'").count() == 2
    assert iterate.judge_refine(start, judge, refine, 2, max_rounds=-1).where("id = 'g'").count() == 2


def test_generate_unique_and_failing_calls(spark):
    prompts = spark.createDataFrame([("a", "p"), ("b", "p")], "id string, prompt string")
    propose = lambda df: df.withColumn("text", F.concat(F.lit("t"), ((F.col("cand_no") + F.col("attempt")) % 3).cast("string")))
    got = iterate.generate_unique(prompts, propose, 3)
    assert got.groupBy("id").agg(F.countDistinct("text").alias("n")).where("n = 3").count() == 2

    def call(row):
        if row["id"] == "b":
            raise RuntimeError("no")
        return "ok"

    rows = {r.id: r for r in iterate.call_rows(prompts, "prompt", call, retries=1).collect()}
    assert rows["a"].text == "ok" and rows["b"].text is None and "no" in rows["b"].error


def test_annotation_of_small_texts(spark):
    entries = spark.createDataFrame([(1, "HP:1", "頭痛", "強い 頭痛"), (2, "HP:2", "発熱", "発熱")], "entry_no bigint, hpo_id string, label string, expr string")
    docs = spark.createDataFrame([(1, "昨日 から 発熱 です"), (2, None), (3, ""), (4, "発熱 は ない")], "id int, t string")
    got = {r.id: r.annotations for r in annotate(docs, entries, "id", "t", max_n=2).collect()}
    assert [a.hpo_id for a in got[1]] == ["HP:2"] and got[1][0].status == "present" and got[2] == [] and got[3] == []
    assert got[4][0].status == "absent"


def test_line_quality_and_histogram(spark):
    df = spark.createDataFrame([('{"messages": [], "output": "x"}',), ('{"messages": 1, "output": "x"}',), ('{"output": "x"}',), ("[1]",), ("{bad",), (" ",)], "l string")
    assert {r.kind: r.n for r in aggregate.quality_of_lines(df, "l").collect()} == {"ok": 1, "bad_messages": 1, "missing_key": 1, "bad_type": 1, "bad_json": 1}
    flat = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert [tuple(r)[:2] for r in aggregate.histogram(flat, F.col("v"), 10).collect()] == [(0, 2)]


def test_hot_keys_are_picked_like_others(spark, monkeypatch):
    import random

    from shirabe.operators import similarity

    rng = random.Random(1)
    rows = [("a", "".join(rng.choice("あいうえおか") for _ in range(rng.randint(1, 9))), i) for i in range(200)] + [("b", "".join(rng.choice("xyz") for _ in range(6)), i) for i in range(60)] + [(None, "p", 1), (None, "q", 2), ("c", " ", 3), ("c", None, 4)]
    df = spark.createDataFrame(rows, "g string, x string, seq int")
    for kwargs in ({}, {"order": [-F.col("seq")]}, {"threshold": 0.1}, {"dedupe": False}):
        want = sorted(map(str, similarity.diverse_top_k(df, "g", "x", 6, **kwargs).collect()))
        monkeypatch.setattr(similarity, "HOT", 50)
        assert sorted(map(str, similarity.diverse_top_k(df, "g", "x", 6, **kwargs).collect())) == want
        monkeypatch.undo()


def test_nearest_rank_over_partitions(spark):
    from shirabe.operators.aggregate import nearest_rank

    values = [(i * 7919) % 5003 for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int").repartition(6)
    assert nearest_rank(df, F.col("v"), 0.95).first()[0] == sorted(values)[int(5000 * 0.95)]
    assert nearest_rank(df.where("false"), F.col("v")).first()[0] is None


def test_tags_and_regions(spark):
    from shirabe.operators.spans import region_flags, tag_regions, tokenize

    def tagger(t):
        return [("B-dis", 0, 2), ("I-dis", 2, 3), ("drug", 4, 6), ("O", 6, 7)]

    df = spark.createDataFrame([(1, "頭が 痛い"), (2, None), (3, "")], "k int, t string")
    got = {r.k: [(x.begin, x.end) for x in r.r] for r in df.select("k", tag_regions(F.col("t"), tagger, ["dis"]).alias("r")).collect()}
    assert got == {1: [(0, 2), (2, 3)], 2: [], 3: []}
    made = df.where("k = 1").select(tokenize(F.col("t")).alias("tok"), tag_regions(F.col("t"), tagger, ["dis"]).alias("r"), tag_regions(F.col("t"), None, ["dis"]).alias("none"))
    flags = made.select(region_flags(F.col("tok"), F.col("r")).alias("f"), region_flags(F.col("tok"), F.col("none")).alias("g")).first()
    assert flags.f == [True, False] and flags.g == [True, True]


def test_calls_wait_run_at_once_and_report(spark):
    import time

    from shirabe.operators.iterate import call_batches, call_rows

    def slow(row):
        if row["id"] % 5 == 4:
            raise ValueError("no")
        time.sleep(0.2)
        return str(row["id"])

    began = time.time()
    got = call_rows(spark.range(20).coalesce(1), "id", slow, retries=1, in_flight=10, wait=0.05, on_error="").orderBy("id").collect()
    assert time.time() - began < 20 * 0.2 + 1 and [r.text for r in got][:5] == ["0", "1", "2", "3", ""] and got[4].error.startswith("ValueError")

    def many(values):
        if any(v % 7 == 6 for v in values):
            raise ValueError("bad")
        return [str(v * 2) for v in values]

    rows = {r.id: (r.text, r.error) for r in call_batches(spark.range(20).coalesce(1), "id", many, size=4).collect()}
    assert rows[3] == ("6", None) and rows[5] == ("10", None) and rows[6][0] is None and rows[13][1].startswith("ValueError")


def test_collate_pads_and_masks(spark):
    from shirabe.functions.chat import collate

    df = spark.createDataFrame([(1, "ab", "abcd"), (1, "a", "ab"), (2, None, None)], "b int, p string, f string")
    got = sorted((r.b, r.input_ids, r.attention_mask, r.labels) for r in collate(df, "p", "f", lambda x: [ord(c) for c in x], "b", longest=3).collect())
    assert got == [(1, [97, 98, 0], [1, 1, 0], [-100, 98, -100]), (1, [97, 98, 99], [1, 1, 1], [-100, -100, 99]), (2, [], [], [])]


def test_observed_counters(spark):
    from shirabe.operators.aggregate import observed

    df, watch = observed(spark.range(10), "o", even=F.col("id") % 2 == 0)
    assert df.count() == 10 and watch.get == {"rows": 10, "even": 5}
