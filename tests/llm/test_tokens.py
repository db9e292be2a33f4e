import base64
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shirabe.llm.bpe import DEFAULT_VOCAB, _ship, codec, count_column, decode_column, encode_column
from shirabe.llm.packing import _best_fit, lower_bound, pack, plan_patterns

tokenizers = pytest.importorskip("tokenizers")
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "日", "本", "ｶﾞ", "🙂", "​", "'s", "12", "!?", "<|endoftext|>", "aaaa", "\x00", "ー", "・"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCAB.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_library(reference):
    rng, c = random.Random(3), codec()
    for _ in range(3000):
        s = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        ids = c.encode(s)
        assert ids == reference.encode(s, add_special_tokens=False).ids
        assert c.decode(ids) == s
    long = "abcab" * 40_000 + "日本" * 20_000
    assert c.encode(long) == reference.encode(long, add_special_tokens=False).ids


def test_whole_table(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.ids for r in encode_column(docs, "doc_id", "text").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id] == reference.encode(r.text or "", add_special_tokens=False).ids for r in rows)


def test_null_empty_and_round_trip(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "日本 🙂 <|endoftext|>", "x"), (3, "twice", "x")], "k int, text string, ids string")
    ids = encode_column(df, "k", "text")
    assert sorted((r.k, len(r.ids)) for r in ids.collect())[:2] == [(1, 0), (2, 0)]
    assert {r.text for r in decode_column(ids, "k", "ids").where("k = 3").collect()} == {"日本 🙂 <|endoftext|>", "twice"}
    assert {r.n for r in count_column(df, "k", "text", out="n").where("k < 3").collect()} == {0}
    assert encode_column(df.where("false"), "k", "text").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_the_histogram(seed):
    rng = random.Random(seed)
    hist = {rng.randint(1, 100): rng.randint(1, 400 if seed % 2 else 3) for _ in range(rng.randint(1, 60))}
    plan = plan_patterns(hist, 100, rounds=40)
    held: dict[int, int] = {}
    for pattern, times in plan:
        assert sum(s * a for s, a in pattern) <= 100 and times > 0
        for s, a in pattern:
            held[s] = held.get(s, 0) + a * times
    assert held == hist
    used = sum(t for _, t in plan)
    assert used >= lower_bound(hist, 100)
    alone = sum(n for s, n in hist.items() if s > 50)
    assert used <= max(lower_bound(hist, 100), alone) * 1.25 + 2


def one_by_one(demand, capacity):
    rooms = []
    for size in sorted(demand, reverse=True):
        for _ in range(demand[size]):
            fit = [r for r in rooms if r >= size]
            room = min(fit) if fit else capacity
            if fit:
                rooms.remove(room)
            rooms.append(room - size)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_by_classes_equals_one_by_one(seed):
    rng = random.Random(seed)
    demand = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 25))}
    boxes = _best_fit(demand, 100)
    assert sorted(100 - sum(s * a for s, a in p) for p, n in boxes.items() for _ in range(n)) == one_by_one(demand, 100)


def test_work_depends_on_lengths_not_on_items():
    began = time.process_time()
    plan = plan_patterns({1100: 300_000_000, 1030: 200_000_000, 7: 5}, 2048)
    assert sum(n for _, n in plan) == 500_000_000 and time.process_time() - began < 20


def test_packing_a_table(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 3, 17, 40, 64, 65, 200, None, 128]) for i in range(3000)}
    df = spark.createDataFrame([(i, n, 0, 0) for i, n in sizes.items()], "k int, n int, piece int, container int").repartition(7)
    out = pack(df, "k", "n", 64).collect()
    fill: dict[int, int] = {}
    total: dict[int, int] = {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.n
        total[r.k] = total.get(r.k, 0) + r.n
        assert sizes[r.k] > 64 or r.piece == 0
    assert max(fill.values()) <= 64 and total == {k: n for k, n in sizes.items() if n}
    assert len({(r.k, r.piece) for r in out}) == len(out)
    assert pack(df.where("false"), "k", "n", 64).count() == 0


def test_one_length_for_all(spark):
    df = spark.range(1000).select("id", F.lit(30).alias("n"))
    assert pack(df, "id", "n", 100).select("container").distinct().count() == 334


def test_the_vocabulary_travels_with_the_job(spark, tmp_path):
    path = tmp_path / "tiny.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" " + str(b).encode() for b in range(256)))
    df = spark.createDataFrame([(1, "ab")], "k int, text string")
    assert encode_column(df, "k", "text", vocab=str(path)).first().ids == [97, 98]
    local = _ship(df, str(path))
    path.rename(tmp_path / "elsewhere")  # as on an executor that does not have the path
    assert spark.range(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(codec(local()).words)])], ["n"]) for _ in batches), "n bigint").first().n == 256
