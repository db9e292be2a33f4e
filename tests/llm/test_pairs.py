import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from shirabe.llm.neardup import _keys, components, gram_sets, near_groups, near_pairs
from shirabe.llm import neardup, spans
from shirabe.llm.spans import covered, expand_pairs, shared_intervals, shared_links, text_classes, without_repeats


def grams(texts):
    return {t[i : i + 2] for t in texts if t for i in range(len(t) - 1)}


def near_brute(rows):
    sets = {k: grams(v) for k, v in rows if v and any(t and t.strip() for t in v)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])}


def edited(rng, s):
    s = list(s)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(s) + 1)
        s[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "あ", "zz"])
    return "".join(s)


def pairs_of(df, rows):
    links, classes = near_pairs(df, "key", "v")
    return sorted(tuple(r) for r in expand_pairs(links, classes, "a", "b").collect())


@pytest.mark.parametrize("seed", range(3))
def test_near_pairs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzかきくけこ") for _ in range(rng.choice([2, 3, 5, 8, 20, 60, 150]))) for _ in range(25)]
    rows = [(i, [edited(rng, rng.choice(base))]) for i in range(160)] + [(500, None), (501, []), (502, [None]), (503, [" "]), (504, ["a"]), (505, [""])]
    rows += [(600 + i, [rng.choice(base), None, rng.choice(base)]) for i in range(20)]
    df = spark.createDataFrame([(k, v, "extra") for k, v in rows], "key bigint, v array<string>, k string")
    got = pairs_of(df, rows)
    assert len(got) == len(set(got)) and set(got) == near_brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_sparse_sets_lose_no_link(spark, seed):
    """Sets just large enough for two or three fragments, so that many parts are empty or hold one n-gram."""
    rng = random.Random(10 + seed)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(9, 26))) for _ in range(40)]
    rows = [(i, [edited(rng, rng.choice(base))]) for i in range(400)]
    assert set(pairs_of(spark.createDataFrame(rows, "key bigint, v array<string>"), rows)) == near_brute(rows)


def test_records_poor_in_one_fragment_do_not_meet():
    """Twice the records, about twice the meetings: no key gathers unrelated records."""
    rng = random.Random(4)

    def meetings(n):
        owner, gram = gram_sets([["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))] for _ in range(n)])
        own, keys, full = _keys(owner, gram, np.bincount(owner, minlength=n), 4, 5)
        _, at = np.unique(keys, return_inverse=True)
        return float((np.bincount(at, weights=full) * (np.bincount(at) - 1)).sum()), np.bincount(at).max()

    (_, _), (many, largest) = meetings(2000), meetings(8000)
    assert largest < 40 and many < 8000 * 12


def written(monkeypatch):
    """Of every table that ``neardup`` writes: name, rows and bytes."""
    out, write = [], neardup.materialize

    def spy(df, name, **kw):
        table = write(df, name, **kw)
        files = Path(table._shirabe_path.removeprefix("file://")).glob("*.parquet")
        out.append((name, table.count(), sum(f.stat().st_size for f in files)))
        return table

    monkeypatch.setattr(neardup, "materialize", spy)
    return out


def test_keys_that_meet_none_are_not_written(spark, monkeypatch):
    rng = random.Random(12)
    texts = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(80)) for _ in range(2000)]
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts + [t + "。" for t in texts[:20]])], "key bigint, v array<string>")
    tables = written(monkeypatch)
    links, _ = near_pairs(df, "key", "v")
    assert sorted((r.a, r.b) for r in links.collect()) == [(i, 2000 + i) for i in range(20)]
    assert max(size for _, _, size in tables) < 400 * 2020  # one row per key: 835 bytes a record


def test_large_sets_with_common_parts_are_no_candidates(spark, monkeypatch):
    """Half of the n-grams in common, which a sketch of 64 bits cannot tell from four fifths."""
    rng = random.Random(13)
    text = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    pool = [text(40) for _ in range(5)]
    rows = [(i, [*rng.sample(pool, 4), text(60)]) for i in range(150)]
    rows += [(1000, [*rows[0][1][:4], rows[0][1][4] + "。"])]
    tables = written(monkeypatch)
    links, _ = near_pairs(spark.createDataFrame(rows, "key bigint, v array<string>"), "key", "v")
    assert [(r.a, r.b) for r in links.collect()] == [(0, 1000)] and {(0, 1000)} == near_brute(rows)
    assert sum(n for name, n, _ in tables if name == "near-candidates") < 20


def test_the_passes_hold_every_key_once():
    rng = random.Random(5)
    owner, gram = gram_sets([["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 200)))] for _ in range(60)])
    sizes = np.bincount(owner, minlength=60)
    found = [list(zip(*(x.tolist() for x in _keys(owner, gram, sizes, 4, 5, *turn)))) for turn in [(0, 1), *((i, 3) for i in range(3))]]
    assert sorted(found[0]) == sorted(found[1] + found[2] + found[3])


def test_no_gram_spans_two_elements():
    owner, gram = gram_sets([["ab", "cd"], ["abcd"], [None, "", "x"]])
    assert [int((owner == i).sum()) for i in range(3)] == [2, 3, 0] and len(gram) == 5


def test_groups_and_hot_copies(spark):
    same = "この文は何度も同じまま届くので代表だけを比べる"
    data = [(i, [same]) for i in range(400)] + [(900, [same + "。"]), (901, ["全く違う別の文章がここにあるだけのこと"])]
    got = {r.key: r for r in near_groups(spark.createDataFrame(data, "key bigint, v array<string>"), "key", "v").collect()}
    assert got[399].group_key == 0 and got[900].group_key == 0 and got[901].group_key == 901
    assert got[0].n_links == 400 and got[900].n_links == 400 and got[901].n_links == 0


def test_repeated_keys_and_null_keys(spark):
    a, b = "何度も届く同じ文章の例です", "何度も届く同じ文章の例です。"
    df = spark.createDataFrame([(1, [a]), (1, [a]), (1, [b]), (2, [b]), (None, [a]), (3, None)], "key bigint, v array<string>")
    assert pairs_of(df, None) == [(1, 2)]
    long = "長い文章が二つの記録にそのまま入っている場合を確かめる。" * 10
    docs = spark.createDataFrame([(1, long + "甲"), (1, long + "甲"), (2, "乙" + long), (None, long), (3, None)], "doc_id bigint, text string")
    links = shared_links(docs, "doc_id", "text", 200)
    assert [tuple(r) for r in expand_pairs(links, text_classes(docs, "doc_id", "text", 200), "x", "y").collect()] == [(1, 2)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)], "a bigint, b bigint")
    got = {r.k: r.group for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in (100, 101, 102))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "key bigint, v array<string>")
    assert near_groups(df, "key", "v").count() == 0
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert shared_links(docs, "doc_id", "text").count() == 0 and shared_intervals(docs, "doc_id", "text").count() == 0
    assert without_repeats(docs, "doc_id", "text").count() == 0


def runs_brute(rows, n):
    by = defaultdict(set)
    for k, t in rows:
        for i in range(len(t or "") - n + 1):
            by[t[i : i + n]].add(k)
    return {(a, b) for s in by.values() for a in s for b in s if a < b}


@pytest.mark.parametrize("many", [0, 64])
@pytest.mark.parametrize("seed", range(4))
def test_shared_runs_against_brute_force(spark, seed, many, monkeypatch):
    monkeypatch.setattr(spans, "MANY", many)
    rng = random.Random(seed)
    alphabet = ["ab. ", "漢字、かな。", "abcdefgh", "x"][seed]
    text = lambda n: "".join(rng.choice(alphabet) + rng.choice("qwertyui") for _ in range(n))
    pool = [text(150) for _ in range(6)]
    rows = []
    for i in range(60):
        p = rng.choice(pool)
        lo = rng.randint(0, 60)
        cut = p[lo : lo + rng.randint(195, 240)]
        rows.append((i, text(rng.randint(0, 80)) + cut + text(rng.randint(0, 80))))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "short"), (104, "a" * 500), (105, "b" + "a" * 450), (106, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    links = shared_links(df, "doc_id", "text", 200)
    got = [tuple(r) for r in expand_pairs(links, text_classes(df, "doc_id", "text", 200), "x", "y").collect()]
    assert len(got) == len(set(got)) and set(got) == runs_brute(rows, 200)


@pytest.mark.parametrize("many", [0, 64])
def test_coverage_against_brute_force(spark, many, monkeypatch):
    monkeypatch.setattr(spans, "MANY", many)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abc。 いろは") for _ in range(n))
    shared = text(320)
    rows = [(1, text(100) + shared + text(50)), (2, shared[:260]), (3, text(300)), (4, None), (5, text(30) + shared[40:] + text(10)), (6, "z" * 250), (7, "z" * 250)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in covered(shared_intervals(df, "doc_id", "text", 200), text_classes(df, "doc_id", "text", 200), df, "doc_id", "text").collect()}
    where = defaultdict(set)
    for k, t in rows:
        for i in range(len(t or "") - 199):
            where[t[i : i + 200]].add(k)
    for k, t in rows:
        inside, later = set(), set()
        for i in range(len(t or "") - 199):
            others = where[t[i : i + 200]] - {k}
            if others:
                inside.update(range(i, i + 200))
            if any(o < k for o in others):
                later.update(range(i, i + 200))
        assert got[k].shared_chars == len(inside)
        assert got[k].first_chars == len(t or "") - len(later)


def test_a_common_footer_makes_no_pairs(spark):
    """A run of 150 characters in every text: no text is paired, and rows grow with the texts, not with their square."""
    rng = random.Random(2)
    footer = "この文書は院内の共有文書であり外部への持ち出しを禁ずる。" * 6
    rows = [(i, "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(80)) + footer[:150] + "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(80))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert shared_links(df, "doc_id", "text", 200).count() == 0
    assert spans._stretches(spans._hits(df, "doc_id", "text", 200), 200).count() <= 300 * 200 * 20


def test_texts_alike_far_beyond_a_run_are_linked(spark, monkeypatch):
    monkeypatch.setattr(spans, "MANY", 0)
    rng = random.Random(8)
    same = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(900))
    rows = [(i, same + chr(0x3042 + i)) for i in range(6)]
    assert shared_links(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 200).count() == 15


def test_repeated_sentences_go(spark):
    rng = random.Random(6)
    sentence = lambda: "".join(rng.choice("あいうえおかきくけこ漢字") for _ in range(60)) + "。"
    shared, own = [sentence() for _ in range(5)], [sentence() for _ in range(4)]
    rows = [(1, own[0] + "".join(shared)), (2, own[1] + "".join(shared) + own[2]), (3, own[3]), (4, None), (5, own[1] + "".join(shared) + own[2]), (6, "")]
    got = {r.doc_id: r.kept for r in without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 200).collect()}
    assert got == {1: rows[0][1], 2: own[1] + own[2], 3: own[3], 4: None, 5: "", 6: ""}
