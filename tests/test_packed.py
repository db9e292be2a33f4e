import pytest

from shirabe.operators.packed import infer_separators, split_packed

SCHEMA = "id bigint, f string, item_pos string, src string"


def rows(df):
    return sorted((r[0], r[1], r[2]) for r in df.collect())


def test_mixed_separators_quotes_and_brackets(spark):
    data = [
        (1, "HP:1;HP:22", "x", "a"), (2, " ['HP:3', 'HP:44'] ", "x", "a"), (3, '"HP:5 (a, b)", HP:6,', None, "a"), (4, '"HP:7 ""x; y""";"HP:8"', "x", "a"),
        (5, "HP:9、HP:10　HP:11\tHP:12", "x", "a"), (6, None, "x", "a"), (7, "  ", "x", "a"), (8, "hp_13", "x", "a"), (9, ",, HP:14 ;;HP:15|", "x", "a"), (10, '""; HP:16', "x", "a"),
        (11, "HP:17", "x", "a"), (12, "HP:18", "x", "a"), (13, "HP:19|HP:20", "x", "a"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    got = rows(split_packed(df, "id", "f"))
    by = {}
    for k, p, v in got:
        by.setdefault(k, []).append((p, v))
    assert by[1] == [(1, "HP:1"), (2, "HP:22")]
    assert by[2] == [(1, "HP:3"), (2, "HP:44")]
    assert by[3] == [(1, "HP:5 (a, b)"), (2, "HP:6")]
    assert by[4] == [(1, 'HP:7 "x; y"'), (2, "HP:8")]
    assert [v for _, v in by[5]] == ["HP:9", "HP:10", "HP:11", "HP:12"]
    assert 6 not in by and 7 not in by
    assert by[8] == [(1, "hp_13")]
    assert by[9] == [(1, "HP:14"), (2, "HP:15")]
    assert by[10] == [(1, "HP:16")]


def test_separators_of_a_source(spark):
    data = [(i, f"a{i}/x;a{i + 1}/x", None, "one") for i in range(30)] + [(100 + i, f"b {i}|b {i + 1}|b {i + 2}", None, "two") for i in range(30)] + [(200 + i, f"b {i}", None, "two") for i in range(30)]
    df = spark.createDataFrame(data, SCHEMA)
    seps = infer_separators(df, "f", ["src"])
    assert ";" in seps[("one",)] and "/" not in seps[("one",)]
    assert "|" in seps[("two",)] and " " not in seps[("two",)]
    got = rows(split_packed(df, "id", "f", ["src"]))
    assert (100, 2, "b 1") in got and (0, 1, "a0/x") in got


@pytest.mark.parametrize("data", [[], [(1, None, None, None)], [(1, "", None, None), (1, " ", None, None)]])
def test_empty_and_null_tables(spark, data):
    assert split_packed(spark.createDataFrame(data, SCHEMA), "id", "f").count() == 0


def test_repeated_rows_and_long_texts(spark):
    long = ";".join(f"HP:{i}" for i in range(5000))
    df = spark.createDataFrame([(1, long, None, None), (1, "HP:1;HP:2", None, None), (1, "HP:1;HP:2", None, None)], SCHEMA)
    assert split_packed(df, "id", "f").count() == 5004


@pytest.mark.parametrize(("fields", "seps"), [
    (["2024-01-05;2024-02-06", "2024-03-01", "2023-11-30;2024-01-01;2024-01-02"], [";"]),
    (["1.5,2.5", "3.25", "0.5,1.0,12.75"], [","]),
    (["12:30;8:15", "7:05", "9:00;10:45;23:59"], [";"]),
    (["2024-01-05 12:30;2024-02-06 08:15", "2024-03-01 10:00"], [";"]),
    (["a_1|b_22", "c_3", "d_4|e_5|f_6"], ["|"]),
    (["1,2,3", "4,5,6", "7,8,9"], [","]),
    (["1.5", "22.75"], []), (["12,7", "3;4;5", "6"], [",", ";"]), (["abc", "d"], []),
    (['"x y","z"', '"u","v (w)","t"', '"s"'], [","]), (['"x","y","z"', '"x","y"'] + ["HP:1;HP:2", "HP:3", "HP:4;HP:5;HP:6"] * 5, [",", ";"]),
])
def test_signs_inside_values_are_no_separators(spark, fields, seps):
    df = spark.createDataFrame([(i, f, None, None) for i, f in enumerate(fields * 3)], SCHEMA)
    assert infer_separators(df, "f") == {(): seps}


def test_sources_differ_and_share_a_table(spark):
    data = [(i, f"2024-01-0{i % 9 + 1}" + "|2023-12-24" * (i % 3), None, "dates") for i in range(30)] + [(100 + i, "1.5" + ",22.75" * (i % 4), None, "numbers") for i in range(30)] + [(200, "x|y", None, None), (201, "z", None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    assert infer_separators(df, "f", ["src"]) == {("dates",): ["|"], ("numbers",): [","], (None,): ["|"]}
    by = {}
    for k, p, v in rows(split_packed(df, "id", "f", ["src"])):
        by.setdefault(k, []).append(v)
    assert by[2] == ["2024-01-03", "2023-12-24", "2023-12-24"] and by[103] == ["1.5", "22.75", "22.75", "22.75"] and by[200] == ["x", "y"]


def test_more_than_32_signs_inside_values(spark):
    signs = [chr(c) for c in range(0x2460, 0x2460 + 40)]
    df = spark.createDataFrame([(i, ";".join(f"a{signs[(i + j) % 40]}7" for j in range(i % 4 + 1)), None, None) for i in range(160)], SCHEMA)
    assert infer_separators(df, "f") == {(): [";"]}
