import pytest

from shirabe.llm import registry

COLUMNS = {
    "p2_found": [("fld", "string"), ("key_a", "bigint"), ("key_b", "bigint")], "p3_found": [("case_no", "bigint"), ("fld", "string"), ("pii_kind", "string"), ("pii_text", "string")],
    "p4_found": [("fld", "string"), ("seq", "bigint")], "p5_found": [("fld", "string"), ("seq", "bigint")], "p6_found": [("seq", "bigint")], "p7_found": [("fld", "string"), ("seq", "bigint"), ("ref_id", "string")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p10_found": [("doc_id_a", "bigint"), ("doc_id_b", "bigint")],
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs_with_its_columns(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
        assert len({str(r) for r in rows}) == len(rows)
