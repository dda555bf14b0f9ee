"""Spelling variants against their SQL value by value, nulls as nulls: however pandas prints a column of whole numbers with gaps."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from loomnet.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_spelling_variants_match_sql_by_value(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    right = con.execute(queries.ORACLES["op13_spelling_variants"])
    columns = [c[0] for c in right.description]
    out = queries.QUERIES["op13_spelling_variants"](spark, SF)
    assert {c: t for c, t in out.dtypes if c in ("n", "n_near", "form_n")} == {"n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    found = sorted(map(tuple, out.select(*columns).collect()), key=repr)
    assert found == sorted(right.fetchall(), key=repr)
    assert any(r[columns.index("form_n")] is None for r in found) and any(r[columns.index("form_n")] for r in found)
