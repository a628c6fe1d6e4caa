"""Every rule case gives the rows worked out for it."""

import duckdb
import pytest
from rule_cases import CASES, EXPECTED
from test_oracles import plain


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    df = CASES[name](spark, None)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duckdb.sql(EXPECTED[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
