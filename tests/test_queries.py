"""Every registered query of the library's own operators runs and has an oracle with its columns."""

import pytest

from sieveline import answer_queries, filter_queries, linter_queries, order_queries, overview_queries, parser_queries, queries, report_queries, scalar_queries, source_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    norm = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    a = sorted([tuple(str(norm(r[c])) for c in cols) for r in got.collect()])
    order = [want.columns.index(c) for c in cols]
    b = sorted([tuple(str(norm(r[k])) for k in order) for r in want.fetchall()])
    assert a == b
