"""Queries over release files that they write themselves, against their SQL."""

import duckdb
import pytest

from termloom.plans import releases, slate  # noqa: F401


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("star"))
    rows = [(k, f"Customer#{k:09}") for k in range(40)]
    # two partitions, so that a record type has two files
    spark.createDataFrame(rows, "c_custkey long, c_name string").repartition(2).write.parquet(f"{root}/customer.parquet")
    return root


@pytest.mark.parametrize("name", ["release_json", "release_report", "release_latest", "release_history", "owl_expressions", "release_names"])
def test_release_queries_equal_their_sql(spark, customers, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{customers}/customer.parquet/*.parquet'")
    found = slate.QUERIES[name](spark, customers)
    want = con.execute(slate.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(found.columns)
    shown = lambda rows: sorted(map(repr, rows))
    assert shown(tuple(r[c] for c in cols) for r in found.collect()) == shown(want.fetchall())
