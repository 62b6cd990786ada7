"""Queries over whole tables: fixtures whose keys lie above what the queries with fixed SQL read."""

import datetime

import pytest

from termloom.plans import slate
from termloom.plans import starmap as M


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("whole"))
    rows = {
        "region": ("r_regionkey int", [(i,) for i in range(5)]),
        "nation": ("n_nationkey int, n_regionkey int", [(i, (i * 3 + 1) % 5) for i in range(25)]),
        "customer": ("c_custkey long, c_nationkey int", [(k, k % 25) for k in (3, 150, 199, 200, *range(300, 460), 4999)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(k, k % 25) for k in (5, 200, 9000)]),
        "part": ("p_partkey long, p_brand string, p_type string, p_size int", [(k, f"Brand#{11 + k % 7}", M.PART_TYPES[k % 6], k % 50 + 1) for k in [*range(290, 330), 7000, 7001, 19999]]),
        "orders": ("o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate date", [(i, k, "1-URGENT", "O", datetime.date(1998, 1, 1)) for i, k in enumerate([*range(10), *range(300, 450), *range(450, 600, 3), 4999], 1)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")
    return root, {name: data for name, (_, data) in rows.items()}


def closed(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = set()
    for a in up:
        todo, seen = list(up[a]), set()
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += up.get(x, ())
        out |= {(a, x) for x in seen}
    return out


def test_classification_of_all_parts(spark, tables):
    root, t = tables
    region = dict(t["nation"])
    parts = [(M.PART + k, 5000 + int(b[6:]), 4001 + M.PART_TYPES.index(y), n) for k, b, y, n in t["part"]]
    brands = {b for _, b, _, _ in parts}
    up = {*M.FIXED, *((2000 + r, M.GEOGRAPHY) for (r,) in t["region"]), *((3000 + n, 2000 + r) for n, r in t["nation"]), *((b, M.PRODUCT) for b in brands)}
    up |= {(M.CUSTOMER + k, 3000 + n) for k, n in t["customer"]} | {(M.SUPPLIER + k, 3000 + n) for k, n in t["supplier"]} | {(p, x) for p, b, y, _ in parts for x in (b, y)}
    up |= {(p, M.TRANSACTION) for p, _, _, n in parts if n % 2 == 0 and region[n % 25] == 1} | {(b, M.TRANSACTION) for b in brands if b % 5 == 1}
    below = closed(up)
    assert {tuple(r) for r in slate.el_subsumption_all(spark, root).collect()} == below
    ups = {}
    for a, b in below:
        ups.setdefault(a, set()).add(b)
    assert {tuple(r) for r in slate.nnf_is_a_all(spark, root).collect()} == {(a, b) for a, b in below if not any(b in ups.get(x, ()) for x in ups[a])}
    want = {(p, M.HAS_SUPPLIER, 3000 + n % 25, 1) for p, _, _, n in parts} | {(p, M.PLACED_BY, 3000 + n % 25, 0) for p, _, _, n in parts if n % 2 == 0}
    want |= {(p, M.PLACED_BY, 2000 + b % 5, 0) for p, b, _, n in parts if n % 2 or region[n % 25] != b % 5} | {(b, M.PLACED_BY, 2000 + b % 5, 0) for b in brands}
    got = [tuple(r) for r in slate.nnf_attributes_all(spark, root).collect()]
    assert len(got) == len(want) and set(got) == want


def test_cycles_of_all_customers(spark, tables):
    root, t = tables
    edges = {(M.CUSTOMER + k, M.CUSTOMER + k - k % 150 + (k * 7 + 1) % 150) for _, k, *_ in t["orders"]}
    want = sorted(a for a, b in closed(edges) if a == b)
    assert sorted(r["item"] for r in slate.validate_cycles_all(spark, root).collect()) == want
    assert set(range(M.CUSTOMER + 300, M.CUSTOMER + 450)) <= set(want) and M.CUSTOMER not in want
