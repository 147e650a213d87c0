"""Every registered query of the library against its SQL, over the smallest given tables."""

import glob
import os

import duckdb
import pytest

from junctura.plans import archives, basic, curate, domain, overlay, rules  # noqa: F401
from junctura.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda rs: sorted((tuple(plain(v) for v in r) for r in rs), key=repr)
    assert rows(tuple(r) for r in got.select(*(f"`{n}`" for n in names)).collect()) == rows(cur.fetchall())


def test_components_of_orders_and_parts(spark, duck):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for order, part in duck.execute("select distinct l_orderkey, l_partkey from lineitem").fetchall():
        a, b = root(2 * order), root(2 * part + 1)
        parent[max(a, b)] = min(a, b)
    assert {(r.id, r.component) for r in QUERIES["graph_components"](spark, DATA).collect()} == {(x, root(x)) for x in parent}


def test_rounded_zero_has_no_sign(spark, tmp_path):
    """A balance of -0.0, as rounding leaves it, is zero as text on both sides."""
    con = duckdb.connect()
    con.execute("create table customer as select k as c_custkey, 'MACHINERY' as c_mktsegment, v::double as c_acctbal from (values (1, '-0.0'), (2, '0.0'), (3, '-0.01'), (4, '12.5')) t(k, v)")
    con.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    got = {r.c_custkey: r.rounded for r in QUERIES["fil_coalesce_round"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[2] for r in con.execute(SQL["fil_coalesce_round"]).fetchall()} and got[1] == got[2] == "0.000000"


def test_queries_without_sql_are_few():
    assert set(QUERIES) - set(SQL) == {"fn_sequence_ratio", "graph_components"}


def test_rules_of_workspaces_read_stored_tables(spark):
    """Orders are joined with lines once for all rules."""
    assert not [f for f in QUERIES["workspace_violations"](spark, DATA).inputFiles() if DATA in f]
