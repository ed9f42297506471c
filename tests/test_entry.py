"""The driver contract: names, columns and results of the queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from cutweave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_whole_edge_list_is_written_and_read(spark, sf_dir):
    want = catalogue.customer_nation(spark, sf_dir).edges.collect()
    assert max(r["dst"] for r in want) >= 200
    assert sorted(catalogue.QUERIES["edge_list_round_trip"](spark, sf_dir).collect()) == sorted(want)


def test_whole_halves_are_paired(spark):
    for s in (1, 2, 301, 400):
        v = spark.range(s).selectExpr("0L as cluster", "id as eid", "0 as k", "cast(id % 7 as double) as x")
        pairs = [(r["a"], r["b"]) for r in catalogue.halves_of(v).collect()]
        assert len(pairs) == s // 2 and len({e for p in pairs for e in p}) == 2 * (s // 2)


def test_average_of_edges_with_the_same_number(spark, tmp_path):
    """Edges 2-100009 and 3-6 of one cluster have the same number: rows as many as in the SQL."""
    con = duckdb.connect()
    con.execute("create table lineitem as select * from (values (1, 50004), (3, 1), (1, 7), (1, 9), (5, 12), (5, 33), (5, 34)) t(l_suppkey, l_partkey)")
    con.execute("create table supplier as select distinct l_suppkey as s_suppkey from lineitem")
    con.execute("create table part as select distinct l_partkey as p_partkey from lineitem")
    for t in ("lineitem", "supplier", "part"):
        con.execute(f"copy (select columns(*)::bigint from {t}) to '{tmp_path}/{t}.parquet' (format parquet)")
    got = [tuple(r) for r in catalogue.QUERIES["matching_average"](spark, str(tmp_path)).select("cluster", "eid", "k", "x").collect()]
    want = con.execute(f"select cluster, eid, k, x from ({catalogue.ORACLE_SQL['matching_average']})").fetchall()
    assert len(want) > 21 and sorted(got) == sorted(want)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_graph_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = [tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()]
    text = lambda rows: sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert sorted(names) == sorted(df.columns)
    assert text(got) == text(want)
