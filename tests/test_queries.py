"""Each catalogued query against its SQL, on the driver's tables where they are."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _norm(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else "~" if x is None else str(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert names == sorted(rel.columns)
    want = [tuple(r[rel.columns.index(c)] for c in names) for r in rel.fetchall()]
    assert _norm([tuple(r[c] for c in names) for r in df.collect()]) == _norm(want)


def test_edge_call_times_of_all_users(spark, tmp_path):
    rows = [(n, u, ["view", "purchase", "error"][(n * 7 + u) % 3]) for n, u in enumerate([3, 25, 3, 1000, 25, 25, 3, 1000, 19, 20, 20, 25])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"file://{tmp_path}/events.parquet")
    times, last = {}, {}
    for n, u, kind in rows:
        if u in last:
            times.setdefault((last[u], kind, u), []).append(str(n))
        last[u] = kind
    got = catalog.queries()["edge_call_times"](spark, f"file://{tmp_path}")
    assert sorted(tuple(r) for r in got.select("src", "dst", "calls", "times").collect()) == sorted((s, d, len(t), ",".join(t)) for (s, d, _), t in times.items())


@pytest.fixture(scope="module")
def few_parts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("parts")
    parts = [(1, 900.5, 10), (2, 905.25, 50), (3, 1000.0, 11), (7, 1100.5, 5), (8, 1200.0, 20), (14, 1210.75, 30)]
    lines = [(1, 1, 900.52), (1, 2, 905.27), (2, 1, 1000.0), (2, 2, 1000.06), (3, 1, 1100.55), (3, 2, 1210.79), (4, 1, None)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double, p_size int").write.parquet(f"file://{path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"file://{path}/lineitem.parquet")
    return f"file://{path}", parts, lines


def test_range_join_point_of_all_parts(spark, few_parts):
    path, parts, lines = few_parts
    got = catalog.queries()["range_join_point"](spark, path)
    assert sorted(tuple(r) for r in got.collect()) == sorted((o, n, k) for o, n, x in lines for k, lo, _ in parts if x is not None and lo <= x <= lo + 0.05)


def test_axis_transform_of_all_parts(spark, few_parts):
    path, parts, _ = few_parts
    # kept: [900, 955), [1000, 1011), [1100, 1105), [1200, 1240); gaps of 45, 89 and 95 share 5 % of the kept 111
    scale = 0.05 * 111 / 229
    starts = [(900, 955, 0.0), (1000, 1011, 55 + 45 * scale), (1100, 1105, 66 + 134 * scale), (1200, 1240, 71 + 229 * scale)]
    want = {k: next(x0 + v - a for a, b, x0 in starts if a <= v < b) for k, v, _ in parts}
    got = {r.p_partkey: r.x for r in catalog.queries()["axis_transform"](spark, path).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_counts_of_a_graph_with_mmaps(spark):
    """Two mmap results and one allocation, which the driver's tables don't have together."""
    from tracewright.operators import graph as G

    v = spark.createDataFrame([(1, "ROOT", 0, 64, 0), (2, "SETBOUNDS", 16, 8, 0)], "vid long, origin string, base long, length long, offset long")
    e = spark.createDataFrame([(1, 5, 16, 4), (2, 6, 20, 2)], "vid long, time long, addr long, type int")
    calls = spark.createDataFrame([(10, G.MMAP, "mmap"), (11, G.MMAP, "mmap"), (12, 0, "malloc")], "vid long, address long, symbol string").withColumn("t_return", F.lit(9).cast("long"))
    rows = [(0, 10, G.SYSCALL, 1, None), (0, 11, G.SYSCALL, 2, None), (1, 10, G.RETURN, 3, [3]), (2, 11, G.RETURN, 4, [3]), (2, 12, G.RETURN, 4, [3]), (2, 12, G.RETURN, 4, [5])]
    edges = spark.createDataFrame(rows, "src long, dst long, op int, time long, regs array<int>")
    r = G.statistics(G.Graph(v, e, calls, edges)).first()
    assert (r.mmaps, r.mallocs, r.set_bounds, r.deref_loads, r.stored_addresses, r.argument_readers) == (2, 1, 1, 1, 1, 1)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
