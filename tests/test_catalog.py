"""Every registered query with SQL gives the rows that the SQL gives in another engine."""

import importlib.util
import os

import pandas as pd
import pytest

from factloom.plans import catalog, catalog_flows, catalog_more  # noqa: F401  these register more queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return db


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(x) else round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def guarded_by_hand(parts):
    edges = {(p, 2 * p) for p, *_ in parts if p > 0}
    gates = {(p, 3 * p, t) for p, t, _ in parts if p > 0}
    uses = {(p, t) for p, t, s in parts if s == 1}
    reached, before = {1, 3, 5, 7}, None
    while reached != before:
        before = set(reached)
        keys = {k for n, k in uses if n in reached}
        reached |= {b for a, b in edges if a in reached} | {b for a, b, k in gates if a in reached and k in keys}
    return reached


def test_guarded_walk_by_hand(spark, duck):
    got = {r[0] for r in catalog.QUERIES["guarded_walk"](spark, DATA).collect()}
    assert got == guarded_by_hand(duck.execute("select p_partkey, p_type, p_size from part").fetchall())


def test_owner_by_hand(spark, duck):
    rank = {"algorithm": 0, "package": 1, "none": 2}
    parts = duck.execute("select p_partkey, p_size from part").fetchall()
    own = {p: "algorithm" if s > 45 else "package" if s > 40 else "none" if s < 5 else "inherit" for p, s in parts}
    callers = {p: {p // 2, p // 3} for p in own if p > 0}
    state = {p: rank[c] if c != "inherit" else 0 if callers.get(p) else 2 for p, c in own.items()}
    while True:
        new = {p: max([state[p], *(state[c] for c in callers.get(p, ()))]) if own[p] == "inherit" else state[p] for p in own}
        if new == state:
            break
        state = new
    got = {r["node"]: rank[r["owner"]] for r in catalog.QUERIES["all_paths_owner"](spark, DATA).collect()}
    assert got == state


def test_entry_points(spark):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("__spark_entry__", path)
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
