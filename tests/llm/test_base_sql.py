"""The base columns of four operators give the rows that SQL gives in another engine."""

import math
import os

import pytest

from factloom.llm import queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    found = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    theirs = {r[columns.index("doc_id")]: r for r in found.fetchall()}
    ours = queries.QUERIES[name](spark, DATA).select(*columns).collect()
    assert len(ours) == len(theirs)
    for r in ours:
        want = theirs[r["doc_id"]]
        assert all(math.isclose(a, b, abs_tol=2e-3) if isinstance(b, float) else a == b for a, b in zip(r, want, strict=True)), (tuple(r), want)
