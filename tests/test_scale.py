"""What keeps plans fit for large tables: no side sent to all tasks by a wrong estimate, rows dealt evenly, no needless pass."""

import json
import random
import re

from pyspark.sql import functions as F

from factloom import session
from factloom.operators import flows, graph, joins, trees
from factloom.plans import catalog
from factloom.session import settled

DATA = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unit(name):
    return {"Data": {"def": {"path": name, "krate": {"name": "k"}}}}


def origin_nodes(spark, values):
    return trees.flatten_origins(spark.createDataFrame([(i, json.dumps(v)) for i, v in values.items()], "root_id long, origin string"))


def test_walks_through_trees_are_one_exchange_without_joins(spark):
    values = {1: {"Any": [unit("a"), {"All": [unit("b"), {"Set": [unit("c")]}]}]}, 2: {"Err": [unit("e")]}, 3: unit("d")}
    nodes, starts = origin_nodes(spark, values), spark.createDataFrame([(7, 1), (8, 1), (8, 2), (9, 3), (9, 4)], "start long, root_id long")
    ends = flows.follow(starts, nodes, flows.PLUMBING)
    assert rows(ends, "start", "root_id", "kind", "name") == [(7, 1, "Data", "a"), (7, 1, "Data", "b"), (7, 1, "Data", "c"), (8, 1, "Data", "a"), (8, 1, "Data", "b"), (8, 1, "Data", "c"), (8, 2, "Err", "null"), (9, 3, "Data", "d")]
    assert "MapInArrow" in plan(ends) and "Join" not in plan(ends) and plan(ends).count("Exchange ") == 1
    assert rows(flows.follow(starts.where("root_id = 1"), nodes, flows.PLUMBING, most=1), "start", "kind", "name") == [(7, "Data", "a"), (7, "cut", "null"), (8, "Data", "a"), (8, "cut", "null")]
    inside = spark.createDataFrame([(5, 1, 0), (5, 1, 2), (6, 1, 2)], "start long, root_id long, node_id long")
    assert rows(flows.follow(inside, nodes, flows.PLUMBING), "start", "name") == [(5, "a"), (5, "b"), (5, "c"), (6, "b"), (6, "c")]


def test_sides_and_elements(spark):
    pair = lambda *names: {"Tuple": [unit(n) for n in names]}
    values = {1: {"Any": [pair("a", "b"), {"All": [pair("c"), pair("d", "e")]}, unit("x")]}, 2: {"Any": [{"Err": [{"Any": [unit("m"), unit("n")]}]}, {"Ok": [unit("o")]}, {"MapErr": [unit("p")]}, {"Const": {"value": "7"}}]}}
    nodes, starts = origin_nodes(spark, values), spark.createDataFrame([(1, 1), (2, 2)], "start long, root_id long")
    found, gaps = flows.tuple_element(starts.where("start = 1"), nodes, 1)
    assert rows(found, "start", "name") == [(1, "b"), (1, "e")] and rows(gaps) == [(1, "no such element"), (1, "no tuple: Data")]
    found, gaps = flows.error_side(starts, nodes)
    assert rows(found) == [(2, "m"), (2, "n"), (2, "p")] and rows(gaps) == [(1, "side not recorded: Data"), (1, "side not recorded: Tuple"), (2, "side not recorded: Const")]


def test_leaves_of_a_tree_decide_whatever_other_trees_hold(spark):
    values = {1: {"Any": [unit("a"), {"Input": {"path": "argv"}}]}, 2: {"Input": {"path": "x", "base": unit("b")}}, 3: {"Tuple": [unit("c"), "Unknown"]}}
    nodes, starts = origin_nodes(spark, values), spark.createDataFrame([(i, i) for i in values], "start long, root_id long")
    assert rows(flows.depends_on_input(starts, nodes, ["Input"])) == [(1, True), (2, False), (3, False)]
    assert rows(flows.depends_on_input(starts, nodes, ["Input"], most=0)) == [(1, True), (2, True), (3, True)]


def test_walk_against_plain_python(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.choice(["Any", "All", "Tuple", "Data", "Data"]) if depth < 5 else "Data"
        return unit(f"n{rng.randrange(50)}") if kind == "Data" else {kind: [value(depth + 1) for _ in range(rng.randrange(4))]}

    def ends(v):
        kind, body = next(iter(v.items()))
        return {e for x in body for e in ends(x)} if kind in ("Any", "All") else {(kind, body["def"]["path"] if kind == "Data" else "null")}

    values = {i: value(0) for i in range(200)}
    got = flows.follow(spark.createDataFrame([(i, i) for i in values], "start long, root_id long"), origin_nodes(spark, values), flows.PLUMBING)
    assert rows(got.select("start", "kind", "name").distinct()) == sorted((i, *e) for i, v in values.items() for e in ends(v))


def test_loops_never_broadcast_by_an_estimate(spark):
    n = 3000  # the estimates of these are far below the limit of a broadcast
    up = spark.range(1, n).selectExpr("id AS callee", "id div 2 AS caller")
    plumbing = spark.range(0, n, 3).select(F.col("id").alias("node"))
    moved = graph.shifted_attribution(up, up, plumbing)
    given, bounds = spark.range(0, n, 7).selectExpr("id AS key", "string(id % 5) AS type"), spark.range(0, n, 11).selectExpr("id AS key", "array('b') AS types", "true AS open")
    told = graph.resolved_parameters(given, up.toDF("key", "from_key"), bounds)
    kept = graph.reduce_graph(up, plumbing, "callee", "caller")
    for df in (moved, told, kept):
        assert "Broadcast" not in plan(df)
    assert told.count() == n
    own = settled(spark.range(5).toDF("a"))
    assert "SortMergeJoin" in plan(own.where("a > 1").join(spark.range(9).toDF("a"), "a")) and rows(own.where("a > 1")) == [(2,), (3,), (4,)]


def test_reaching_definitions_in_words_against_plain_python(spark):
    rng = random.Random(7)
    flow = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)}
    gen = {(b, f"d{b}-{k}") for b in range(40) for k in range(rng.randrange(5))}
    names = sorted({d for _, d in gen})
    kill = {(rng.randrange(40), rng.choice(names)) for _ in range(300)} | {(1, "never made")}
    into, before = set(), None
    while into != before:
        before = set(into)
        into |= {(n, d) for b, n in flow for g, d in gen if g == b} | {(n, d) for b, n in flow for i, d in before if i == b and (b, d) not in kill}
    frame = lambda x, s: spark.createDataFrame(sorted(x), s)
    got = graph.reaching_definitions(frame(flow, "block long, next long"), frame(gen, "block long, def string"), frame(kill, "block long, def string"))
    assert len(names) > 64 and rows(got) == sorted(into)
    assert "getbit" in plan(got)


def test_values_of_statics_are_made_distinct_where_their_reader_is(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    reads = spark.range(1000).selectExpr("id AS start", "id % 3 AS static").union(spark.range(5).selectExpr("id AS start", "id % 2 AS static"))
    initial = spark.createDataFrame([(0, "a", True), (1, "b", False)], "static long, value string, interior boolean")
    stores = spark.createDataFrame([(0, "x", "w"), (0, "x", "w"), (1, "y", "v"), (2, "z", "w")], "static long, value string, writer string")
    found, gaps = flows.static_values(reads, initial, stores, spark.createDataFrame([("w",)], "writer string"))
    own, first, later = ({tuple(r) for r in x.collect()} for x in (reads, initial, stores))
    assert rows(found) == sorted({(s, v, "initial", True) for s, t in own for i, v, _ in first if i == t} | {(s, v, w, w == "w") for s, t in own for i, v, w in later if i == t})
    assert rows(gaps) == sorted({(s, "changes inside") for s, t in own if t == 0})
    assert "hashpartitioning(start#" in plan(found) and not re.search(r"hashpartitioning\(start#\w+, value", plan(found))


def test_depths_are_cut_in_one_pass_of_the_nodes(spark):
    nodes = origin_nodes(spark, {1: {"Any": [unit("a"), {"All": [unit("b")]}, {"Set": []}]}, 2: unit("c")})
    capped = trees.cap_depth(nodes, 1)
    assert rows(capped, "root_id", "node_id", "kind") == [(1, 0, "Any"), (1, 1, "Data"), (1, 2, "Truncated"), (1, 4, "Set"), (2, 0, "Data")]
    assert plan(capped).count("MapInArrow") == 1 and capped.columns == nodes.columns


def test_heavy_work_on_rows_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    told = catalog.QUERIES["strip_generics"](spark, DATA)
    assert told.rdd.getNumPartitions() == -(-catalog.read(spark, DATA, "part").count() // 100)


def test_tagged_keys_of_a_walk_are_numbers(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "reach", lambda seeds, edges, real=graph.reach: (seen.extend(edges.dtypes), real(seeds, edges))[1])
    assert catalog.QUERIES["multi_source_reach"](spark, DATA).count() == 5
    assert [t for _, t in seen] == ["bigint", "bigint"]


def test_substitution_is_one_pass_and_broadcasts_no_arguments(spark):
    nodes = origin_nodes(spark, {1: {"Any": [{"Param": {"index": 0}}, unit("a")]}, 2: {"Param": {"index": 1}}, 3: {"Param": {"index": 0}}})
    graft = origin_nodes(spark, {10: {"All": [unit("x"), unit("y")]}})
    arguments = spark.createDataFrame([(1, 0, 10), (2, 0, 10), (3, 0, 99)], "root_id long, ord long, arg_root long")
    got = trees.substitute(nodes, arguments, graft)
    assert rows(got, "root_id", "kind", "name", "depth") == [(1, "All", "null", 1), (1, "Any", "null", 0), (1, "Data", "a", 1), (1, "Data", "x", 2), (1, "Data", "y", 2), (2, "Param", "null", 0)]
    assert plan(got).count("MapInArrow") == 2 and plan(got).count("BroadcastExchange") == 1 and "SortMergeJoin" in plan(got)


def test_users_without_orders_leave_no_gap(spark, tmp_path):
    spark.createDataFrame([(1, "purchase", 7), (2, "click", 8), (3, "click", 7), (4, "error", 8)], "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(5, 7, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["value_search"](spark, str(tmp_path))
    assert rows(got) == [(1, "F,purchase", ""), (2, "", ""), (3, "F", ""), (4, "", "call not modelled: error")]


def test_products_of_hot_keys_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 16)
    monkeypatch.setattr(joins, "TASK_PAIRS", 1000)
    left = spark.range(200).selectExpr("id AS x", "IF(id % 50 = 0, NULL, IF(id < 150, 1, id)) AS k", "string(id) AS t")
    right = spark.range(90).selectExpr("IF(id % 30 = 0, NULL, IF(id < 60, 1, id * 2)) AS k", "id AS y")
    whole = left.join(right, ["k"])
    paired = joins.product(left, right, ["k"], few=0)
    assert rows(paired, "k", "x", "t", "y") == rows(whole, "k", "x", "t", "y")
    assert plan(paired).count("Generate explode") == 2 and paired.rdd.getNumPartitions() == -(-whole.count() // 1000)
    sizes = paired.groupBy(F.spark_partition_id()).count().select("count").collect()
    assert max(r[0] for r in sizes) < whole.count() / 3
    assert rows(joins.product(left, right, ["k"]), "k", "x", "t", "y") == rows(whole, "k", "x", "t", "y")


def test_pointer_targets_without_distinct_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW_PAIRS", 0)
    calls = spark.createDataFrame([(1, 2, "s"), (2, 2, "s"), (3, 1, "*"), (4, 2, "*"), (5, 2, "s"), (5, 1, "s"), (5, 2, "*"), (6, 2, None), (2, 2, "s")], "call long, arity int, sig string")
    functions = spark.createDataFrame([("f", 2, "s"), ("g", 2, "*"), ("g", 2, "s"), ("g", 2, "u"), ("h", 1, "q"), ("h", 1, "r"), ("i", 2, "u"), ("i", 2, "s"), ("f", 1, "s"), ("n", 2, None)], "function string, arity int, sig string")
    named = spark.createDataFrame([(1, "f")], "call long, function string")
    c, f = [tuple(r) for r in calls.collect()], [tuple(r) for r in functions.collect()]
    fit = {(a, g, True) for a, n, s in c for g, m, t in f if a != 1 and n == m and ((s and s == t) or (s and t == "*") or s == "*")}
    assert rows(joins.pointer_targets(calls, named, functions)) == sorted(fit | {(1, "f", False)})
