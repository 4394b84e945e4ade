"""Joins, merges, graph loops, searches and solvers on small fixtures and against plain Python."""

import itertools
import json
import random

from pyspark.sql import functions as F

from factloom.operators import graph, joins, merges, pointsto, trees, verify


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def reachable(pairs):
    out = set(pairs)
    while True:
        more = {(a, d) for a, b in out for c, d in pairs if b == c} - out
        if not more:
            return out
        out |= more


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def test_closure_with_cycles(spark):
    pairs = [*random_edges(12, 18, 1), (3, 3)]
    assert rows(graph.closure(edges(spark, pairs))) == sorted(reachable(pairs))
    assert rows(graph.closure(edges(spark, []))) == []


def test_components_and_strong_components(spark):
    pairs = random_edges(25, 18, 2)
    close = reachable(pairs)
    nodes = {x for p in pairs for x in p}
    both = reachable(pairs + [(b, a) for a, b in pairs])
    weak = {x: min([x, *(b for a, b in both if a == x)]) for x in nodes}
    strong = {x: min([x, *(b for a, b in close if a == x and (b, x) in close)]) for x in nodes}
    assert rows(graph.connected_components(edges(spark, [*pairs, (None, 4)]))) == sorted(weak.items())
    assert rows(graph.strong_components(edges(spark, pairs))) == sorted(strong.items())


def test_labels_levels_and_chains(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 3), (3, 5)])
    seeds = spark.createDataFrame([(1, 7), (4, 5), (4, 9)], "node long, label int")
    assert [tuple(r) for r in sorted(graph.label_bfs(seeds, e).collect())] == [(1, 5, 2, 3), (2, 5, 3, 1), (3, 5, 1, 4), (4, 5, 0, None), (5, 5, 2, 3)]
    levels = spark.createDataFrame([(1, 0), (2, 2), (3, 0), (4, 1), (5, 0)], "node long, level int")
    assert rows(graph.lattice_fixpoint(levels, e, ceiling=1)) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 1)]
    up = spark.createDataFrame([(3, 2), (2, 1), (1, None), (8, 9), (9, 8)], "node long, parent long")
    assert {r[0]: r[1] for r in graph.chains(up).collect()} == {3: [3, 2, 1], 2: [2, 1], 1: [1], 8: [8, 9], 9: [9, 8]}
    assert {r[0]: r[1] for r in graph.chains(up, most=2).collect()}[3] == [3, 2]


def test_reduction_and_late_seeds(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (2, 5), (5, 2)])
    kept = spark.createDataFrame([(1,), (4,), (5,)], "node long")
    assert rows(graph.reduce_graph(e, kept)) == [(1, 4), (1, 5), (5, 4)]
    seeds = spark.createDataFrame([("x", 5)], "source string, node long")
    late = lambda got: got.where("node = 4").select("source", F.lit(9).cast("long").alias("node"))
    assert rows(graph.reach(seeds, e, late=late)) == [("x", 2), ("x", 3), ("x", 4), ("x", 5), ("x", 9)]


def test_guarded_walk_opens_late(spark):
    e = edges(spark, [(1, 2), (3, 4)])
    guarded = spark.createDataFrame([(1, 3, "k"), (1, 8, "never")], "a long, b long, key string")
    uses = spark.createDataFrame([(2, "k")], "node long, key string")
    assert rows(graph.guarded_walk(spark.createDataFrame([(1,)], "node long"), e, guarded, uses)) == [(1,), (2,), (3,), (4,)]


def test_all_paths_owner(spark):
    own = spark.createDataFrame([(1, "algorithm"), (2, "none"), (3, "inherit"), (4, "inherit"), (5, "inherit"), (6, "inherit")], "node long, cls string")
    calls = edges(spark, [(1, 3), (1, 4), (2, 4), (5, 5), (3, 5)])
    assert rows(graph.all_paths_owner(own, calls)) == [(1, "algorithm"), (2, "none"), (3, "algorithm"), (4, "none"), (5, "algorithm"), (6, "none")]


def test_reaching_definitions(spark):
    flow = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "block long, next long")
    gen = spark.createDataFrame([(1, "x"), (2, "y")], "block long, def string")
    kill = spark.createDataFrame([(2, "x")], "block long, def string")
    assert rows(graph.reaching_definitions(flow, gen, kill)) == [(2, "x"), (2, "y"), (3, "y")]


def test_first_match_and_prefix(spark):
    r = spark.createDataFrame([(1, "c", "abc"), (2, "c", "zzz"), (3, "d", "abc")], "id long, crate string, path string")
    rules = spark.createDataFrame([(2, "c", "b", "late"), (1, "c", "^a", "early"), (3, "c", ".", "any")], "ord int, k string, pattern string, name string")
    assert rows(joins.first_match(r, rules, ["id"], [("crate", "k")], F.expr("path RLIKE pattern")), "id", "name") == [(1, "early"), (2, "any")]
    paths = spark.createDataFrame([("/a/b/c",), ("/a/bb",), ("/x",), (None,)], "p string")
    dirs = spark.createDataFrame([("/a", 1), ("/a/b", 2)], "d string, n int")
    assert {r[0]: r[2] for r in joins.longest_prefix(paths, "p", dirs, "d").collect()} == {"/a/b/c": 2, "/a/bb": 1, "/x": None, None: None}
    assert [r[1] for r in joins.longest_literal_prefix(paths, "p", [("/a", "A"), ("/a/b/", "B")]).collect()] == ["B", "A", None, None]


def test_other_joins(spark):
    calls = spark.createDataFrame([(1, "T", "s"), (2, "T", "*")], "call long, trait string, sig string")
    types = spark.createDataFrame([("T", "s", "A"), ("T", "*", "B"), ("U", "s", "C")], "trait string, sig string, ty string")
    assert rows(joins.dispatch(calls, types), "call", "ty") == [(1, "A"), (1, "B"), (2, "B")]
    pc = spark.createDataFrame([(1, 2, "s"), (2, 2, "s"), (3, 1, "*")], "call long, arity int, sig string")
    named = spark.createDataFrame([(1, "f")], "call long, function string")
    fns = spark.createDataFrame([("f", 2, "s"), ("g", 2, "*"), ("h", 1, "q")], "function string, arity int, sig string")
    assert rows(joins.pointer_targets(pc, named, fns)) == [(1, "f", False), (2, "f", True), (2, "g", True), (3, "h", True)]


def test_merges(spark):
    e = spark.createDataFrame([("a", 1, "x", True), ("a", 3, "y", True), ("b", 2, "x", False)], "k string, tier int, f string, ok boolean")
    assert rows(merges.merge_evidence(e, ["k"], greatest=["tier"], sets=["f"], every=["ok"])) == [("a", 2, 3, "x,y", True), ("b", 1, 2, "x", False)]
    assert rows(e.groupBy("k").agg(merges.prefer(F.col("f"), F.col("tier") > 2))) == [("a", "y"), ("b", "x")]
    ranges = spark.createDataFrame([("a", 0, 4, 8), ("a", 3, None, 8), ("b", 0, 3, 8), ("b", 4, 8, 8), ("c", 1, 8, 8)], "k string, lo long, hi long, n long")
    assert rows(merges.interval_cover(ranges, ["k"])) == [("a", True), ("b", False), ("c", False)]
    verdict = spark.createDataFrame([(["A"], ["B"], ["A"]), (["A"], ["B"], ["C"]), (["A"], [], ["unknown"]), (["A"], ["B"], ["B"]), (["A", "D"], [], ["A"]), (["A"], [], []), ([], [], [])], "must array<string>, may array<string>, got array<string>")
    assert [r[0] for r in verdict.select(merges.set_verdict(F.col("must"), F.col("may"), F.col("got"))).collect()] == ["correct", "wrong", "honest-unknown", "wrong", "miss", "miss", "correct"]
    diff = merges.two_way_diff(spark.createDataFrame([(1,), (2,), (2,)], "x long"), spark.createDataFrame([(2,), (3,), (3,)], "x long"))
    assert rows(diff) == [(1, "-"), (3, "+")]


DATA = lambda p: {"Data": {"def": {"path": p, "krate": {"name": "k"}}}}


def origin_nodes(spark, values):
    return trees.flatten_origins(spark.createDataFrame([(i, json.dumps(v)) for i, v in values.items()], "root_id long, origin string"))


def test_value_search(spark):
    values = {
        1: {"Any": [DATA("A"), {"Call": {"callee": "wrap", "krate": "std", "args": [{"Param": {"index": 0, "owner": "f"}}, DATA("no")]}}]},
        2: DATA("B"),
        3: {"Call": {"callee": "mystery", "krate": "x", "args": []}},
        4: {"Field": {"adt": "S", "field": 1, "base": "Unknown"}},
        5: {"Any": [{"Param": {"index": 0, "owner": "g"}}, "Truncated"]},
        6: {"Param": {"index": 0, "owner": "loop"}},
    }
    nodes = origin_nodes(spark, values)
    frame = lambda schema, *r: spark.createDataFrame(list(r), schema)
    found, gaps = trees.search_values(frame("start long, root_id long", *[(i, i) for i in values]), nodes, frame("callee string, slots array<long>", ("wrap", [0])), frame("owner string, ord long, root_id long", ("f", 0, 2), ("loop", 0, 6)), frame("name string, field long, root_id long", ("S", 1, 2)), frame("callee string, root_id long"))
    assert rows(found, "start", "found", "via") == [(1, "A", "here"), (1, "B", "argument"), (2, "B", "here"), (4, "B", "stored")]
    assert rows(gaps) == [(3, "call not modelled: mystery"), (5, "parameter of g without callers"), (5, "truncated value")]
    assert rows(trees.tree_size(nodes, 3)) == [(1, 4), (2, 1), (3, 1), (4, 2), (5, 3), (6, 1)]
    assert rows(trees.cap_depth(nodes, 1).where("root_id = 1"), "node_id", "kind") == [(0, "Any"), (1, "Data"), (2, "Truncated")]
    assert rows(trees.descriptors(nodes)) == [(1, "A"), (1, "no"), (2, "B")]
    grafted = trees.substitute(nodes, frame("root_id long, ord long, arg_root long", (1, 0, 2)), nodes)
    assert rows(grafted.where("root_id = 1"), "kind") == [("Any",), ("Call",), ("Data",), ("Data",), ("Data",)]


def test_provenance(spark):
    values = {
        1: {"Const": {"value": "5"}},
        2: {"Const": {"value": ""}},
        3: {"Call": {"callee": "rng", "krate": "r", "args": []}},
        4: {"All": [{"Const": {"value": "1"}}, {"Call": {"callee": "pass", "krate": "r", "args": ["Unknown", {"Call": {"callee": "rng", "args": []}}]}}]},
        5: {"Param": {"index": 0, "owner": "f"}},
        6: {"Param": {"index": 0, "owner": "g"}},
        7: {"Call": {"callee": "other", "args": []}},
    }
    frame = lambda schema, *r: spark.createDataFrame(list(r), schema)
    got = trees.classify_provenance(frame("start long, root_id long", *[(i, i) for i in values]), origin_nodes(spark, values), frame("callee string, class string", ("rng", "rng")), frame("callee string, slots array<long>", ("pass", [1])), frame("owner string, ord long, root_id long", ("f", 0, 1)))
    assert rows(got) == [(1, "hard-coded"), (2, "absent"), (3, "rng"), (4, "hard-coded,rng"), (5, "hard-coded"), (6, "parameter"), (7, "computed")]


def test_type_trees(spark):
    adt = lambda p, *args: {"Adt": {"krate": {"name": "k", "stable_id": "0"}, "path": p, "args": list(args)}}
    nodes = trees.flatten_types(spark.createDataFrame([(1, json.dumps({"Ref": adt("k::Gcm", adt("k::Aes"), {"Const": 12})})), (2, json.dumps({"Tuple": [adt("k::Aes"), {"Dyn": ["T"]}]}))], "root_id long, type string"))
    entries = spark.createDataFrame([("k", "Gcm", 4), ("k", "Aes", 7), ("k", "Aes", 9)], "crate string, name string, ord long")
    assert [tuple(r) for r in sorted(trees.match_types(nodes, entries).collect())] == [(1, 1, 4, None), (1, 2, 7, 4), (2, 1, 7, None)]
    assert rows(trees.type_argument(nodes.where("root_id = 1"), [1]), "node_id", "number") == [(1, "12")]


def solve(addr, copy, load, store):
    pts, cp = set(addr), set(copy)
    while True:
        new = {(d, o) for d, s in cp for v, o in pts if v == s} | pts
        more = {(d, o) for d, p in load for v, o in pts if v == p} | {(o, s) for p, s in store for v, o in pts if v == p} | cp
        if new == pts and more == cp:
            return pts
        pts, cp = new, more


def test_points_to(spark):
    rng = random.Random(5)
    v = [f"v{i}" for i in range(8)]
    pair = lambda n: sorted({(rng.choice(v), rng.choice(v)) for _ in range(n)})
    addr, copy, load, store = pair(5), pair(4), pair(3), pair(3)
    frame = lambda r, s: spark.createDataFrame(r, s)
    args = frame(addr, "v string, o string"), frame(copy, "dst string, src string"), frame(load, "dst string, ptr string"), frame(store, "ptr string, src string")
    exact = solve(addr, copy, load, store)
    assert rows(pointsto.inclusion(*args)) == sorted(exact)
    assert exact <= set(rows(pointsto.unification(*args)))
    answers = spark.createDataFrame([("f", 1, 1, "c", True, ["A"], False, 0, True), ("f", 1, 1, "c", True, ["B"], False, 0, True), ("f", 2, 1, "c", True, ["A"], True, 0, True), ("f", 3, 1, "c", False, ["A"], False, 0, True)], "file string, line long, col long, callee string, live boolean, statics array<string>, unknown boolean, others long, answered boolean")
    told = pointsto.verdicts(answers)
    assert rows(told, "line", "complete") == [(1, True), (2, False)]
    members = spark.createDataFrame([("f", 1, 1, "c", ["A", "C"]), ("f", 2, 1, "c", ["C"])], "file string, line long, col long, callee string, found array<string>")
    assert rows(pointsto.settle(members, told, ["file", "line", "col", "callee"]), "line", "found") == [(1, ["A"]), (2, ["C"])]


def test_positions_and_mutations(spark):
    lines = verify.source_lines(spark.createDataFrame([("a.rs", "let x = Aes::new();\nxAes")], "path string, text string"))
    cited = spark.createDataFrame([("a.rs", 1, 8, "k::Aes"), ("a.rs", 2, 1, "k::Aes"), ("a.rs", 1, 99, "Aes"), ("a.rs", 7, 0, "Aes")], "path string, line long, offset long, symbol string")
    assert rows(verify.verify_positions(cited, lines), "line", "offset", "verdict") == [(1, 8, "ok"), (1, 99, "beyond the line"), (2, 1, "another token"), (7, 0, "no such line")]
    good = cited.where("line = 1 AND offset = 8")
    for dl, dc in itertools.product((-1, 0, 1), (-1, 0, 1)):
        moved = good.withColumn("line", F.col("line") + dl).withColumn("offset", F.col("offset") + dc)
        assert (verify.verify_positions(moved, lines).first()["verdict"] == "ok") == (dl == dc == 0)
    lock = verify.source_lines(spark.createDataFrame([("Cargo.lock", '[[package]]\nname = "a"\nversion = "1.0.0"\n[[package]]\nname = "b"\nsource = "x"\nversion = "2"')], "path string, text string"))
    assert rows(verify.lock_entries(lock)) == [("Cargo.lock", 2, "a", "1.0.0")]
    items = spark.createDataFrame([("a.rs", "f", 1, 3)], "path string, item string, first long, last long")
    at = spark.createDataFrame([("a.rs", 2, "f"), ("a.rs", 4, "f")], "path string, line long, item string")
    assert rows(verify.inside_item(at, items), "line", "inside") == [(2, True), (4, False)]
