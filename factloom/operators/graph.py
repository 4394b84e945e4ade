"""Recursive operators: closures, label propagation, lattice fixpoints and components as loops over DataFrames.

Every loop materialises a round in the shared checkpoint folder, so that plans stay short and a lost executor costs
one round. Rounds exchange only keys and labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.joins import product
from factloom.operators.merges import numbered
from factloom.session import cut, settled


COMPACT_ROUNDS = 8


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """node and component (the least node that links reach) of every node that an edge names.

    Each round, every node points to its least neighbour, pointers are followed to their ends by doubling, and edges
    are contracted to these ends. Self-loops name their node; null ends are dropped. most: edges that there are at most,
    where that is known.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    live = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), most)
    nodes = 2 * live.count()
    labels = cut(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node")), nodes)
    live = live.where("a < b")
    while n := live.count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).select(F.col("a").alias("from"), "to"), 2 * n)
        while True:
            onward = points.select(F.col("from").alias("via"), F.col("to").alias("end"))
            further = cut(points.join(onward, points["to"] == onward["via"]).select("from", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), 2 * n)
            moved = not further.where("moved").isEmpty()
            points = further.select("from", "to")
            if not moved:
                break
        first = points.toDF("a", "a_to")
        second = points.toDF("b", "b_to")
        live = cut(live.join(first, "a").join(second, "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), n)
        ends = points.toDF("component", "to")
        labels = cut(labels.join(ends, "component", "left").select("node", F.coalesce("to", "component").alias("component")), nodes)
    return labels


def fixpoint(seed: DataFrame, step, key: list[str], max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows, the rows cut off by max_rounds) of a semi-naive iteration: step(frontier) derives rows with the
    seed's columns, and those whose key is new are the next frontier. Cycles end by the seen set."""
    seen = settled(seed.dropDuplicates(key))
    frontier, rounds = seen, 0
    while not frontier.isEmpty():
        fresh = step(frontier).dropDuplicates(key).join(seen.select(*key).hint("merge"), key, "left_anti")
        fresh = settled(fresh.select(*seen.columns))
        if rounds == max_rounds:
            return seen, fresh
        # Only what is new is written; the parts are written together now and then, so that plans stay short.
        seen = seen.unionByName(fresh)
        frontier, rounds = fresh, rounds + 1
        if rounds % COMPACT_ROUNDS == 0:
            seen = settled(seen)
    return seen, frontier


def _edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    return settled(edges.select(F.col(a).alias("e_from"), F.col(b).alias("e_to")).where("e_from IS NOT NULL AND e_to IS NOT NULL").distinct())


def closure(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int | None = None) -> DataFrame:
    """All pairs (a, b) with a path of one edge or more from a to b."""
    live = _edges(edges, a, b)
    seed = live.select(F.col("e_from").alias("a"), F.col("e_to").alias("b"))

    def step(frontier):
        return frontier.join(live, frontier["b"] == live["e_from"]).select("a", F.col("e_to").alias("b"))

    return fixpoint(seed, step, ["a", "b"], max_rounds)[0].toDF(a, b)


def reach(seeds: DataFrame, edges: DataFrame, source: str = "source", node: str = "node", a: str = "a", b: str = "b", late=None) -> DataFrame:
    """(source, node) for every node that a source's seeds lead to, the seeds included. late(reached) may add seeds
    that depend on what was reached, until it adds none."""
    live = _edges(edges, a, b)

    def step(frontier):
        return frontier.join(live, frontier["node"] == live["e_from"]).select("source", F.col("e_to").alias("node"))

    start = seeds.select(F.col(source).alias("source"), F.col(node).alias("node"))
    reached, _ = fixpoint(start, step, ["source", "node"])
    while late is not None:
        more = settled(late(reached).select("source", "node").join(reached, ["source", "node"], "left_anti"))
        if more.isEmpty():
            break
        reached, _ = fixpoint(reached.unionByName(more), step, ["source", "node"])
    return reached.toDF(source, node)


def label_bfs(seeds: DataFrame, edges: DataFrame, node: str = "node", label: str = "label", a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the least that reaches the node), hops (fewest with that label) and parent (the least predecessor
    on such a path; null at seeds)."""
    live = _edges(edges, a, b)
    best = seeds.groupBy(F.col(node).alias("node")).agg(F.min(F.struct(F.col(label).alias("label"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast(dict(seeds.dtypes)[node]).alias("parent"))).alias("s"))
    state = frontier = settled(best)
    rounds = 0
    while not frontier.isEmpty():
        sent = frontier.join(live, frontier["node"] == live["e_from"]).groupBy(F.col("e_to").alias("node")).agg(F.min(F.struct(F.col("s.label").alias("label"), (F.col("s.hops") + 1).alias("hops"), frontier["node"].alias("parent"))).alias("t"))
        known = state.join(sent.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.min("s").alias("s"))
        better = F.col("s").isNull() | (F.struct("t.label", "t.hops") < F.struct("s.label", "s.hops"))
        frontier = settled(sent.join(known.hint("merge"), "node", "left").where(better).select("node", F.col("t").alias("s")))
        # Only what is better is written; the least of a node's states is its own.
        state, rounds = state.unionByName(frontier), rounds + 1
        if rounds % COMPACT_ROUNDS == 0:
            state = settled(state.groupBy("node").agg(F.min("s").alias("s")))
    state = state.groupBy("node").agg(F.min("s").alias("s"))
    return state.select(F.col("node").alias(node), F.col("s.label").alias(label), F.col("s.hops").alias("hops"), F.col("s.parent").alias("parent"))


def chains(parents: DataFrame, node: str = "node", parent: str = "parent", most: int | None = None) -> DataFrame:
    """node and chain (from the node by its parents to a root), at most `most` steps long."""
    up = settled(parents.select(F.col(node).alias("p_node"), F.col(parent).alias("p_parent")))
    live = up.select(F.col("p_node").alias("node"), F.col("p_parent").alias("next"), F.array("p_node").alias("chain"))
    done, rounds = live.where("next IS NULL"), 1
    live = settled(live.where("next IS NOT NULL"))
    while not live.isEmpty():
        if most is not None and rounds >= most:
            return done.unionByName(live).select(F.col("node").alias(node), "chain")
        moved = live.join(up, live["next"] == up["p_node"], "left")
        moved = moved.select("node", F.when(F.array_contains("chain", F.col("p_parent")), None).otherwise(F.col("p_parent")).alias("on"), F.concat("chain", F.array("next")).alias("chain"))
        moved = settled(moved.withColumnRenamed("on", "next"))
        done = done.unionByName(moved.where("next IS NULL"))
        live = moved.where("next IS NOT NULL")
        rounds += 1
    return done.select(F.col("node").alias(node), "chain")


def lattice_fixpoint(levels: DataFrame, edges: DataFrame, node: str = "node", level: str = "level", a: str = "a", b: str = "b", ceiling=None) -> DataFrame:
    """node and level, where a node's level is the greatest of its own and those that edges a -> b bring it, each at
    most ceiling."""
    live = _edges(edges, a, b)
    state = frontier = settled(levels.groupBy(F.col(node).alias("node")).agg(F.max(level).alias("level")))
    rounds = 0
    while not frontier.isEmpty():
        sent = F.col("level") if ceiling is None else F.least(F.col("level"), F.lit(ceiling))
        brought = frontier.join(live, frontier["node"] == live["e_from"]).groupBy(F.col("e_to").alias("node")).agg(F.max(sent).alias("brought"))
        known = state.join(brought.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.max("level").alias("level"))
        frontier = settled(brought.join(known.hint("merge"), "node").where("brought > level").select("node", F.col("brought").alias("level")))
        # Only what rises is written; the greatest of a node's levels is its own.
        state, rounds = state.unionByName(frontier), rounds + 1
        if rounds % COMPACT_ROUNDS == 0:
            state = settled(state.groupBy("node").agg(F.max("level").alias("level")))
    return state.groupBy("node").agg(F.max("level").alias("level")).toDF(node, level)


def reduce_graph(edges: DataFrame, kept: DataFrame, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """Edges between kept nodes, where a path through dropped nodes alone counts as an edge."""
    live = _edges(edges, a, b)
    keep = settled(kept.select(F.col(node).alias("k_node")).distinct())
    start = live.join(keep, live["e_from"] == keep["k_node"], "left_semi").select(F.col("e_from").alias("a"), F.col("e_to").alias("b"))

    def step(frontier):
        through = frontier.join(keep, frontier["b"] == keep["k_node"], "left_anti")
        return through.join(live, through["b"] == live["e_from"]).select("a", F.col("e_to").alias("b"))

    paths, _ = fixpoint(start, step, ["a", "b"])
    return paths.join(keep, paths["b"] == keep["k_node"], "left_semi").where("a <> b").toDF(a, b)


def strong_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its least node) of a directed graph's strongly connected components.

    Colouring: the greatest id that reaches a node is its colour; a colour's root and what reaches it inside the
    colour are one component. These leave, and the rest goes round again.
    """
    live = _edges(edges, a, b)
    nodes = settled(live.select(F.col("e_from").alias("node")).union(live.select("e_to")).distinct())
    done = None
    while not nodes.isEmpty():
        colour = lattice_fixpoint(nodes.select("node", F.col("node").alias("level")), live, a="e_from", b="e_to")
        colour = settled(colour.toDF("node", "colour"))
        left, right = colour.toDF("e_from", "c_from"), colour.toDF("e_to", "c_to")
        inside = live.join(left, "e_from").join(right, "e_to").where("c_from = c_to")
        back = inside.select(F.col("e_to").alias("x"), F.col("e_from").alias("y"))
        roots = colour.where("node = colour").select(F.col("colour").alias("source"), "node")
        members = settled(reach(roots, back, a="x", b="y"))
        least = members.groupBy("source").agg(F.min("node").alias("component"))
        found = members.join(least, "source").select("node", "component")
        done = found if done is None else done.unionByName(found)
        nodes = settled(nodes.join(members.select("node"), "node", "left_anti"))
        live = settled(live.join(nodes, live["e_from"] == nodes["node"], "left_semi").join(nodes.withColumnRenamed("node", "n2"), F.col("e_to") == F.col("n2"), "left_semi"))
    return done if done is not None else nodes.withColumn("component", F.col("node"))


def guarded_walk(roots: DataFrame, edges: DataFrame, guarded: DataFrame, uses: DataFrame) -> DataFrame:
    """Nodes reached from roots(node) over edges(a, b) and over guarded(a, b, key); a guarded edge opens once its key
    is used by any reached node, as uses(node, key) lists."""
    plain = _edges(edges, "a", "b")
    gates = settled(guarded.select(F.col("a").alias("e_from"), F.col("b").alias("e_to"), F.col("key").alias("g_key")).distinct())
    reached = settled(roots.select("node").distinct())
    open_keys = settled(reached.join(uses, "node").select("key").distinct())
    while True:
        live = plain.unionByName(gates.join(open_keys, gates["g_key"] == open_keys["key"], "left_semi").select("e_from", "e_to"))
        live = settled(live.distinct())

        def step(frontier, live=live):
            return frontier.join(live, frontier["node"] == live["e_from"]).select(F.col("e_to").alias("node"))

        reached, _ = fixpoint(reached, step, ["node"])
        fresh = settled(reached.join(uses, "node").select("key").distinct().join(open_keys, "key", "left_anti"))
        if fresh.isEmpty():
            return reached
        open_keys = settled(open_keys.unionByName(fresh))


def all_paths_owner(own: DataFrame, calls: DataFrame, node: str = "node", cls: str = "cls", caller: str = "a", callee: str = "b", order: tuple[str, ...] = ("algorithm", "package", "none"), inherits: str = "inherit") -> DataFrame:
    """node and owner: on whose behalf a node runs, universally over its callers. A node whose own class is `inherits`
    takes the last class in `order` that any of its callers has; others keep their own. Starts from the first class
    everywhere (the greatest fixpoint), so cycles alone add nothing; a node without callers takes the last class."""
    rank = F.create_map(*[x for k, c in enumerate(order) for x in (F.lit(c), F.lit(k))])
    live = _edges(calls, caller, callee)
    called = live.select(F.col("e_to").alias("node")).distinct().withColumn("called", F.lit(True))
    state = own.select(F.col(node).alias("node"), F.col(cls).alias("cls")).join(called, "node", "left")
    state = settled(state.select("node", (F.col("cls") == inherits).alias("open"), F.when(F.col("cls") != inherits, rank[F.col("cls")]).when(F.col("called"), 0).otherwise(len(order) - 1).alias("r")))
    while True:
        seen = state.select(F.col("node").alias("e_from"), F.col("r").alias("from_r"))
        brought = live.join(seen, "e_from").groupBy(F.col("e_to").alias("node")).agg(F.max("from_r").alias("brought"))
        new = settled(state.join(brought, "node", "left").select("node", "open", F.when(F.col("open"), F.greatest("r", F.coalesce("brought", "r"))).otherwise(F.col("r")).alias("r"), F.col("r").alias("was")))
        state = new.select("node", "open", "r")
        if new.where("r <> was").isEmpty():
            names = F.array(*[F.lit(c) for c in order])
            return state.select(F.col("node").alias(node), F.get(names, F.col("r").cast("int")).alias("owner"))


def reaching_definitions(flow: DataFrame, gen: DataFrame, kill: DataFrame) -> DataFrame:
    """(block, def) of definitions that reach a block's start: a forward may-analysis over flow(block, next),
    gen(block, def) and kill(block, def), where out = (in - kill) + gen.

    Definitions are numbered, and a row holds 64 of them as the bits of one word: dense sets reach nearly all of a
    graph's blocks over nearly all of its edges, so rows of single ones are many times more than what is found."""
    step_to = settled(flow.select(F.col("block").alias("f_block"), F.col("next").alias("f_next")).where("f_block IS NOT NULL").distinct())
    known = gen.where("def IS NOT NULL").groupBy("def").agg(F.min("block").alias("_b"))
    names = settled(numbered(known, ["_b", "def"], "_n").select("def", F.shiftright("_n", 6).alias("word"), F.expr("CAST(_n % 64 AS INT)").alias("bit")))
    bits = lambda rows: rows.join(names, "def").groupBy("block", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    killed = settled(bits(kill.where("block IS NOT NULL").select("block", "def")).toDF("k_block", "k_word", "mask"))

    def send(rows):
        return rows.join(step_to, rows["block"] == step_to["f_block"]).groupBy(F.col("f_next").alias("block"), "word").agg(F.bit_or("bits").alias("bits"))

    seen = frontier = settled(send(bits(gen.where("block IS NOT NULL").select("block", "def"))))
    rounds = 0
    while not frontier.isEmpty():
        passed = frontier.join(killed, (frontier["block"] == killed["k_block"]) & (frontier["word"] == killed["k_word"]), "left")
        sent = send(passed.select("block", "word", F.expr("bits & ~coalesce(mask, 0L)").alias("bits")).where("bits <> 0"))
        both = sent.select("block", "word", F.col("bits").alias("new"), F.lit(0).cast("long").alias("old")).unionByName(seen.select("block", "word", F.lit(0).cast("long").alias("new"), F.col("bits").alias("old")))
        fresh = both.groupBy("block", "word").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old")).select("block", "word", F.expr("new & ~old").alias("bits"))
        frontier = settled(fresh.where("bits <> 0"))
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % COMPACT_ROUNDS == 0:
            seen = settled(seen.groupBy("block", "word").agg(F.bit_or("bits").alias("bits")))
    words = names.groupBy("word").agg(F.collect_list(F.struct("bit", "def")).alias("defs"))
    told = seen.groupBy("block", "word").agg(F.bit_or("bits").alias("bits")).join(words.hint("merge"), "word")
    return told.select("block", F.explode(F.filter("defs", lambda x: F.call_function("getbit", F.col("bits"), x["bit"]) == 1)).alias("_d")).select("block", F.col("_d.def").alias("def"))


def bounded_walk(roots: DataFrame, edges: DataFrame, most: int, node: str = "node", a: str = "a", b: str = "b") -> tuple[DataFrame, bool]:
    """(nodes with the round they were reached in, whether the walk was cut): after a round that brings the nodes above
    `most`, the walk ends, and says so if anything was left to visit."""
    live = _edges(edges, a, b)
    seen = settled(roots.select(F.col(node).alias("node")).distinct().withColumn("round", F.lit(0)))
    frontier, rounds, total = seen, 0, seen.count()
    while not frontier.isEmpty():
        fresh = frontier.join(live, frontier["node"] == live["e_from"]).select(F.col("e_to").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        fresh = settled(fresh.withColumn("round", F.lit(rounds + 1)))
        if total > most:
            return seen, not fresh.isEmpty()
        seen, frontier, rounds = seen.unionByName(fresh), fresh, rounds + 1
        total += fresh.count()
    return seen, False


def roots_of(items: DataFrame, is_library: bool = False) -> DataFrame:
    """The items a walk starts from, with the least reason: the entry function, what reports its end, what the linker
    keeps, and for a library its public functions."""
    reasons = [("entry", F.col("is_main")), ("report", F.col("is_report")), ("linked", F.col("is_exported"))] + ([("public", F.col("is_public"))] if is_library else [])
    chain = None
    for name, holds in reasons:
        chain = F.when(holds, name) if chain is None else chain.when(holds, name)
    return items.withColumn("reason", chain).where("reason IS NOT NULL")


def uncalled(pending: DataFrame, edges: DataFrame, walked: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node: what only waiting edges lead to. From their ends the edges are followed, but never into walked nodes."""
    live = _edges(edges, a, b).join(walked.select(F.col("node").alias("e_to")), "e_to", "left_anti")
    start = pending.select("node").distinct().join(walked.select("node"), "node", "left_anti")
    return fixpoint(start, lambda f: f.join(live, f["node"] == live["e_from"]).select(F.col("e_to").alias("node")), ["node"])[0]


def shifted_attribution(calls: DataFrame, callers: DataFrame, plumbing: DataFrame) -> DataFrame:
    """call, callee and anchor: calls(callee, caller) that plumbing makes are attributed to the callers outside it that
    lead there, through plumbing only. callers(callee, caller) are the call edges, plumbing(node) the code in between."""
    through = settled(plumbing.select(F.col("node").alias("caller")).distinct())
    start = calls.join(through, "caller", "left_semi").select("callee", F.col("caller").alias("at")).distinct()
    up = settled(callers.select(F.col("callee").alias("at"), F.col("caller").alias("next")).distinct())
    inside = fixpoint(start, lambda f: f.join(up, "at").select("callee", F.col("next").alias("at")).join(through.select(F.col("caller").alias("at")), "at", "left_semi"), ["callee", "at"])[0]
    return inside.join(up, "at").select("callee", F.col("next").alias("anchor")).distinct().join(through.select(F.col("caller").alias("anchor")), "anchor", "left_anti")


def resolved_parameters(given: DataFrame, handed: DataFrame, bounds: DataFrame) -> DataFrame:
    """key, types and open of parameters. given(key, type) are the types calls give, handed(key, from_key) parameters
    that callers hand on, bounds(key, types, open) what a bound allows. A parameter is all its calls give and what those
    handed on are; one that anything open reaches is open; a cycle adds nothing. Parameters with no type at all and no
    bound are open."""
    types = settled(given.select("key", "type").union(bounds.select("key", F.explode("types").alias("type"))).distinct())
    handed = settled(handed.select("key", "from_key").distinct())
    back = handed.select(F.col("from_key").alias("a"), F.col("key").alias("b"))
    every = fixpoint(types, lambda f: f.join(back, f["key"] == back["a"]).select(F.col("b").alias("key"), "type"), ["key", "type"])[0]
    keys = types.select("key").union(handed.select("key")).union(handed.select("from_key")).distinct()
    rootless = keys.join(types.select("key").union(handed.select("key")).distinct(), "key", "left_anti")
    seeds = bounds.where("open").select("key").union(rootless).distinct()
    opened = fixpoint(seeds, lambda f: f.join(back, f["key"] == back["a"]).select(F.col("b").alias("key")), ["key"])[0]
    told = every.groupBy("key").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return keys.join(told, "key", "left").join(opened.withColumn("open", F.lit(True)), "key", "left").select("key", F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.coalesce("open", F.lit(False)).alias("open"))


def prefix_kills(kills: DataFrame, defs: DataFrame) -> DataFrame:
    """(killer, killed) of definitions: a strong one ends those of the same variable whose path its own begins. The
    paths' beginnings are exploded, so the join is by equality."""
    starts = F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    below = defs.select(F.col("def").alias("killed"), "var", F.explode(starts).alias("path"))
    return product(kills.where("strong").select(F.col("def").alias("killer"), "var", "path"), below, ["var", "path"]).where("killer <> killed").select("killer", "killed")
