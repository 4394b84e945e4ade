"""Recursive values as node tables, and the searches over them. A result is two tables: what was found, and the gaps,
the places where the search could not go on. No case disappears."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.joins import small
from factloom.session import cut, settled

NODE = "root_id long, node_id long, parent_id long, slot string, ord long, depth long, kind string, name string, krate string, field long, owner string, value string, zero boolean"
ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
# The fields of a value that hold values.
CHILDREN = ("base", "value", "pointer", "fed")
TYPE_NODE = "root_id long, node_id long, parent_id long, ord long, depth long, kind string, name string, krate string, number string"


def _origin_rows(root_id: int, tree) -> Iterator[tuple]:
    stack, count = [(tree, None, None, 0, 0)], 0
    while stack:
        value, parent, slot, ord_, depth = stack.pop()
        me, count = count, count + 1
        kind, body = (value, {}) if isinstance(value, str) else next(iter(value.items()))
        items = body if isinstance(body, list) else []
        body = body if isinstance(body, dict) else {}
        name = body.get("callee") or body.get("adt") or body.get("path") or (body.get("def") or {}).get("path")
        krate = body.get("krate") or ((body.get("def") or {}).get("krate") or {}).get("name")
        scalar = body.get("value")
        place = body.get("field", body.get("index"))
        yield root_id, me, parent, slot, ord_, depth, kind, name if isinstance(name, str) else json.dumps(name), krate, place, body.get("owner"), None if scalar is None or isinstance(scalar, (dict, list)) else str(scalar), bool(body.get("zero"))
        inner = [(v, me, "item", n, depth + 1) for n, v in enumerate(items)]
        inner += [(v, me, "arg", n, depth + 1) for n, v in enumerate(body.get("args") or []) if isinstance(body.get("args"), list)]
        inner += [(body[c], me, c, 0, depth + 1) for c in CHILDREN if body.get(c) is not None and (c != "value" or isinstance(body[c], dict) or kind == "Set")]
        stack.extend(reversed(inner))


def flatten_origins(values: DataFrame) -> DataFrame:
    """A row of NODE for each node of values(root_id, origin as JSON), map-side and without recursion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c.split() for c in NODE.split(", ")]
        for batch in batches:
            rows = [r for i, o in zip(*(c.to_pylist() for c in batch.columns), strict=True) if o is not None for r in _origin_rows(i, json.loads(o) if o[:1] in '{["' else o)]
            arrays = zip(*rows) if rows else [()] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(a, ARROW[t]) for a, (_, t) in zip(arrays, columns, strict=True)], [c for c, _ in columns])

    return values.select("root_id", "origin").mapInArrow(run, NODE)


def _type_rows(root_id: int, tree) -> Iterator[tuple]:
    stack, count = [(tree, None, 0, 0)], 0
    while stack:
        value, parent, ord_, depth = stack.pop()
        me, count = count, count + 1
        kind, body = (value, None) if isinstance(value, str) else next(iter(value.items()))
        name = krate = number = None
        inner: list = []
        if kind == "Adt":
            name, krate, inner = body["path"], body["krate"]["name"], body["args"]
        elif kind in ("Ref", "Slice"):
            inner = [body]
        elif kind == "Array":
            inner, number = [body[0]], body[1]
        elif kind == "Tuple":
            inner = body
        elif kind == "Const":
            number = body
        else:
            name = ", ".join(body) if isinstance(body, list) else body
        yield root_id, me, parent, ord_, depth, kind, name, krate, None if number is None else str(number)
        stack.extend(reversed([(v, me, n, depth + 1) for n, v in enumerate(inner)]))


def flatten_types(types: DataFrame) -> DataFrame:
    """A row of TYPE_NODE for each node of types(root_id, type as JSON)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in TYPE_NODE.split(", ")]
        for batch in batches:
            rows = [r for i, t in zip(batch["root_id"], batch["type"], strict=True) if t is not None for r in _type_rows(i, json.loads(t))]
            yield pd.DataFrame(rows, columns=columns).astype({"parent_id": "Int64"})

    return types.select("root_id", "type").mapInPandas(run, TYPE_NODE)


def match_types(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """root_id, node_id, ord (of the first entry) and outer (the entry of the closest enclosing match, null outside
    any) of type nodes that entries(crate, name, ord) describe by crate and last path part."""
    last = F.element_at(F.split("name", "::"), -1)
    typed = nodes.where("kind = 'Adt'").select("root_id", "node_id", F.col("krate").alias("crate"), last.alias("name"))
    hit = cut(typed.join(small(entries.select("crate", "name", "ord")), ["crate", "name"]).groupBy("root_id", "node_id").agg(F.min("ord").alias("ord")))
    up = nodes.select("root_id", F.col("node_id").alias("at"), F.col("parent_id").alias("next"))
    live = hit.select("root_id", "node_id", "ord").join(nodes.select("root_id", "node_id", F.col("parent_id").alias("at")), ["root_id", "node_id"])
    done = live.where("at IS NULL").select("root_id", "node_id", "ord", F.lit(None).cast("long").alias("outer"))
    live = cut(live.where("at IS NOT NULL"))
    found = hit.select("root_id", F.col("node_id").alias("at"), F.col("ord").alias("outer"))
    while not live.isEmpty():
        step = cut(live.join(found, ["root_id", "at"], "left").join(up, ["root_id", "at"], "left"))
        done = done.unionByName(step.where("outer IS NOT NULL OR next IS NULL").select("root_id", "node_id", "ord", "outer"))
        live = step.where("outer IS NULL AND next IS NOT NULL").select("root_id", "node_id", "ord", F.col("next").alias("at"))
    return done


def type_argument(nodes: DataFrame, path: list[int]) -> DataFrame:
    """root_id, node_id (where the path starts) and the kind, name and number at an indexed path below each node."""
    at = nodes.select("root_id", "node_id", F.col("node_id").alias("at"))
    for n in path:
        child = nodes.where(F.col("ord") == n).select("root_id", F.col("parent_id").alias("at"), F.col("node_id").alias("child"))
        at = at.join(child, ["root_id", "at"]).select("root_id", "node_id", F.col("child").alias("at"))
    target = nodes.select("root_id", F.col("node_id").alias("at"), "kind", "name", "number")
    return at.join(target, ["root_id", "at"]).drop("at")


def tree_size(nodes: DataFrame, limit: int) -> DataFrame:
    """root_id and its number of nodes, limit + 1 at most."""
    return nodes.groupBy("root_id").agg(F.least(F.count(F.lit(1)), F.lit(limit + 1)).alias("size"))


def cap_depth(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes no deeper than depth; those at depth that had children become `Truncated`."""
    at = F.when(F.col("depth") > depth, F.col("parent_id")).otherwise(F.col("node_id"))
    has_kids = F.max(F.col("depth") > depth).over(Window.partitionBy("root_id", "_at"))
    kept = nodes.where(F.col("depth") <= depth + 1).withColumn("_at", at).withColumn("_cut", has_kids).where(F.col("depth") <= depth)
    return kept.withColumn("kind", F.when(F.col("_cut"), "Truncated").otherwise(F.col("kind"))).select(*nodes.columns)


def own_params(nodes: DataFrame, owner: str) -> DataFrame:
    """nodes with an owner for the parameters that have none."""
    return nodes.withColumn("owner", F.when(F.col("kind") == "Param", F.coalesce("owner", F.lit(owner))).otherwise(F.col("owner")))


def descriptors(nodes: DataFrame) -> DataFrame:
    """The descriptors that a value's tree names."""
    return nodes.where("kind = 'Data'").select("root_id", F.col("name").alias("found")).distinct()


def substitute(nodes: DataFrame, arguments: DataFrame, graft: DataFrame) -> DataFrame:
    """nodes with each `Param` n of arguments(root_id, ord, arg_root) replaced by the tree of that root in graft.
    Grafted nodes get ids from their parameter's id and their own, so they stay unique in their tree."""
    width = F.lit(1 << 20)
    given = arguments.select(F.col("root_id").alias("a_root"), F.col("ord").alias("a_ord"), "arg_root", F.lit(True).alias("_hole"))
    g = small(graft.select(*[F.col(c).alias(f"g_{c}") for c in graft.columns]))
    # One pass of the nodes; arguments, which can be as many, are exchanged and never broadcast by an estimate.
    holes = nodes.join(given.hint("merge"), (F.col("kind") == "Param") & (F.col("root_id") == F.col("a_root")) & (F.col("field") == F.col("a_ord")), "left")
    joined = holes.join(g, F.col("arg_root") == F.col("g_root_id"), "left").where("_hole IS NULL OR g_root_id IS NOT NULL")
    new_id = lambda c: (F.col("node_id") + 1) * width + F.col(c)
    root = F.col("g_parent_id").isNull()
    own = {"root_id": F.col("root_id"), "node_id": F.when(root, F.col("node_id")).otherwise(new_id("g_node_id")), "parent_id": F.when(root, F.col("parent_id")).when(F.col("g_parent_id") == 0, F.col("node_id")).otherwise(new_id("g_parent_id")), "slot": F.when(root, F.col("slot")).otherwise(F.col("g_slot")), "ord": F.when(root, F.col("ord")).otherwise(F.col("g_ord")), "depth": F.col("depth") + F.col("g_depth")}
    return joined.select(*[F.when(F.col("_hole").isNull(), F.col(c)).otherwise(own.get(c, F.col(f"g_{c}"))).alias(c) for c in nodes.columns])


def search_values(roots: DataFrame, nodes: DataFrame, semantics: DataFrame, params: DataFrame, fields: DataFrame, returns: DataFrame, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """(found: start, found and via; gaps: start and reason) of values from roots(start, root_id).

    Each round moves a frontier of tree nodes by one joined rule a kind: descriptors are found; constants and units
    end; containers go on to their items; calls by semantics(callee, slots) to those arguments; parameters to what
    params(owner, ord, root_id) pass; fields to what fields(name, field, root_id) store; calls to own functions to what
    returns(callee, root_id) give. What no rule covers, and what lies beyond `most` rounds, is a gap with its reason.
    Nodes seen before end without a gap: cycles add nothing and cut nothing.
    """
    nodes, semantics = settled(nodes), small(semantics)
    kids = nodes.select("root_id", F.col("parent_id").alias("p_id"), F.col("node_id").alias("k_id"), "slot", "ord")
    about = nodes.select("root_id", "node_id", "kind", "name", "field", "owner")
    frontier = roots.select("start", "root_id", F.lit(0).cast("long").alias("node_id"), F.lit("here").alias("via"))
    seen = settled(frontier.dropDuplicates(["start", "root_id", "node_id"]))
    frontier, found, gaps = seen, [], []
    for _ in range(most):
        if frontier.isEmpty():
            break
        here = settled(frontier.join(about, ["root_id", "node_id"]))
        found.append(here.where("kind = 'Data'").select("start", F.col("name").alias("found"), "via"))
        gaps.append(here.where("kind IN ('Truncated', 'Unknown')").select("start", F.concat(F.lower("kind"), F.lit(" value")).alias("reason")))
        within = here.where("kind IN ('Any', 'All', 'Set')").join(kids, (here["root_id"] == kids["root_id"]) & (here["node_id"] == kids["p_id"])).select("start", here["root_id"], F.col("k_id").alias("node_id"), "via")
        calls = here.where("kind IN ('Call', 'Through', 'Written')").join(semantics, here["name"] == semantics["callee"], "left")
        followed = calls.where("slots IS NOT NULL").select("start", calls["root_id"], "node_id", "via", F.explode("slots").alias("want"))
        args = followed.join(kids, (followed["root_id"] == kids["root_id"]) & (followed["node_id"] == kids["p_id"]) & (kids["ord"] == followed["want"]) & (kids["slot"] == "arg")).select("start", followed["root_id"], F.col("k_id").alias("node_id"), "via")
        own = calls.where("slots IS NULL").select("start", "via", F.col("name").alias("callee")).join(returns.select("callee", F.col("root_id").alias("to")).hint("merge"), "callee", "left")
        gaps.append(own.where("to IS NULL").select("start", F.concat(F.lit("call not modelled: "), F.coalesce("callee", F.lit("?"))).alias("reason")))
        given = here.where("kind = 'Param'").join(params.select(F.col("owner").alias("p_owner"), F.col("ord").alias("p_ord"), F.col("root_id").alias("to")).hint("merge"), (F.col("owner") == F.col("p_owner")) & (F.col("field") == F.col("p_ord")), "left")
        gaps.append(given.where("to IS NULL").select("start", F.concat(F.lit("parameter of "), F.coalesce("owner", F.lit("?")), F.lit(" without callers")).alias("reason")))
        stored = here.where("kind = 'Field'").join(fields.select(F.col("name").alias("f_name"), F.col("field").alias("f_field"), F.col("root_id").alias("to")).hint("merge"), (F.col("name") == F.col("f_name")) & (F.col("field") == F.col("f_field")), "left")
        gaps.append(stored.where("to IS NULL").select("start", F.concat(F.lit("field of "), F.coalesce("name", F.lit("?")), F.lit(" without stores")).alias("reason")))
        over = lambda df, route: df.where("to IS NOT NULL").select("start", F.col("to").alias("root_id"), F.lit(0).cast("long").alias("node_id"), F.lit(route).alias("via"))
        nxt = within.unionByName(args).unionByName(over(own, "returned")).unionByName(over(given, "argument")).unionByName(over(stored, "stored"))
        nxt = nxt.dropDuplicates(["start", "root_id", "node_id"]).join(seen.select("start", "root_id", "node_id"), ["start", "root_id", "node_id"], "left_anti")
        frontier = settled(nxt.select("start", "root_id", "node_id", "via"))
        seen = settled(seen.unionByName(frontier))
    gaps.append(frontier.select("start", F.lit("cut").alias("reason")))
    rank = F.create_map(*[x for k, v in enumerate(("here", "argument", "returned", "stored")) for x in (F.lit(v), F.lit(k))])
    every = found[0] if found else frontier.select("start", F.lit(None).cast("string").alias("found"), "via").limit(0)
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy("start", "found").agg(F.min_by("via", rank[F.col("via")]).alias("via"))
    lost = gaps[0]
    for g in gaps[1:]:
        lost = lost.unionByName(g)
    return cut(best), cut(lost.distinct())


def gap_reason(gaps: DataFrame) -> DataFrame:
    """start and its reason: a cut outranks the others, which go by their text."""
    return gaps.groupBy("start").agg(F.min_by("reason", F.struct(F.col("reason") != "cut", "reason")).alias("reason"))


def classify_provenance(roots: DataFrame, nodes: DataFrame, sources: DataFrame, passes: DataFrame, params: DataFrame, most: int = 12) -> DataFrame:
    """start, and the sorted classes of where its value comes from. The first rule that fits a node holds: literals
    and statics are hard-coded (an empty one is absent); calls of sources(callee, class) have that class; calls of
    passes(callee, slots) are as those arguments; other calls are computed; parameters are as callers' arguments, and
    `parameter` without any; deeper than `most` is unknown."""
    nodes = settled(nodes)
    sources = small(sources.select(F.col("callee").alias("name"), F.col("class").alias("source")))
    passes = small(passes.select(F.col("callee").alias("name"), "slots"))
    kids = nodes.select("root_id", F.col("parent_id").alias("p_id"), F.col("node_id").alias("k_id"), "slot", "ord")
    about = nodes.select("root_id", "node_id", "kind", "name", "field", "owner", "value")
    seen = settled(roots.select("start", "root_id", F.lit(0).cast("long").alias("node_id")))
    frontier, out = seen, None
    for _ in range(most):
        if frontier.isEmpty():
            break
        here = frontier.join(about, ["root_id", "node_id"]).join(sources, "name", "left").join(passes, "name", "left")
        here = settled(here)
        call = F.col("kind").isin("Call", "Through", "Written")
        label = F.when((F.col("kind") == "Const") & (F.col("value") == ""), "absent").when(F.col("kind").isin("Const", "Data"), "hard-coded").when(call & F.col("source").isNotNull(), F.col("source")).when(call & F.col("slots").isNull(), "computed").when(F.col("kind").isin("Unknown", "Truncated"), "unknown")
        given = here.where("kind = 'Param'").join(params.select(F.col("owner").alias("p_owner"), F.col("ord").alias("p_ord"), F.col("root_id").alias("to")).hint("merge"), (F.col("owner") == F.col("p_owner")) & (F.col("field") == F.col("p_ord")), "left")
        done = here.select("start", label.alias("class")).where("class IS NOT NULL").unionByName(given.where("to IS NULL").select("start", F.lit("parameter").alias("class")))
        out = done if out is None else out.unionByName(done)
        down = here.where(F.col("kind").isin("Any", "All", "Set", "Field") | (call & F.col("source").isNull() & F.col("slots").isNotNull()))
        inner = down.join(kids, (down["root_id"] == kids["root_id"]) & (down["node_id"] == kids["p_id"]) & (F.col("slots").isNull() | F.array_contains("slots", kids["ord"]))).select("start", down["root_id"], F.col("k_id").alias("node_id"))
        nxt = inner.unionByName(given.where("to IS NOT NULL").select("start", F.col("to").alias("root_id"), F.lit(0).cast("long").alias("node_id")))
        frontier = settled(nxt.distinct().join(seen, ["start", "root_id", "node_id"], "left_anti"))
        seen = settled(seen.unionByName(frontier))
    left = frontier.select("start", F.lit("unknown").alias("class"))
    out = left if out is None else out.unionByName(left)
    return out.groupBy("start").agg(F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"))


def object_leaves(rows: DataFrame, keep: list[str], column: str) -> DataFrame:
    """keep, key and value: a row for each field of a JSON object; none for what is no object."""
    return rows.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
