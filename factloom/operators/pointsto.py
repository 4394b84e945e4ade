"""Points-to analysis as semi-naive loops over constraint tables (integers or texts as keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.operators.graph import connected_components
from factloom.session import cut

UNKNOWN = "<unknown>"  # fixed value: the object that stands for what was not translated


def inclusion(addr: DataFrame, copy: DataFrame, load: DataFrame, store: DataFrame, icall: DataFrame | None = None, fn_param: DataFrame | None = None, fn_ret: DataFrame | None = None, havoc: DataFrame | None = None) -> DataFrame:
    """(v, o): the objects each variable may point to, by inclusion.

    addr(v, o): v = &o. copy(dst, src): dst = src. load(dst, ptr): dst = *ptr. store(ptr, src): *ptr = src. An object is
    a variable too. icall(site, ptr, arg, actual, result) with fn_param(o, arg, formal) and fn_ret(o, value) binds calls
    through pointers as their targets are found. havoc(v) may be anything. Rounds join only what is new (difference
    propagation) with the constraints, and new edges with all that is known.
    """
    kind = dict(addr.dtypes)["v"]
    pts = addr.select("v", "o").distinct()
    if havoc is not None:
        pts = pts.unionByName(havoc.select("v", F.lit(UNKNOWN).cast(dict(addr.dtypes)["o"]).alias("o")))
    pts = cut(pts.distinct())
    edges = cut(copy.select("dst", "src").distinct())
    delta, fresh_edges = pts, edges
    while True:
        moved = [delta.join(edges, delta["v"] == edges["src"]).select(F.col("dst").alias("v"), "o"), pts.join(fresh_edges, pts["v"] == fresh_edges["src"]).select(F.col("dst").alias("v"), "o")]
        grown = moved[0].unionByName(moved[1]).distinct().join(pts, ["v", "o"], "left_anti")
        grown = cut(grown)
        through = delta.where(F.col("o") != F.lit(UNKNOWN)) if kind == "string" else delta
        made = [through.join(load, through["v"] == load["ptr"]).select("dst", F.col("o").alias("src")), through.join(store, through["v"] == store["ptr"]).select(F.col("o").alias("dst"), "src")]
        if icall is not None:
            target = through.join(icall, through["v"] == icall["ptr"])
            made.append(target.join(fn_param, ["o", "arg"]).select(F.col("formal").alias("dst"), F.col("actual").alias("src")))
            made.append(target.join(fn_ret, "o").select(F.col("result").alias("dst"), F.col("value").alias("src")).where("dst IS NOT NULL"))
        new_edges = made[0]
        for m in made[1:]:
            new_edges = new_edges.unionByName(m)
        fresh_edges = cut(new_edges.distinct().join(edges, ["dst", "src"], "left_anti"))
        if grown.isEmpty() and fresh_edges.isEmpty():
            return pts
        pts, edges, delta = cut(pts.unionByName(grown)), cut(edges.unionByName(fresh_edges)), grown


def unification(addr: DataFrame, copy: DataFrame, load: DataFrame, store: DataFrame) -> DataFrame:
    """(v, o): a coarser answer by merging: variables that are copied share a class, and what the members of a class
    point to shares one. Components are merged until no class points to two."""
    same = cut(copy.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    points = cut(addr.select("v", "o").distinct())
    while True:
        nodes = points.select(F.col("v").alias("a"), F.col("v").alias("b")).union(points.select("o", "o")).union(load.select("dst", "dst")).union(load.select("ptr", "ptr")).union(store.select("ptr", "ptr")).union(store.select("src", "src"))
        cls = cut(connected_components(same.unionByName(nodes)))
        of = lambda c: cls.toDF(c, f"{c}_c")
        targets = points.join(of("v"), "v").select("v_c", "o")
        first = cut(targets.groupBy("v_c").agg(F.min("o").alias("to")))
        merged = targets.join(first, "v_c").where("o <> to").select(F.col("o").alias("a"), F.col("to").alias("b"))
        read = load.join(of("ptr"), "ptr").join(first, F.col("ptr_c") == F.col("v_c")).select(F.col("dst").alias("a"), F.col("to").alias("b"))
        written = store.join(of("ptr"), "ptr").join(first, F.col("ptr_c") == F.col("v_c")).select(F.col("src").alias("a"), F.col("to").alias("b"))
        more = merged.unionByName(read).unionByName(written).join(of("a"), "a").join(of("b"), "b").where("a_c <> b_c").select("a", "b")
        more = cut(more.distinct())
        if more.isEmpty():
            pointing = targets.select("v_c", "o").distinct()
            return cls.withColumnRenamed("component", "v_c").join(pointing, "v_c").select(F.col("node").alias("v"), "o").distinct()
        same = cut(same.unionByName(more))


def merge_large_sets(pts: DataFrame, limit: int) -> DataFrame:
    """pts with the objects of sets beyond the limit replaced by the least of them (widening)."""
    wide = pts.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("head")).where(F.col("n") > limit)
    links = pts.join(wide, "v").select(F.col("o").alias("a"), F.col("head").alias("b"))
    merged = connected_components(links).toDF("o", "as")
    return pts.join(merged, "o", "left").select("v", F.coalesce("as", "o").alias("o")).distinct()


def verdicts(answers: DataFrame, live: str = "live") -> DataFrame:
    """call key columns with found (sorted) and complete: no unknown, no other object, every argument answered. Rows of
    calls that are not live count as nothing."""
    rows = answers.where(live)
    return rows.groupBy("file", "line", "col", "callee").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("statics")))).alias("found"), F.bool_and(F.col("answered") & ~F.coalesce("unknown", F.lit(True)) & (F.coalesce("others", F.lit(1)) == 0)).alias("complete"))


def settle(members: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """members(key, found) narrowed to complete answers; an incomplete answer changes nothing, and nothing is added."""
    told = answers.select(*key, F.col("found").alias("_told"), "complete")
    return members.join(told, key, "left").withColumn("found", F.when(F.col("complete"), F.array_intersect("found", "_told")).otherwise(F.col("found"))).drop("_told", "complete")


def collapsed(addr: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(addr, copies, representatives: v and rep) with the variables of each cycle of copies as one: they hold the same
    objects, so a cycle is solved once."""
    reps = graph.strong_components(copies.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("node").alias("v"), F.col("component").alias("rep"))
    named = lambda df, c: df.join(reps.select(F.col("v").alias(c), F.col("rep").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    fewer = named(named(copies.select("dst", "src"), "dst"), "src").where("dst <> src").distinct()
    return named(addr.select("v", "o"), "v").distinct(), fewer, reps


def cloned(copies: DataFrame, calls: DataFrame, library: DataFrame) -> DataFrame:
    """copies(body, dst, src) of library bodies once for each calling context, calls(context, body), as variables
    `context/variable`; other bodies keep theirs. A library body that nothing calls has no copy."""
    shared = copies.join(library.select("body").distinct(), "body", "left_semi").join(calls.select("context", "body").distinct(), "body")
    name = lambda c: F.concat_ws("/", F.col("context").cast("string"), F.col(c)).alias(c)
    own = copies.join(library.select("body").distinct(), "body", "left_anti").select("dst", "src")
    return own.unionByName(shared.select(name("dst"), name("src")))


def havocked(locations: DataFrame, havoc: DataFrame, smashed: DataFrame) -> DataFrame:
    """locations(object, offset) that havoc(object, lo, size) reaches; all of an object whose parts are one (smashed)."""
    ranges = havoc.where("size > 0").join(smashed.select("object").distinct().withColumn("_all", F.lit(True)), "object", "left")
    inside = F.coalesce(F.col("_all"), F.lit(False)) | ((F.col("offset") >= F.col("lo")) & (F.col("offset") < F.col("lo") + F.col("size")))
    return locations.join(ranges, "object").where(inside).select("object", "offset").distinct()
