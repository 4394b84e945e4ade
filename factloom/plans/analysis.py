"""From facts, a knowledge base and a package graph to assets: the whole analysis as one plan of DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.operators import graph, joins, knowledge, merges, trees
from factloom.session import cut
from factloom.sources import facts as model


def occurrences(facts: DataFrame, kb: dict[str, DataFrame]) -> DataFrame:
    """asset, file, line, offset, symbol, kind, tier, function: sites that the knowledge base's `fn`, `type` and `static`
    entries name, in that order of preference, without per-item sites that an instance repeats."""
    sites = model.sites(facts).withColumn("site", F.monotonically_increasing_id())
    artifacts = model.reached_functions(facts).groupBy("owner").agg(merges.sorted_set("artifact").alias("artifacts"))
    sites = sites.join(artifacts, "owner", "left").withColumn("tier", F.when(F.col("artifacts").isNotNull() | (F.col("tier") == "Reachable"), "Reachable").otherwise("Present"))
    place = ["file", "line", "offset", "path"]
    strong = sites.where("tier = 'Reachable'")
    sites = strong.unionByName(joins.superseded(sites.where("tier = 'Present'"), strong, place))
    sites = cut(sites)

    def entries(section: str, pattern: str) -> DataFrame:
        table = kb[section]
        columns = {c: F.col(c) if c in table.columns else F.lit(None).cast("string") for c in ("primitive", "functions", "material")}
        return table.select(F.col("crate").alias("kb_crate"), F.col(pattern).alias("pattern"), "asset", columns["primitive"].alias("primitive"), columns["functions"].alias("functions"), columns["material"].alias("material"), "ord")

    bare = sites.withColumn("bare", names.strip_generics("path"))
    calls = bare.where("kind = 'call'")
    by_fn = joins.first_match(calls, entries("fn", "path"), ["site"], [("crate", "kb_crate")], F.expr("path RLIKE pattern OR bare RLIKE pattern")).withColumn("how", F.lit("call"))
    by_static = joins.first_match(bare.where("kind IN ('static', 'const')"), entries("static", "path"), ["site"], [("crate", "kb_crate")], F.expr("path RLIKE pattern")).withColumn("how", F.lit("static"))
    rest = calls.join(by_fn.select("site"), "site", "left_anti")
    types = rest.select("site", F.explode(F.array_compact(F.concat(F.array("self_ty"), F.coalesce("type_args", F.array().cast("array<string>"))))).alias("type")).withColumn("root_id", F.monotonically_increasing_id())
    types = cut(types)
    flat = cut(trees.flatten_types(types.select("root_id", "type")))
    typed = kb["type"].select("crate", "name", "asset", *[F.col(c) if c in kb["type"].columns else F.lit(None).cast("string").alias(c) for c in ("primitive", "functions", "material")], "ord")
    matched = trees.match_types(flat, typed).join(types.select("root_id", "site"), "root_id").join(joins.small(typed.drop("crate", "name")), "ord")
    by_type = rest.join(matched.select("site", "asset", "primitive", "functions", "material", "ord", F.when(F.col("outer").isNull(), "instantiation").otherwise("component").alias("how")), "site")
    cols = ["asset", "primitive", "material", "file", "line", "offset", F.col("path").alias("symbol"), "how", "tier", "functions", "artifacts", F.col("owner_path").alias("item")]
    out = by_fn.select(*cols).unionByName(by_static.select(*cols)).unionByName(by_type.select(*cols))
    return out.withColumn("function", F.coalesce(F.from_json("functions", "array<string>"), F.array().cast("array<string>"))).drop("functions")


def unknown_calls(facts: DataFrame, kb: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """asset (`unknown` and the operation's primitive), file, line, offset, symbol and reason of the calls that an
    `operation` entry names and nothing else does: the operation is seen, but not its algorithm."""
    sites = model.sites(facts).where("kind = 'call'").withColumn("bare", names.strip_generics("path"))
    place = ["file", "line", "offset"]
    calls = sites.select(*place, F.col("path").alias("symbol"), "crate", "bare").distinct()
    table = kb["operation"]
    listed = F.from_json("crates", "array<string>") if "crates" in table.columns else F.array("crate")
    entries = table.select(listed.alias("crates"), F.col("path").alias("pattern"), F.col("primitive") if "primitive" in table.columns else F.lit(None).cast("string").alias("primitive"), "ord")
    known = knowledge.in_listed_crates(calls, entries, [*place, "symbol"], "crate", "bare")
    left = joins.anti_with_reason(known, found.select(*place), place, [("pointer", F.col("symbol").contains("dyn "))], otherwise="no algorithm named")
    return left.select(F.concat_ws(" ", F.lit("unknown"), "primitive").alias("asset"), *place, "symbol", "reason")


def assets(found: DataFrame) -> DataFrame:
    """Occurrences merged by place, then grouped into assets: tier is the stronger, uses are those of reachable rows if
    there are any."""
    strength = F.when(F.col("tier") == "Reachable", 1).otherwise(0)
    key = names.asset_key(F.col("asset"), F.coalesce("primitive", F.lit("")), F.col("material"))
    rows = found.withColumn("asset_key", key).withColumn("strength", strength)
    one = rows.groupBy("asset_key", "asset", "file", "line", "offset", "symbol").agg(F.max("strength").alias("strength"), F.min("how").alias("how"), F.array_distinct(F.flatten(F.collect_list("function"))).alias("function"))
    return one.groupBy("asset_key", "asset").agg(
        F.when(F.max("strength") == 1, "reachable").otherwise("present").alias("usage"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "file", "line", "offset"))), " ").alias("places"),
        F.array_join(F.when(F.max("strength") == 1, F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("strength") == 1, F.col("function"))))))).otherwise(F.array_sort(F.array_distinct(F.flatten(F.collect_list("function"))))), ",").alias("uses"),
    )


def coverage(edges: DataFrame, found: DataFrame, reasons: list | None = None) -> DataFrame:
    """Every boundary call with its verdict: cited by an occurrence at its place, excused by the first reason that
    holds, or uncovered."""
    reasons = reasons if reasons is not None else [("on behalf of another", F.col("on_behalf").isNotNull()), ("awaited", F.col("coroutine")), ("entered from the standard library", F.col("std_entry").isNotNull())]
    place = ["file", "line", "offset"]
    cited = edges.join(found.select(*place).distinct(), place, "left_semi").withColumn("verdict", F.lit("cited"))
    return cited.unionByName(joins.anti_with_reason(edges, found, place, reasons, out="verdict"))


def package_usage(usage: DataFrame, deps: DataFrame) -> DataFrame:
    """id and level (0 declared, 1 present, 2 reachable), pushed down dependency edges; what is pushed is present at
    most."""
    return graph.lattice_fixpoint(usage, deps, node="id", level="level", ceiling=1)


def boundary_lines(covered: DataFrame) -> DataFrame:
    """One tab-separated line a checked call, in the order of places."""
    text = F.concat_ws("\t", F.concat_ws(":", "file", "line", "offset"), "verdict", "path", F.coalesce("trait_path", F.lit("-")), "owner", F.coalesce("on_behalf", F.lit("-")))
    return covered.orderBy("file", "line", "offset", "path").select(text.alias("line"))


def summary_lines(grouped: DataFrame) -> DataFrame:
    """The sorted golden summary: a line an asset and one a place."""
    head = grouped.select(F.concat_ws(" ", F.lit("asset"), "asset_key", "usage", "uses").alias("line"))
    places = grouped.select("asset_key", F.explode(F.split("places", " ")).alias("place")).select(F.concat_ws(" ", F.lit("occ"), "asset_key", "place").alias("line"))
    return head.unionByName(places).orderBy("line")


def document(grouped: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """One row with the nested document as JSON: components with their evidence, and dependencies, in fixed order; the
    serial number is a hash of the content. The document is one value, and so is gathered into one row."""
    evidence = F.transform(F.split("places", " "), lambda p: F.struct(F.element_at(F.split(p, ":"), 1).alias("location"), F.element_at(F.split(p, ":"), 2).cast("long").alias("line"), F.element_at(F.split(p, ":"), 3).cast("long").alias("offset")))
    parts = grouped.select(F.struct(F.col("asset_key").alias("bom-ref"), F.col("asset").alias("name"), "usage", "uses", evidence.alias("occurrences")).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("components"))
    edges = F.array().cast("array<struct<ref:string,dependsOn:array<string>>>")
    if deps is not None:
        parts = parts.crossJoin(deps.groupBy(F.col("a").alias("ref")).agg(F.array_sort(F.collect_set("b")).alias("dependsOn")).agg(F.array_sort(F.collect_list(F.struct("ref", "dependsOn"))).alias("dependencies")))
        edges = F.col("dependencies")
    body = F.to_json(F.struct(F.col("components"), edges.alias("dependencies")))
    return parts.select(F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.7","version":1,"serialNumber":"urn:sha256:'), F.sha2(body, 256), F.lit('",'), F.substring(body, 2, 1 << 30)).alias("document"))


def document_errors(docs: DataFrame) -> DataFrame:
    """path and message of every part of a document that is not as it must be; empty if it is sound."""
    schema = "bomFormat STRING, specVersion STRING, serialNumber STRING, components ARRAY<STRUCT<`bom-ref`:STRING,name:STRING,occurrences:ARRAY<STRUCT<location:STRING,line:BIGINT,offset:BIGINT>>>>"
    d = docs.select(F.from_json("document", schema).alias("d")).select("d.*")
    top = d.select(F.explode(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(m).alias("message"))) for p, m, ok in (("bomFormat", "is not CycloneDX", F.col("bomFormat") == "CycloneDX"), ("specVersion", "is not 1.7", F.col("specVersion") == "1.7"), ("serialNumber", "is missing", F.col("serialNumber") != ""), ("components", "is missing", F.col("components").isNotNull()))])).alias("e")).where("e IS NOT NULL").select("e.*")
    comps = d.select(F.posexplode("components").alias("n", "c"))
    path = F.concat(F.lit("components/"), F.col("n").cast("string"))
    unnamed = comps.where("c.name IS NULL OR c.name = ''").select(F.concat(path, F.lit("/name")).alias("path"), F.lit("is missing").alias("message"))
    repeated = comps.groupBy(F.col("c.`bom-ref`").alias("ref")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.concat(F.lit("components/"), "ref").alias("path"), F.lit("is not unique").alias("message"))
    return top.unionByName(unnamed).unionByName(repeated)


def from_document(docs: DataFrame) -> DataFrame:
    """asset, file, line and offset of a document's occurrences."""
    schema = "components ARRAY<STRUCT<name:STRING,occurrences:ARRAY<STRUCT<location:STRING,line:BIGINT,offset:BIGINT>>>>"
    c = docs.select(F.explode(F.from_json("document", schema)["components"]).alias("c"))
    return c.select("c.name", F.explode("c.occurrences").alias("o")).select(F.col("name").alias("asset"), F.col("o.location").alias("file"), "o.line", "o.offset")


def score_sites(labels: DataFrame, reported: DataFrame) -> DataFrame:
    """labels with the sorted set reported at their (file, line) and the verdict on it."""
    sets = reported.groupBy("file", "line").agg(F.array_sort(F.collect_set("asset")).alias("reported"))
    rows = labels.join(sets, ["file", "line"], "left").withColumn("reported", F.coalesce("reported", F.array().cast("array<string>")))
    return rows.withColumn("verdict", merges.set_verdict(F.col("must"), F.col("may"), F.col("reported")))


def exact_among_several(found: DataFrame) -> DataFrame:
    """file, line, offset, via and the assets that are labelled as the only one where several may be meant."""
    grouped = found.groupBy("file", "line", "offset", "via").agg(F.array_sort(F.collect_set("asset")).alias("assets"), F.array_sort(F.collect_set(F.when(~F.col("sentence").rlike("one of|possibl|selector"), F.col("asset")))).alias("exact"))
    return grouped.where((F.size(F.array_remove("assets", "unknown")) > 1) | (F.array_contains("assets", "unknown") & (F.size("assets") > 1))).withColumn("exact", F.array_remove("exact", "unknown")).where(F.size("exact") > 0).drop("assets")
