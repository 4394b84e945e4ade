"""Package graphs, manifests, lockfiles, knowledge bases, labels and logs."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.templates import semver_covers
from factloom.operators import graph
from factloom.operators.joins import small
from factloom.operators.verify import source_lines

METADATA = "packages ARRAY<STRUCT<id:STRING,name:STRING,version:STRING,manifest_path:STRING,source:STRING,links:STRING,categories:ARRAY<STRING>,keywords:ARRAY<STRING>,features:MAP<STRING,ARRAY<STRING>>,targets:ARRAY<STRUCT<kind:ARRAY<STRING>,name:STRING>>,dependencies:ARRAY<STRUCT<name:STRING,rename:STRING,kind:STRING,optional:BOOLEAN,target:STRING>>>>, workspace_members ARRAY<STRING>, workspace_root STRING, target_directory STRING, resolve STRUCT<nodes:ARRAY<STRUCT<id:STRING,features:ARRAY<STRING>,deps:ARRAY<STRUCT<name:STRING,pkg:STRING,dep_kinds:ARRAY<STRUCT<kind:STRING,target:STRING>>>>>>>"


def read_package_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).json(path, multiLine=True)


def packages(metadata: DataFrame) -> DataFrame:
    p = metadata.select("workspace_members", F.explode("packages").alias("p"))
    macro = F.exists("p.targets", lambda t: F.array_contains(t["kind"], "proc-macro"))
    return p.select("p.id", "p.name", "p.version", F.regexp_replace("p.manifest_path", "/[^/]*$", "").alias("dir"), F.array_contains("workspace_members", F.col("p.id")).alias("member"), F.col("p.source").isNull().alias("local"), "p.links", "p.categories", "p.keywords", "p.features", macro.alias("proc_macro"), "p.dependencies")


def dependencies(metadata: DataFrame) -> DataFrame:
    """a, b and kind (normal, build, dev) of every resolved edge, with the enabled features of a."""
    nodes = metadata.select(F.explode("resolve.nodes").alias("n"))
    deps = nodes.select(F.col("n.id").alias("a"), F.col("n.features").alias("enabled"), F.explode("n.deps").alias("d"))
    return deps.select("a", "enabled", F.col("d.pkg").alias("b"), F.col("d.name").alias("dep_name"), F.explode("d.dep_kinds").alias("k")).select("a", "b", "dep_name", "enabled", F.coalesce("k.kind", F.lit("normal")).alias("kind"))


def activated(deps: DataFrame, pkgs: DataFrame) -> DataFrame:
    """Edges that are part of the build: an optional dependency counts only if an enabled feature of its parent is
    its key or turns it on (`dep:x`, `x`, `x/f`); weak features (`x?/f`) do not."""
    declared = pkgs.select(F.col("id").alias("a"), F.explode("dependencies").alias("d")).select("a", F.replace(F.coalesce("d.rename", "d.name"), F.lit("-"), F.lit("_")).alias("dep_name"), F.coalesce("d.rename", "d.name").alias("key"), F.coalesce("d.optional", F.lit(False)).alias("optional"))
    declared = declared.groupBy("a", "dep_name").agg(F.bool_and("optional").alias("optional"), F.collect_set("key").alias("keys"))
    joined = deps.join(declared, ["a", "dep_name"], "left").join(pkgs.select(F.col("id").alias("a"), "features"), "a", "left")
    turns_on = lambda v: F.exists("keys", lambda k: (v == F.concat(F.lit("dep:"), k)) | v.startswith(F.concat(k, F.lit("/"))))
    by_feature = F.exists("enabled", lambda f: F.exists("keys", lambda k: k == f) | F.coalesce(F.exists(F.try_element_at("features", f), turns_on), F.lit(False)))
    return joined.where(~F.coalesce("optional", F.lit(False)) | by_feature).select("a", "b", "kind")


def scopes(pkgs: DataFrame, deps: DataFrame) -> DataFrame:
    """id, scope (0 required, 1 build), hops and parent of each package that the members' build needs. Normal edges keep
    the scope unless they leave a procedural macro; build edges give scope 1; the smaller scope wins."""
    macro = pkgs.select(F.col("id").alias("a"), "proc_macro")
    edges = deps.where("kind <> 'dev'").join(macro, "a", "left")
    to_build = (F.col("kind") == "build") | F.coalesce("proc_macro", F.lit(False))
    # Two layers of nodes, one a scope, turn the smallest label into plain reachability.
    layered = edges.select("a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"), to_build.alias("to_build"))
    node = lambda s, x: F.concat(s.cast("string"), F.lit(" "), x)
    layered = layered.select(node(F.col("s"), F.col("a")).alias("a"), node(F.greatest("s", F.col("to_build").cast("int")), F.col("b")).alias("b"))
    seeds = pkgs.where("member").select(node(F.lit(0), F.col("id")).alias("node"), F.lit(0).alias("label"))
    walked = graph.label_bfs(seeds, layered)
    split = walked.select(F.substring("node", 3, 1 << 20).alias("id"), F.substring("node", 1, 1).cast("int").alias("scope"), "hops", F.expr("substring(parent, 3)").alias("parent"))
    return split.groupBy("id").agg(F.min(F.struct("scope", "hops", "parent")).alias("s")).select("id", "s.scope", "s.hops", "s.parent")


FEATURE_LINE = r"^(\S+) v(\S+)(?: \([^)]*\))*\|(.*)$"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """name, version and the sorted set of features, from lines `name vX (..)|f1,f2`; repeats are merged."""
    lines = spark.read.text(path).where(F.col("value").rlike(FEATURE_LINE))
    part = lambda k: F.regexp_extract("value", FEATURE_LINE, k)
    rows = lines.select(part(1).alias("name"), part(2).alias("version"), F.explode(F.split(part(3), ",")).alias("feature"))
    return rows.groupBy("name", "version").agg(F.array_sort(F.array_remove(F.collect_set("feature"), "")).alias("features"))


def _table_keys(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(table, key, line, column) of the keys of a TOML text, by its own layout; columns count characters from 0."""
    table = ""
    for n, line in enumerate(text.split("\n"), 1):
        if head := re.match(r"\s*\[+\s*(.*?)\s*\]+\s*(#.*)?$", line):
            table = re.sub(r"\s+", "", head[1])
            parent, _, last = table.rpartition(".")
            if parent:
                yield parent, last.strip("\"'"), n, line.index(last.strip("\"'"))
        elif key := re.match(r"(\s*)([\"']?)([A-Za-z0-9_-]+)\2\s*(\.|=)", line):
            yield table, key[3], n, len(key[1])


def manifest_keys(manifests: DataFrame) -> DataFrame:
    """path, table, key, line and col of the keys of manifests(path, text), map-side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *k) for p, t in zip(batch["path"], batch["text"], strict=True) for k in _table_keys(t or "")]
            yield pd.DataFrame(rows, columns=["path", "table", "key", "line", "col"]).astype({"line": "int64", "col": "int64"})

    return manifests.select("path", "text").mapInPandas(run, "path string, table string, key string, line long, col long")


def dependency_key(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(path, key, kind, target) with line and col; a target's own table goes before the plain one."""
    name = F.when(F.col("kind") == "build", "build-dependencies").when(F.col("kind") == "dev", "dev-dependencies").otherwise("dependencies")
    plain = wanted.withColumn("table", name).withColumn("rank", F.lit(1))
    own = wanted.where("target IS NOT NULL").withColumn("table", F.concat(F.lit("target."), F.regexp_replace(F.concat(F.lit("'"), "target", F.lit("'")), r"\s", ""), F.lit("."), name)).withColumn("rank", F.lit(0))
    found = own.unionByName(plain).join(keys, ["path", "table", "key"]).groupBy("path", "key", "kind", "target").agg(F.min(F.struct("rank", "line", "col")).alias("at"))
    return found.select("path", "key", "kind", "target", "at.line", "at.col")


def links_key(keys: DataFrame) -> DataFrame:
    return keys.where("table = 'package' AND key = 'links'").select("path", "line", "col")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return source_lines(read_texts(spark, path))


def findings(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The distinct lines of logs that begin with the prefix, without it, in order."""
    lines = spark.read.text(path).where(F.col("value").startswith(prefix))
    return lines.select(F.substring("value", len(prefix) + 1, 1 << 20).alias("line")).distinct().orderBy("line")


# The sections of a knowledge base, and the foreign keys between them.
SECTIONS = ("crate", "type", "static", "fn", "part", "protocol", "use", "aside", "operation", "boundary", "enum", "role", "produces", "source", "passthrough", "seeded")
ROLES = ("algorithm", "trait", "protocol")


def read_knowledge(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """A table for each section with `ord`, its place in the text, and every field as text (nested ones as JSON). A
    knowledge base is authored by hand and read on the driver; unknown sections and bad patterns are refused."""
    data = tomllib.loads(text)
    known = {*SECTIONS, "unmodelled", "semantics"}
    if bad := sorted(set(data) - known):
        raise ValueError(f"unknown sections: {bad}")
    out = {}
    for section in SECTIONS:
        rows = data.get(section, [])
        for r in rows:
            if "path" in r:
                re.compile(r["path"])
        columns = sorted({k for r in rows for k in r})
        values = [(n, *[None if r.get(c) is None else r[c] if isinstance(r[c], str) else json.dumps(r[c], sort_keys=True) for c in columns]) for n, r in enumerate(rows)]
        out[section] = spark.createDataFrame(values, "ord long" + "".join(f", `{c}` string" for c in columns))
    return out


def knowledge_errors(kb: dict[str, DataFrame], families: list[str] | None = None) -> DataFrame:
    """section, ord and what is wrong; empty for a sound knowledge base."""
    spark = kb["crate"].sparkSession
    out = spark.createDataFrame([], "section string, ord long, error string")
    if "role" in kb["crate"].columns:
        out = out.unionByName(kb["crate"].where(~F.col("role").isin(*ROLES)).select(F.lit("crate").alias("section"), "ord", F.concat(F.lit("no such role: "), "role").alias("error")))
    crates = kb["crate"].select(F.replace("package", F.lit("-"), F.lit("_")).alias("crate")).distinct() if "package" in kb["crate"].columns else None
    for section in ("type", "fn", "static", "operation", "boundary"):
        table = kb[section]
        if crates is not None and "crate" in table.columns:
            missing = table.where(~F.col("crate").startswith("[")).join(crates, "crate", "left_anti")
            out = out.unionByName(missing.select(F.lit(section).alias("section"), "ord", F.concat(F.lit("no such crate: "), "crate").alias("error")))
        if families is not None and "family" in table.columns:
            out = out.unionByName(table.where(F.col("family").isNotNull() & ~F.col("family").isin(families)).select(F.lit(section).alias("section"), "ord", F.concat(F.lit("no such family: "), "family").alias("error")))
    return out


def supported(pkgs: DataFrame, crates: DataFrame) -> DataFrame:
    """Packages in the knowledge base's version ranges that are not local."""
    joined = pkgs.where("NOT local").join(small(crates.select(F.col("package").alias("name"), "versions", "role")), "name")
    return joined.where(F.col("versions").isNull() | semver_covers("versions", "version"))


def read_labels(spark: SparkSession, text: str) -> DataFrame:
    """file, line, callee, function and the sets must and may of a label file's sites."""
    rows = [(s["file"], s["line"], s["callee"], s.get("function"), sorted(s.get("must", [])), sorted(s.get("may", [])), s.get("note")) for s in tomllib.loads(text).get("site", [])]
    return spark.createDataFrame(rows, "file string, line long, callee string, function string, must array<string>, may array<string>, note string")


def read_projects(spark: SparkSession, text: str) -> DataFrame:
    rows = [(p["labels"], p.get("path") or p.get("crate"), p.get("version"), p.get("sha256")) for p in tomllib.loads(text).get("project", [])]
    return spark.createDataFrame(rows, "labels string, project string, version string, sha256 string")


def wrong_archives(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Projects whose archive in files(project, content) has another hash, or is not there."""
    hashed = files.select("project", F.sha2("content", 256).alias("actual"))
    return projects.join(hashed, "project", "left").where(~F.col("actual").eqNullSafe(F.col("sha256")))
