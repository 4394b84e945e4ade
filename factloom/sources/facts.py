"""The facts model: one JSON document for each compiled unit, read into tables. Recursive values stay JSON text until
`operators.trees` flattens them, because Spark has no recursive struct type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.joins import small

FACTS_VERSION = 37  # fixed value: the only version of the facts that is understood

CRATE = "STRUCT<name:STRING,stable_id:STRING>"
LOC = "STRUCT<file:STRING,line:BIGINT,col:BIGINT,end_line:BIGINT,end_col:BIGINT>"
DEF = f"STRUCT<krate:{CRATE},path:STRING,id:STRING>"
OWNER = f"STRUCT<kind:STRING,name:STRING,id:STRING,krate:{CRATE},path:STRING>"
CALL = f"STRUCT<callee:{DEF},method:STRING,self_ty:STRING,args:ARRAY<STRING>,const_args:ARRAY<STRING>,arg_origins:ARRAY<STRING>,arg_lens:ARRAY<DECIMAL(20,0)>,value:BOOLEAN>"
POINTER = "STRUCT<origin:STRING,const_args:ARRAY<STRING>,arg_origins:ARRAY<STRING>,arg_lens:ARRAY<DECIMAL(20,0)>,sig:STRING>"
TARGET = f"STRUCT<Call:{CALL},Pointer:{POINTER},Const:STRUCT<def:{DEF}>,Static:STRUCT<def:{DEF}>>"
SITE = f"STRUCT<tier:STRING,owner:{OWNER},span:{LOC},text:STRING,line_text:STRING,expansion:STRUCT<kind:STRING,macro_name:STRING,def_site:{LOC}>,target:{TARGET},via:ARRAY<STRUCT<caller:STRING,span:{LOC},text:STRING>>,call:STRUCT<span:{LOC},named:STRING>>"
BOUNDARY = f"STRUCT<owner:{OWNER},span:{LOC},callee:{DEF},trait_path:STRING,coroutine:BOOLEAN,types:ARRAY<STRING>,through_value:BOOLEAN,on_behalf:STRING,call:STRUCT<span:{LOC},named:STRING>,text:STRING,std_entry:STRING>"
PTA_ARG = f"STRUCT<statics:ARRAY<{DEF}>,unknown:BOOLEAN,others:BIGINT,pointee:STRING,direct:BOOLEAN>"
REACH = f"STRUCT<artifact:STRING,instances:BIGINT,truncated:BOOLEAN,statics:ARRAY<{DEF}>,fns:ARRAY<STRING>,paths:ARRAY<STRING>,shims:ARRAY<STRING>,uncalled:ARRAY<STRING>,generic:ARRAY<STRING>,crates:ARRAY<{CRATE}>,crates_complete:BOOLEAN,points_to:STRUCT<calls:ARRAY<STRUCT<at:{LOC},callee:STRING,owner:STRING,owner_def:STRING,live:BOOLEAN,args:ARRAY<{PTA_ARG}>>>>,boundary:ARRAY<{BOUNDARY}>>"
#: The value-flow relations; entries stay JSON text.
LINKS = ("fields", "returns", "calls", "statics", "writes", "coercions", "coercion_types", "closed_calls", "closed_bounds", "truncated", "arg_calls", "summarised", "named", "opaque", "dyn_calls")
SCHEMA = f"facts_version INT, krate STRUCT<name:STRING,stable_id:STRING,package:STRING,version:STRING,cwd:STRING,unit:STRING>, sites ARRAY<{SITE}>, data_edges ARRAY<STRUCT<owner:{OWNER},target:{DEF}>>, reach {REACH}, links STRUCT<{','.join(f'{n}:ARRAY<STRING>' for n in LINKS)}>, fields MAP<STRING,ARRAY<STRING>>, variants MAP<STRING,ARRAY<ARRAY<STRING>>>, implementors MAP<STRING,ARRAY<STRING>>"


def read_facts(spark: SparkSession, path: str, units: DataFrame | None = None) -> DataFrame:
    """Facts of this build's units (a table of `unit`, or all), with `unit` the file's stem. Another version of the
    facts fails the query."""
    facts = spark.read.schema(SCHEMA).json(path, multiLine=True)
    facts = facts.withColumn("unit", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    build = F.col("unit")
    if units is not None:
        # The check reads the units' side, so that it cannot run before other builds' files are left out.
        wanted = units.select(F.col("unit").alias("_build")).distinct()
        facts = facts.join(small(wanted), F.concat("unit", F.lit("")) == F.col("_build"))
        build = F.col("_build")
    wrong = F.raise_error(F.concat(F.lit("facts version "), F.coalesce(F.col("facts_version").cast("string"), F.lit("missing")), F.lit(f", not {FACTS_VERSION}, in "), build)).cast("int")
    return facts.withColumn("facts_version", F.when(F.col("facts_version").eqNullSafe(FACTS_VERSION), F.col("facts_version")).otherwise(wrong)).drop("_build")


def in_order(facts: DataFrame) -> DataFrame:
    return facts.orderBy("krate.name", "krate.stable_id", "unit")


def sites(facts: DataFrame) -> DataFrame:
    """A row for each site: unit, ord, kind of target and its parts."""
    rows = facts.where("facts_version IS NOT NULL").select("unit", F.col("krate").alias("in_crate"), F.posexplode("sites").alias("ord", "s"))
    kind = F.when(F.col("s.target.Call").isNotNull(), "call").when(F.col("s.target.Pointer").isNotNull(), "pointer").when(F.col("s.target.Const").isNotNull(), "const").otherwise("static")
    target = F.coalesce("s.target.Call.callee", "s.target.Const.def", "s.target.Static.def")
    return rows.select("unit", "ord", "in_crate", kind.alias("kind"), F.col("s.tier").alias("tier"), F.col("s.owner.name").alias("owner"), F.col("s.owner.path").alias("owner_path"), F.col("s.span.file").alias("file"), F.col("s.span.line").alias("line"), (F.col("s.span.col") - 1).alias("offset"), target["krate"]["name"].alias("crate"), target["krate"]["stable_id"].alias("stable_id"), target["path"].alias("path"), target["id"].alias("def_id"), F.col("s.target.Call.method").alias("method"), F.col("s.target.Call.self_ty").alias("self_ty"), F.coalesce("s.target.Call.args", F.array().cast("array<string>")).alias("type_args"), F.coalesce("s.target.Call.arg_origins", "s.target.Pointer.arg_origins").alias("arg_origins"), F.coalesce("s.target.Call.const_args", "s.target.Pointer.const_args").alias("const_args"))


def reached_functions(facts: DataFrame) -> DataFrame:
    return facts.where("reach IS NOT NULL").select(F.col("reach.artifact").alias("artifact"), F.explode("reach.fns").alias("owner"))


def boundary_edges(facts: DataFrame) -> DataFrame:
    rows = facts.where("reach IS NOT NULL").select(F.col("reach.artifact").alias("artifact"), F.explode("reach.boundary").alias("b"))
    return rows.select("artifact", F.col("b.owner.name").alias("owner"), F.col("b.span.file").alias("file"), F.col("b.span.line").alias("line"), (F.col("b.span.col") - 1).alias("offset"), F.col("b.callee.krate.name").alias("crate"), F.col("b.callee.path").alias("path"), F.col("b.trait_path").alias("trait_path"), F.col("b.on_behalf").alias("on_behalf"), F.col("b.std_entry").alias("std_entry"), F.coalesce("b.coroutine", F.lit(False)).alias("coroutine"))


def points_to_calls(facts: DataFrame) -> DataFrame:
    """call position, argument index and its answer."""
    calls = facts.where("reach IS NOT NULL").select(F.explode("reach.points_to.calls").alias("c"))
    args = calls.select(F.col("c.at").alias("at"), F.col("c.callee").alias("callee"), F.col("c.live").alias("live"), F.posexplode("c.args").alias("arg", "a"))
    return args.select("at.file", "at.line", "at.col", "callee", "live", "arg", F.transform("a.statics", lambda d: d["path"]).alias("statics"), F.col("a.unknown").alias("unknown"), F.col("a.others").alias("others"), F.col("a").isNotNull().alias("answered"))


def links(facts: DataFrame, relation: str) -> DataFrame:
    """The entries of a value-flow relation, without repeats, as JSON text."""
    if relation not in LINKS:
        raise ValueError(f"no such relation: {relation}")
    return facts.select(F.explode(F.col("links")[relation]).alias("entry")).distinct()


def data_edges(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode("data_edges").alias("e")).select(F.col("e.owner.id").alias("a"), F.col("e.target.id").alias("b")).distinct()


def write_facts(facts: DataFrame, path: str) -> None:
    """One JSON document a unit, in a folder for each."""
    facts.write.partitionBy("unit").json(path)
