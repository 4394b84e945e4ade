"""Lookups in a pattern knowledge base: which entry names a thing, whether it holds, and what it says of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import closure
from factloom.operators.joins import first_match, small


def by_name_and_version(rows: DataFrame, packages: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """rows with the package of exactly that name and version."""
    return rows.join(small(packages), [name, version])


def keyed_index(links: DataFrame, key: list[str]) -> DataFrame:
    """Distinct links laid out by a key, so that lookups by it need no further exchange."""
    return links.dropDuplicates().repartition(*[F.col(k) for k in key])


def at_call_site(rows: DataFrame, sites: DataFrame, place: tuple[str, ...] = ("owner", "file", "line", "col")) -> DataFrame:
    """rows joined to the call sites at the same place."""
    return rows.join(sites, list(place))


def in_listed_crates(rows: DataFrame, entries: DataFrame, key: list[str], crate: str, path: str, crates: str = "crates", order: str = "ord", how: str = "inner") -> DataFrame:
    """Each row with the first entry that lists its crate and whose pattern finds its path: operations name several
    crates an entry, protocols and boundary models one. The lists are exploded, so the join is by equality."""
    flat = entries.withColumn("_crate", F.explode(crates)).drop(crates)
    return first_match(rows, flat, key, [(crate, "_crate")], F.expr(f"{path} RLIKE pattern"), order, how).drop("_crate")


def entries_that_apply(entries: DataFrame, crates: DataFrame, holds: Column, name: str = "name") -> DataFrame:
    """entries whose restriction holds for every crate of that name in the build, of which there must be one. A null
    restriction always holds. holds compares an entry's `versions` with a crate's `version`."""
    free = entries.where("versions IS NULL")
    told = entries.where("versions IS NOT NULL").join(crates.select(name, "version"), name)
    fit = told.groupBy(*entries.columns).agg(F.bool_and(holds).alias("_fits")).where("_fits").drop("_fits")
    return free.unionByName(fit)


def opaque_types(types: DataFrame, local: DataFrame, unmodelled: DataFrame, modelled: DataFrame, key: list[str], name: str) -> DataFrame:
    """The types that are algorithms of their own, not looked through: of crates that are not the program's, and are
    either unmodelled or modelled as something else than a trait crate (modelled: name, role)."""
    foreign = types.join(small(local.select(*key).distinct()), key, "left_anti")
    own = foreign.join(small(unmodelled.select(*key).distinct()), key, "left_semi")
    named = foreign.join(small(modelled.where("role <> 'trait'").select(name).distinct()), name, "left_semi")
    return own.unionByName(named).distinct()


# Metadata that says what a package is.
CRYPTO_CATEGORIES = ["cryptography"]
CRYPTO_KEYWORDS = ["crypto", "cryptography", "encryption", "tls", "certificate", "x509"]
SUPPORT_CATEGORIES = ["encoding", "parser-implementations", "memory-management"]


def unmodelled_class(package: Column, categories: Column, keywords: Column, listed_crypto: list[str], listed_support: list[str], named: Column) -> Column:
    """crypto, support or null for a package without an entry: the crypto list decides; else its metadata, or its name
    where it has no category; of these, support crates are told by list or category."""
    lower = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), F.lower)
    has = lambda xs, words: F.arrays_overlap(lower(xs), F.array(*[F.lit(w) for w in words]))
    no_category = F.size(F.coalesce(categories, F.array().cast("array<string>"))) == 0
    crypto = has(categories, CRYPTO_CATEGORIES) | has(keywords, CRYPTO_KEYWORDS) | (no_category & named)
    support = package.isin(listed_support) | has(categories, SUPPORT_CATEGORIES)
    return F.when(package.isin(listed_crypto), "crypto").when(~crypto, None).when(support, "support").otherwise("crypto")


def uses_of(calls: DataFrame, uses: DataFrame, key: list[str], method: str = "method", primitive: str = "primitive") -> DataFrame:
    """calls with `use`: the functions of all entries of uses(method, primitive or null for any, function, ord), joined
    by ` or ` in the entries' order; null where none fits."""
    rules = small(uses.select(F.col("method").alias("_m"), F.col("primitive").alias("_p"), "function", "ord"))
    fit = calls.join(rules, (calls[method] == F.col("_m")) & (F.col("_p").isNull() | (calls[primitive] == F.col("_p"))), "left")
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col("function").isNotNull(), F.struct("ord", "function")))), lambda x: x["function"])
    others = [F.first(c).alias(c) for c in calls.columns if c not in key]
    return fit.groupBy(*key).agg(F.nullif(F.array_join(told, " or "), F.lit("")).alias("use"), *others)


def suffix_lookup(calls: DataFrame, table: DataFrame, path: str, suffix: str = "suffix", separator: str = "::") -> DataFrame:
    """calls with the longest row of a table whose suffix ends the path at a separator. The join is by the last two
    parts (the last, for one-part suffixes), then the suffix is compared."""
    tail = lambda c, n: F.substring_index(c, separator, -n)
    rest = [c for c in table.columns if c != suffix]
    rules = table.withColumn("_tail", F.when(F.instr(suffix, separator) > 0, tail(F.col(suffix), 2)).otherwise(F.col(suffix)))
    asked = calls.select(path).distinct().withColumn("_tail", F.explode(F.array_distinct(F.array(tail(F.col(path), 1), tail(F.col(path), 2)))))
    ends = (F.col(path) == F.col(suffix)) | F.endswith(F.col(path), F.concat(F.lit(separator), F.col(suffix)))
    best = asked.join(small(rules), "_tail").where(ends).groupBy(path).agg(F.max_by(F.struct(suffix, *rest), F.length(suffix)).alias("_b"))
    return calls.join(best.select(path, *[F.col("_b")[c].alias(c) for c in [suffix, *rest]]), path, "left")


def with_default_by_text(rows: DataFrame, names: DataFrame, text: str, part: str, out: str, default: Column) -> DataFrame:
    """rows with names' value for the least part that stands between separators in the text, else the default. The
    text's parts are exploded, so the join is by equality."""
    asked = rows.select(text).distinct()
    inner = F.filter(F.slice(F.split(text, "::"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(text, "::")) - 2)), lambda x: x != "")
    found = asked.withColumn(part, F.explode(inner)).join(small(names), part).groupBy(text).agg(F.min_by(out, part).alias(out))
    return rows.join(found, text, "left").withColumn(out, F.coalesce(out, default))


def carriers(types: DataFrame, fields: DataFrame, algorithms: DataFrame) -> DataFrame:
    """The types that carry an algorithm: algorithms themselves, and types with a field, of a field, of such a type."""
    inside = closure(fields.select(F.col("type").alias("a"), F.col("field_type").alias("b")))
    through = inside.join(algorithms.select(F.col("type").alias("b")), "b", "left_semi").select(F.col("a").alias("type"))
    return types.join(through.union(algorithms.select("type")).distinct(), "type", "left_semi")


def implementations(calls: DataFrame, bodies: DataFrame) -> DataFrame:
    """calls(callee, self_type or null) with the bodies(callee, self_type, body) that implement the method: those of the
    receiver's type, or all where it is not known, with the route that says which."""
    exact = calls.where("self_type IS NOT NULL").join(bodies, ["callee", "self_type"]).withColumn("route", F.lit("receiver"))
    every = calls.where("self_type IS NULL").drop("self_type").join(bodies, "callee").withColumn("route", F.lit("any implementation"))
    return exact.unionByName(every)


def bound_sites(sites: DataFrame, given: DataFrame) -> DataFrame:
    """One row of sites(function, param) for each type that closed callers give the parameter: given(function, param,
    types, open). Sites whose parameter is open or not given stay as they are, with a null type."""
    return sites.join(given.where("NOT open").select("function", "param", "types"), ["function", "param"], "left").withColumn("type", F.explode_outer("types")).drop("types")


def parts_of(outer: DataFrame, parts: DataFrame) -> DataFrame:
    """The algorithms that outer(name, family, values) computes inside itself: each entry of parts(of, template, param,
    source, scale) that names its family or its name. A parameter comes from the outer values, multiplied by the scale;
    one that does not resolve ends the name, and `open` says so."""
    rules = small(parts)
    hit = outer.join(rules, outer["family"] == rules["of"]).unionByName(outer.join(rules, outer["name"] == rules["of"]))
    raw = F.element_at("values", F.col("source"))
    value = F.when(F.col("scale").isNull(), raw).otherwise((raw.try_cast("long") * F.col("scale")).cast("string"))
    hole = F.concat(F.lit("{"), F.col("param"), F.lit("}"))
    filled = F.when(value.isNull(), F.regexp_replace(F.split_part(F.col("template"), hole, F.lit(1)), "-$", "")).otherwise(F.replace(F.col("template"), hole, value))
    return hit.select("name", filled.alias("part"), (value.isNull() & F.contains(F.col("template"), hole)).alias("open")).distinct()


def required_parameters(matches: DataFrame, values: DataFrame, key: list[str], required: str = "required") -> DataFrame:
    """The matches all of whose required parameters resolve; values(key.., param, value) are what is known."""
    known = values.where("value IS NOT NULL").groupBy(*key).agg(F.collect_set("param").alias("_known"))
    joined = matches.join(known, key, "left")
    missing = F.array_except(F.col(required), F.coalesce("_known", F.array().cast("array<string>")))
    return joined.where(F.size(missing) == 0).drop("_known")


def call_value(const_args: Column, arg_lens: Column, const_arg: Column, scale: Column, arg_len: Column, value: Column) -> Column:
    """A parameter by a call's arguments: an integer constant times the scale where const_arg says which, else the length
    of the array that arg_len says, else the fixed value. A place beyond the arguments gives nothing."""
    constant = F.when(F.size(const_args) > const_arg, F.get(const_args, const_arg)) * F.coalesce(scale, F.lit(1))
    length = F.when(F.size(arg_lens) > arg_len, F.get(arg_lens, arg_len))
    return F.when(const_arg.isNotNull(), constant.cast("string")).when(arg_len.isNotNull(), length.cast("string")).otherwise(value)


def open_placeholders(template: Column, values: Column) -> Column:
    """The placeholders of a template outside its optional parts that the values leave open, in order."""
    bare = F.regexp_replace(template, r"\[[^\[\]]*\]", "")  # inner optional parts, then outer ones
    required = F.regexp_replace(bare, r"\[[^\[\]]*\]", "")
    return F.filter(F.regexp_extract_all(required, F.lit(r"\{(\w+)\}"), F.lit(1)), lambda x: ~F.map_contains_key(values, x))


def tree_parameter(nodes: DataFrame, path: list[int], mapping: DataFrame | None = None, scale: int = 1) -> DataFrame:
    """root_id and value: the type at an indexed path below each root, mapped by mapping(name, value); a number is
    multiplied by the scale."""
    at = nodes.where("parent_id IS NULL").select("root_id", "node_id", "name")
    kids = nodes.select("root_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("kid"), F.col("name").alias("kid_name"), F.col("slot"))
    for index in path:
        at = at.join(kids.where(F.col("slot") == index), ["root_id", "node_id"]).select("root_id", F.col("kid").alias("node_id"), F.col("kid_name").alias("name"))
    number = F.col("name").try_cast("long")
    plain = F.when(number.isNotNull(), (number * scale).cast("string")).otherwise(F.col("name"))
    if mapping is None:
        return at.select("root_id", plain.alias("value"))
    return at.join(small(mapping.withColumnRenamed("value", "_mapped")), "name", "left").select("root_id", F.coalesce("_mapped", plain).alias("value"))


def location(paths: DataFrame, packages: DataFrame, path: str, root: str, target: str) -> DataFrame:
    """paths with `location`: `target/..` in the target folder, `<name>-<version>/..` in a package of
    packages(dir, name, version, member) that is no member, relative to the root in the workspace, else as it is."""
    from factloom.operators.joins import longest_prefix

    p = F.col(path)
    owned = longest_prefix(paths, path, packages, "dir")
    below = lambda prefix: F.substr(p, F.length(prefix) + 2)
    named = F.concat_ws("/", F.concat_ws("-", "name", "version"), below(F.col("dir")))
    place = F.when(F.startswith(p, F.lit(f"{target}/")), F.concat(F.lit("target/"), below(F.lit(target)))).when(F.col("dir").isNotNull() & ~F.col("member"), named)
    return owned.withColumn("location", place.when(F.startswith(p, F.lit(f"{root}/")), below(F.lit(root))).otherwise(p)).select(*paths.columns, "location")


def resolved_location(locations: DataFrame, packages: DataFrame, column: str, root: str, target: str) -> DataFrame:
    """The inverse of location: locations with `path`. A location's first part is joined to `<name>-<version>`."""
    c, first = F.col(column), F.substring_index(column, "/", 1)
    known = packages.groupBy(F.concat_ws("-", "name", "version").alias("_first")).agg(F.min("dir").alias("_dir"))
    joined = locations.withColumn("_first", F.when(F.contains(c, F.lit("/")), first)).join(small(known), "_first", "left")
    rest = F.substr(c, F.length(first) + 2)
    path = F.when(F.col("_dir").isNotNull(), F.concat_ws("/", "_dir", rest)).when(F.startswith(c, F.lit("target/")), F.concat_ws("/", F.lit(target), rest))
    return joined.withColumn("path", path.when(F.startswith(c, F.lit("/")), c).otherwise(F.concat_ws("/", F.lit(root), c))).drop("_first", "_dir")
