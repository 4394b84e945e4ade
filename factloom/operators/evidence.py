"""What evidence rows say together: rows that stronger rows make needless, moves between assets, findings, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.joins import small
from factloom.operators.merges import sorted_set

PLACE = ["location", "line", "offset"]


def not_implementations(sites: DataFrame, roles: DataFrame, crate: str = "crate") -> DataFrame:
    """sites outside crates that implement algorithms or define traits; a crate without a role stays."""
    return sites.join(small(roles.where("role IN ('algorithm', 'trait')").select(crate).distinct()), crate, "left_anti")


def unaccounted(namings: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """Namings of functions that no pointer call uses up."""
    return namings.join(used.select(*key).distinct(), key, "left_anti")


def live(routes: DataFrame, reached_ids: DataFrame, reached_paths: DataFrame) -> DataFrame:
    """routes(kind, writer, static_id) with `live`: a caller, a stored, tabled or static value counts if its static's id,
    or else its writer's path, is reached; a value put in a static needs both, where the static is known; what a call
    itself returns is always on its way. No writer, or an implementation (` for `), counts."""
    ids = reached_ids.select(F.col("id").alias("static_id"), F.lit(True).alias("_id"))
    paths = reached_paths.select(F.col("path").alias("writer"), F.lit(True).alias("_path"))
    joined = routes.join(ids.distinct(), "static_id", "left").join(paths.distinct(), "writer", "left")
    has_id, has_path = F.coalesce("_id", F.lit(False)), F.coalesce("_path", F.lit(False))
    by_path = (F.coalesce("writer", F.lit("")) == "") | F.contains(F.coalesce("writer", F.lit("")), F.lit(" for ")) | has_path
    alive = F.when(F.col("kind").isin("caller", "join", "table", "static"), F.when(F.col("static_id").isNotNull(), has_id).otherwise(by_path))
    alive = alive.when(F.col("kind") == "store", has_path & (F.col("static_id").isNull() | has_id)).otherwise(True)
    return joined.withColumn("live", alive).drop("_id", "_path")


def candidates(features: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Candidate assets of packages for which nothing was found."""
    return features.join(found.select(*key).distinct(), key, "left_anti")


def site_occurrences(labels: DataFrame, occurrences: DataFrame, key: list[str], place: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """labels with the occurrences at their place; where some of these name the label's callee, only those."""
    pairs = labels.join(occurrences, list(place))
    named = F.contains(F.col("symbol"), F.col("callee"))
    any_named = pairs.groupBy(*key).agg(F.bool_or(named).alias("_any"))
    return pairs.join(any_named, key).where(~F.col("_any") | named).drop("_any")


def observed_functions(rows: DataFrame, key: list[str], functions: str = "functions", reachable: str = "reachable") -> DataFrame:
    """key and the distinct functions of its reachable rows, of all where none is; ` or ` parts them."""
    each = rows.select(*key, reachable, F.explode(F.split(F.col(functions), " or ")).alias("_f"))
    good = F.array_sort(F.collect_set(F.when(F.col(reachable), F.col("_f"))))
    return each.groupBy(*key).agg(F.array_join(F.when(F.bool_or(reachable), good).otherwise(F.array_sort(F.collect_set("_f"))), ",").alias("observed"))


def instantiated_in_a_mode(occurrences: DataFrame, leads: DataFrame, same_cipher: DataFrame, components: DataFrame) -> DataFrame:
    """occurrences(asset, kind, location, line, offset) after an instantiation of a cipher moves to the assets of its
    modes. leads(asset, location, line, offset) says what was made through a place; same_cipher(asset, mode_asset) which
    assets are the cipher in a mode; components(asset, part) which hold it. One that leads to its own asset, to one that
    holds it, or to no mode of it, stays."""
    inst = occurrences.where("kind = 'instantiation'").select("asset", *PLACE).distinct()
    led = inst.join(leads.select(F.col("asset").alias("to"), *PLACE).distinct(), PLACE)
    held = led.join(components.select(F.col("asset").alias("to"), F.col("part").alias("asset")).distinct(), ["to", "asset"], "left_semi")
    stays = held.select("asset", *PLACE).union(led.where("to = asset").select("asset", *PLACE)).distinct()
    moves = led.join(stays, ["asset", *PLACE], "left_anti").join(same_cipher.select("asset", F.col("mode_asset").alias("to")), ["asset", "to"], "left_semi")
    gone = moves.select("asset", *PLACE, F.lit("instantiation").alias("kind")).distinct()
    kept = occurrences.select("asset", "kind", *PLACE).join(gone, ["asset", "kind", *PLACE], "left_anti")
    come = moves.select(F.col("to").alias("asset"), F.lit("instantiation").alias("kind"), *PLACE).distinct()
    return kept.unionByName(come.join(kept.select("asset", *PLACE).distinct(), ["asset", *PLACE], "left_anti"))


def without_answered_unknowns(rows: DataFrame, made_through: DataFrame) -> DataFrame:
    """rows(known, kind, symbol, generic_body, location, line, offset, ..) without unknown rows of generic bodies where a
    known call of the same symbol stands, and without unknown rows that made_through(inner place, location, line, offset)
    traces to the call of a known operation."""
    known = rows.where("known AND kind = 'call'")
    at = [*PLACE, "symbol"]
    unknown = rows.where("NOT known")
    answered = unknown.where("generic_body").join(known.select(*at).distinct(), at, "left_semi")
    inner = made_through.join(known.select(*[F.col(c).alias(f"outer_{c}") for c in PLACE]).distinct(), [f"outer_{c}" for c in PLACE], "left_semi").select(*PLACE).distinct()
    left = unknown.join(answered.select(*at, "generic_body").distinct(), [*at, "generic_body"], "left_anti").join(inner, PLACE, "left_anti")
    return rows.where("known").unionByName(left)


def merged_links(*parts: DataFrame, key: list[str], flags: list[str] = (), sets: list[str] = ()) -> DataFrame:
    """Link records of all parts, one an id: flags hold if any does, sets are united."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*key).agg(*[F.bool_or(f).alias(f) for f in flags], *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(s)))).alias(s) for s in sets])


def findings(rows: DataFrame, key: list[str], role: str = "role", kind: str = "kind", reachable: str = "reachable") -> DataFrame:
    """A row for each role of an asset: its kinds, and the finding: `finding` if a reachable value is hard-coded,
    `present` if only unreachable ones are, else null."""
    hard = F.col(kind) == "hard-coded"
    told = F.when(F.bool_or(hard & F.col(reachable)), "finding").when(F.bool_or(hard), "present")
    return rows.groupBy(*key, role).agg(sorted_set(kind).alias("kinds"), told.alias("finding"))


def excuse_counts(calls: DataFrame, verdict: str = "verdict", reason: str = "reason") -> DataFrame:
    """Boundary calls by verdict and reason, with the share of all."""
    total = calls.agg(F.count(F.lit(1)).alias("all"))
    counts = calls.groupBy(verdict, reason).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(total)).select(verdict, reason, "n", F.round(F.col("n") / F.col("all"), 3).alias("share"))  # one row


def package_score(labelled: DataFrame, reported: DataFrame, key: list[str], kind: str = "kind") -> DataFrame:
    """Layer-1 scores: for crypto and for support packages, how many are labelled, reported, both, missed and extra. A
    package counts on the side that each list gives it."""
    side = lambda df, name: df.select(*key, F.when(F.col(kind) == "support", "support").otherwise("crypto").alias("side"), F.lit(True).alias(name)).distinct()
    both = side(labelled, "_l").join(side(reported, "_r"), [*key, "side"], "full")
    here = lambda c: F.coalesce(c, F.lit(False))
    left, right = here(F.col("_l")), here(F.col("_r"))
    return both.groupBy("side").agg(F.count_if(left).alias("labelled"), F.count_if(right).alias("reported"), F.count_if(left & right).alias("found"), F.count_if(left & ~right).alias("missed"), F.count_if(right & ~left).alias("extra"))


def verdict_histogram(sites: DataFrame, verdict: str = "verdict", function_differs: str = "function_differs") -> DataFrame:
    """Layer-2 scores: sites by verdict, with those whose functions alone differ apart."""
    split = F.when(F.col(function_differs) & (F.col(verdict) == "correct"), "function mismatch").otherwise(F.col(verdict))
    return sites.groupBy(split.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def providers(uses: DataFrame, package: str, asset: str) -> DataFrame:
    """package and the assets it provides."""
    return uses.groupBy(package).agg(sorted_set(asset).alias("provides"), F.count_distinct(asset).alias("n_assets"))


def strongest_at(rows: DataFrame, key: list[str], tier: str, order: list[str]) -> DataFrame:
    """One row a place, of the strongest tier and the least of equals."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(tier), *[-F.col(o) for o in order])).alias("_b"))
    return best.select(*key, *[F.col("_b")[c].alias(c) for c in rest])


def best_route(values: DataFrame, key: list[str], is_join: str, rank: str, route: str) -> DataFrame:
    """One route a value: no type-join before one, then the lesser rank, then the route's text."""
    return values.groupBy(*key).agg(F.min(F.struct(F.col(is_join).alias("is_join"), F.col(rank).alias("rank"), F.col(route).alias("route"))).alias("_r")).select(*key, "_r.*")


def exact_among_several(occurrences: DataFrame, group: list[str], exact: Column) -> DataFrame:
    """Places where several assets are reported and one claims to be exact: group, number of assets."""
    return occurrences.groupBy(*group).agg(F.count_distinct("asset").alias("n_assets"), F.bool_or(exact).alias("_x")).where("n_assets > 1 AND _x").drop("_x")
