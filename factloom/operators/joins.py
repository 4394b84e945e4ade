"""Join operators: ordered first matches, prefix and disjunctive matches, anti-joins with reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a rule table up to which it is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; otherwise as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_match(rows: DataFrame, rules: DataFrame, key: list[str], equal: list[tuple[str, str]], condition: Column, order: str = "ord", how: str = "inner") -> DataFrame:
    """Each row with the first rule, by order, that agrees on the equal columns and meets the condition; the key, which
    may be null, tells rows apart.

    The equalities keep the plan a hash join with the condition as its residual. One aggregation by the key picks the
    first rule and keeps the row, so neither side is read again.
    """
    on = reduce(lambda x, y: x & y, [rows[a] == rules[b] for a, b in equal], condition) if equal else condition
    rest = [c for c in rules.columns if c != order]
    matched = rows.join(small(rules), on, how)
    rule = F.min_by(F.struct(*[rules[c].alias(c) for c in rest], rules[order].alias(order)), rules[order])
    others = [c for c in rows.columns if c not in key]
    best = matched.groupBy(*[rows[k] for k in key]).agg(rule.alias("_rule"), *[F.first(rows[c]).alias(c) for c in others])
    return best.select(*rows.columns, *[F.col("_rule")[c].alias(c) for c in [*rest, order]])


def first_literal_match(rows: DataFrame, column: str, patterns: list[tuple[str, str]], out: str = "match") -> DataFrame:
    """rows with the name of the first pattern of an ordered literal list that the column matches, else null. A list in
    the plan needs no join."""
    chain: Column | None = None
    for name, pattern in patterns:
        hit = F.col(column).rlike(pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return rows.withColumn(out, chain if chain is not None else F.lit(None).cast("string"))


def longest_prefix(rows: DataFrame, column: str, prefixes: DataFrame, prefix: str, separator: str = "/", how: str = "left") -> DataFrame:
    """Each row with the prefix row whose prefix is the longest that the column starts with, at separators.

    The ancestors of the column's distinct values are exploded and joined by equality, so the plan is a hash join however
    many prefixes there are; ties cannot occur, as equal prefixes are one row (the least).
    """
    values = rows.select(F.col(column).alias("_value")).where("_value IS NOT NULL").distinct()
    parts = F.split("_value", F.lit(separator), -1)
    ancestors = values.select("_value", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))).alias("_prefix"))
    rest = [c for c in prefixes.columns if c != prefix]
    unique = small(prefixes.groupBy(prefix).agg(*[F.min(c).alias(c) for c in rest]))
    best = ancestors.join(unique, ancestors["_prefix"] == unique[prefix]).groupBy("_value").agg(F.max_by(F.struct(prefix, *rest), F.length(prefix)).alias("_best"))
    found = best.select("_value", *[F.col("_best")[c].alias(c) for c in [prefix, *rest]])
    return rows.join(found, rows[column] == found["_value"], how).drop("_value")


def longest_literal_prefix(rows: DataFrame, column: str, prefixes: list[tuple[str, str]], out: str = "match") -> DataFrame:
    """rows with the name of the longest of a literal list of prefixes that the column starts with, else null."""
    chain: Column | None = None
    for prefix, name in sorted(prefixes, key=lambda x: (-len(x[0]), x[0])):
        hit = F.col(column).startswith(prefix)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return rows.withColumn(out, chain if chain is not None else F.lit(None).cast("string"))


def disjunctive_first(rows: DataFrame, rules: DataFrame, key: list[str], arms: list[list[tuple[str, str]]], order: str = "ord", how: str = "inner") -> DataFrame:
    """Each row with the first rule that agrees with it on all pairs of any arm. Every arm is an equi-join of its own."""
    hinted, rest = small(rules), [c for c in rules.columns if c != order]
    others = [c for c in rows.columns if c not in key]
    rule = F.struct(rules[order].alias(order), *[rules[c].alias(c) for c in rest])
    arms_found = [rows.join(hinted, reduce(lambda x, y: x & y, [rows[a] == rules[b] for a, b in arm])).select(*[rows[c] for c in rows.columns], rule.alias("_rule")) for arm in arms]
    if how == "left":
        arms_found.append(rows.withColumn("_rule", F.lit(None).cast(arms_found[0].schema["_rule"].dataType)))
    best = reduce(DataFrame.unionByName, arms_found).groupBy(*key).agg(F.min("_rule").alias("_rule"), *[F.first(c).alias(c) for c in others])
    return best.select(*rows.columns, *[F.col("_rule")[c].alias(c) for c in [order, *rest]])


def anti_with_reason(rows: DataFrame, cited: DataFrame, key: list[str], reasons: list[tuple[str, Column]], otherwise: str = "uncovered", out: str = "reason") -> DataFrame:
    """Rows that nothing cites, each with the first reason that excuses it."""
    chain: Column | None = None
    for name, holds in reasons:
        chain = F.when(holds, name) if chain is None else chain.when(holds, name)
    reason = chain.otherwise(otherwise) if chain is not None else F.lit(otherwise)
    return rows.join(cited.select(*key).distinct(), key, "left_anti").withColumn(out, reason)


def superseded(rows: DataFrame, stronger: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a stronger row at the same key; rows whose key has a null stay."""
    return rows.join(stronger.select(*key).distinct(), key, "left_anti")


def dispatch(calls: DataFrame, coerced: DataFrame, trait: str = "trait", sig: str = "sig", any_sig: str = "*") -> DataFrame:
    """Calls on trait objects joined to the types coerced to the trait with an equal signature or the wildcard. Two
    equi-joins and a union, instead of one join by OR."""
    exact = calls.join(coerced, [trait, sig])
    wild = calls.join(coerced.where(F.col(sig) == any_sig).drop(sig), trait).where(F.col(sig) != any_sig)
    return exact.unionByName(wild.select(*exact.columns)).dropDuplicates()


#: Pairs up to which groups are joined as rows, values to a block beyond that, and pairs to a task.
FEW_PAIRS, BLOCK_ROWS, TASK_PAIRS = 1 << 22, 1 << 10, 1 << 25


def product(left: DataFrame, right: DataFrame, on: list[str], few: int | None = None) -> DataFrame:
    """left.join(right, on) for keys of many rows on both sides, whose pairs are far more than the rows.

    Beyond a few pairs, each side's rows of a key are put into blocks, and pairs of blocks are dealt evenly over tasks
    and unfolded there: a task holds two blocks at a time, whatever a key's share, and only blocks are exchanged. In the
    result the rows of a block stand together, so that files of it stay small.
    """
    sides = [x.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on)) for x in (left, right)]
    counts = [x.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for x, n in zip(sides, ("_l", "_r"), strict=True)]
    total = counts[0].join(counts[1], on).agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
    if total <= (FEW_PAIRS if few is None else few):
        return left.join(right, on)

    def blocks(rows: DataFrame, count: DataFrame, n: str, out: str) -> DataFrame:
        others = [c for c in rows.columns if c not in on]
        place = F.pmod(F.xxhash64(*others), F.ceil(F.col(n) / BLOCK_ROWS))
        return rows.join(count, on).groupBy(*on, place.alias(f"_{n}")).agg(F.collect_list(F.struct(*others)).alias(out)).drop(f"_{n}")

    paired = blocks(sides[0], counts[0], "_l", "_x").join(blocks(sides[1], counts[1], "_r", "_y"), on)
    dealt = paired.repartition(max(1, int(-(-total // TASK_PAIRS))))
    told = dealt.select(*on, "_y", F.explode("_x").alias("_x")).select(*on, "_x", F.explode("_y").alias("_y"))
    own = lambda rows, at: [F.col(at)[c].alias(c) for c in rows.columns if c not in on]
    return told.select(*on, *own(left, "_x"), *own(right, "_y"))


def pointer_targets(calls: DataFrame, named: DataFrame, functions: DataFrame, call: str = "call") -> DataFrame:
    """call, function and open: the functions that named(call, function) gives a pointer call; for calls with none,
    every function of the same arity and signature (wildcard `*` fits all), marked open."""
    resolved = calls.select(call).join(named, call).select(call, "function", F.lit(False).alias("open"))
    unnamed = calls.join(named.select(call).distinct(), call, "left_anti").groupBy(call).agg(F.collect_set(F.struct("arity", "sig")).alias("_s"))
    # The wildcard of a function makes its other signatures of that arity needless, so that a call with one signature
    # meets no function twice; only the others' pairs are made distinct.
    sigs = functions.groupBy("function", "arity").agg(F.collect_set("sig").alias("_s"))
    told = sigs.select("function", "arity", F.explode(F.when(F.array_contains("_s", "*"), F.array(F.lit("*"))).otherwise(F.col("_s"))).alias("sig"))

    def fitting(rows: DataFrame) -> DataFrame:
        rows = rows.select(call, F.explode("_s").alias("_s")).select(call, "_s.*")
        exact = product(rows.where("sig <> '*'"), told.where("sig <> '*'"), ["arity", "sig"]).select(call, "function")
        left = product(rows.where("sig <> '*'").select(call, "arity"), told.where("sig = '*'").select("function", "arity"), ["arity"]).select(call, "function")
        return exact.union(left).union(product(rows.where("sig = '*'").select(call, "arity"), sigs.select("function", "arity"), ["arity"]).select(call, "function"))

    every = fitting(unnamed.where("size(_s) = 1")).union(fitting(unnamed.where("size(_s) > 1")).distinct())
    return resolved.unionByName(every.withColumn("open", F.lit(True)))


def constructor_chain(starts: DataFrame, receivers: DataFrame, entries: DataFrame, most: int = 8) -> DataFrame:
    """call, entry and hops: following receivers(call, receiver), at most `most` hops, to the first with an entry."""
    found, frontier = None, starts.select("call", F.col("call").alias("at"))
    for hop in range(most + 1):
        hit = frontier.join(entries.select(F.col("call").alias("at"), "entry"), "at")
        here = hit.select("call", "entry", F.lit(hop).alias("hops"))
        found = here if found is None else found.unionByName(here)
        if hop < most:
            rest = frontier.join(entries.select(F.col("call").alias("at")), "at", "left_anti")
            frontier = rest.join(receivers.select(F.col("call").alias("at"), "receiver"), "at").select("call", F.col("receiver").alias("at"))
    return found


def only_value(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key and value where all rows of the key agree on one value."""
    return rows.groupBy(*key).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")


def next_row(rows: DataFrame, partition: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """rows with the column's value in the next row of the partition."""
    return rows.withColumn(out, F.lead(column).over(Window.partitionBy(*partition).orderBy(*order)))
