"""Grouped merges: evidence rows into groups by semilattices, quantifiers, conditional sets, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_set(column: Column | str, separator: str | None = ",") -> Column:
    """The distinct values in order; as one text if a separator is given. Sets are part of outputs, so their order is
    fixed."""
    values = F.array_sort(F.collect_set(column))
    return values if separator is None else F.array_join(values, separator)


def merge_evidence(rows: DataFrame, key: list[str], greatest: list[str] = (), least: list[str] = (), sets: list[str] = (), every: list[str] = (), first: list[str] = (), order: str | None = None) -> DataFrame:
    """One row a key: greatest and least are lattice joins, sets are unions, every holds if it holds in all rows, first
    is the value of the first row by order. All of these combine map-side before the shuffle."""
    out = [F.count(F.lit(1)).alias("n_rows")]
    out += [F.max(c).alias(c) for c in greatest] + [F.min(c).alias(c) for c in least]
    out += [sorted_set(c).alias(c) for c in sets] + [F.bool_and(c).alias(c) for c in every]
    out += [F.min_by(c, order).alias(c) for c in first]
    return rows.groupBy(*key).agg(*out)


def prefer(value: Column, preferred: Column, separator: str = ",") -> Column:
    """The set of values of preferred rows if there is one, else of all rows."""
    good = F.array_sort(F.collect_set(F.when(preferred, value)))
    return F.array_join(F.when(F.size(good) > 0, good).otherwise(F.array_sort(F.collect_set(value))), separator)


def split_uses(uses: Column) -> Column:
    """Texts that join several uses by ` or ` taken apart."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(uses, lambda u: F.split(u, " or ")))))


def where_every(rows: DataFrame, key: list[str], holds: Column) -> DataFrame:
    """key and n, the number of rows, of the keys all of whose rows meet the condition."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(holds).alias("_every")).where("_every").drop("_every")


def first_of_priority(value: Column, *conditions: Column) -> Column:
    """The greatest value of the rows that meet the first condition that any row meets."""
    return F.coalesce(*[F.max(F.when(c, value)) for c in conditions])


def first_filled(*arrays: Column) -> Column:
    """The first array that has elements; an empty one if none has."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], F.array().cast("array<string>"))


def numbered_refs(rows: DataFrame, ref: str, order: list[str], out: str = "ref_n") -> DataFrame:
    """rows with unique references: the first of equal ones stays, later ones get `:n` from 2 on."""
    n = F.row_number().over(Window.partitionBy(ref).orderBy(*order))
    return rows.withColumn(out, F.when(n == 1, F.col(ref)).otherwise(F.concat(F.col(ref), F.lit(":"), n.cast("string"))))


def merge_less_specific(assets: DataFrame, places: list[str], name: str = "name", same: list[str] = ()) -> DataFrame:
    """rows and merged_into: a row whose name is a prefix, at a part's end, of a more specific name at the same places
    merges into the longest such name (the least of equals); the others keep their own name. The join is an equality
    on the places and on the exploded prefixes of names."""
    cols = [*places, *same]
    parts = F.split(F.col(name), "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    longer = assets.where(F.size(parts) > 1).select(*cols, F.col(name).alias("_long"), F.explode(prefixes).alias(name))
    best = longer.groupBy(*cols, name).agg(F.min(F.struct((-F.length("_long")).alias("n"), F.col("_long").alias("to"))).alias("_best"))
    return assets.join(best, [*cols, name], "left").withColumn("merged_into", F.coalesce(F.col("_best.to"), F.col(name))).drop("_best")


def capped_set(value: Column, most: int, marker: str) -> Column:
    """At most so many distinct values in order, then a marker that stands for the rest."""
    values = F.array_sort(F.collect_set(value))
    return F.when(F.size(values) > most, F.concat(F.slice(values, 1, most), F.array(F.lit(marker)))).otherwise(values)


def capped_rows(rows: DataFrame, key: list[str], value: str, most: int, marker: str) -> DataFrame:
    """key and value, an array: at most so many distinct values of each key in order, then the marker. Values past the
    cap are cut before and after the shuffle, so no task gathers a hot key's values."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(value))
    told = rows.select(*key, value).where(F.col(value).isNotNull()).distinct().withColumn("_n", n).where(F.col("_n") <= most + 1)
    capped = F.when(F.col("_n") > most, marker).otherwise(F.col(value))
    return told.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", capped.alias("v")))), lambda x: x["v"]).alias(value))


def precision_recall(rows: DataFrame, truth: Column, found: Column, by: list[str] = ()) -> DataFrame:
    """Counts and ratios to three decimals; a ratio over nothing is null."""
    both, either = F.count_if(truth & found), lambda c: F.count_if(c)
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    ratio = lambda n, d: F.round(n / F.nullif(d, F.lit(0)), 3)
    return grouped.agg(both.alias("hits"), either(truth).alias("labelled"), either(found).alias("reported"), ratio(both, either(found)).alias("precision"), ratio(both, either(truth)).alias("recall"))


def rollup_counts(rows: DataFrame, verdict: str, dimensions: list[str]) -> DataFrame:
    """Counts of each verdict by every dimension alone and over all, in one pass of grouping sets."""
    view = rows.select(verdict, *dimensions)
    sets = [[verdict, d] for d in dimensions] + [[verdict]]
    return view.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [verdict, *dimensions]]).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).cast("int").alias(f"all_{d}") for d in dimensions])


def two_way_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows that are new (`+`) or gone (`-`)."""
    return new.subtract(old).withColumn("sign", F.lit("+")).unionByName(old.subtract(new).withColumn("sign", F.lit("-")))


def set_verdict(must: Column, may: Column, reported: Column) -> Column:
    """correct, wrong, honest-unknown, miss of a reported set against what must and what may be in it."""
    known = F.array_remove(reported, "unknown")
    outside = F.array_except(known, F.array_union(must, may))
    return (
        F.when((F.size(reported) == 0) & (F.size(must) > 0), "miss")
        .when(F.size(outside) > 0, "wrong")
        .when(F.array_contains(reported, "unknown"), "honest-unknown")
        .when((F.size(must) > 0) & (F.size(known) > 0) & ~F.arrays_overlap(known, must), "wrong")
        .when(F.size(F.array_except(must, known)) > 0, "miss")
        .otherwise("correct")
    )


def interval_cover(ranges: DataFrame, key: list[str], lo: str = "lo", hi: str = "hi", n: str = "n") -> DataFrame:
    """key and covered: whether a key's ranges [lo, hi) cover [0, n) without a gap (a null hi goes to the end), by a
    running maximum over ranges in order."""
    ends = ranges.withColumn("_hi", F.coalesce(F.col(hi), F.col(n)))
    before = F.max("_hi").over(Window.partitionBy(*key).orderBy(lo, "_hi").rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("_gap", F.col(lo) > F.coalesce(before, F.lit(0))).groupBy(*key).agg((~F.bool_or("_gap") & (F.max("_hi") >= F.max(n))).alias("covered"))


def islands(ranges: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    """key, lo, hi and n_ranges of each maximal run of overlapping or touching ranges."""
    w = Window.partitionBy(*key).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.withColumn("_new", (before.isNull() | (F.col(lo) > before)).cast("int"))
    return starts.withColumn("_run", F.sum("_new").over(w)).groupBy(*key, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n_ranges")).drop("_run")


def numbered(rows: DataFrame, order: list[str], out: str = "ord") -> DataFrame:
    """rows with their place, from 0, in an order of the whole: rows are sorted in ranges, and each range adds the number
    of rows that earlier ranges hold, so no task sees all rows."""
    from factloom.session import cut

    ranged = cut(rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row a partition
    starts, total = [], 0
    for r in counts:
        starts.append((r["_part"], total))
        total += r["n"]
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(out, F.col("_start") + inside).drop("_at", "_part", "_start")
