"""Verification: positions against sources, intervals, mutation tests, golden comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.merges import two_way_diff


def mutation_test(cited: DataFrame, truth: DataFrame, position: list[str], shifts: list[tuple[str, int, int]]) -> DataFrame:
    """shift, tried and rejected: every cited (line, column) position moved by each shift must not be a true position.
    Shifts are a short literal list, exploded from an array in the plan, and the check is an equi-join."""
    line, column = position
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("shift"), F.lit(a).alias("dl"), F.lit(b).alias("dc")) for n, a, b in shifts]))
    moved = cited.select(*position, listed.alias("s")).select(F.col("s.shift").alias("shift"), (F.col(line) + F.col("s.dl")).alias(line), (F.col(column) + F.col("s.dc")).alias(column))
    real = truth.select(*position).distinct().withColumn("_real", F.lit(True))
    return moved.join(real, position, "left").groupBy("shift").agg(F.count(F.lit(1)).alias("tried"), F.count_if(F.col("_real").isNull()).alias("rejected"))


def source_lines(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line (from 1) and code of every line."""
    return texts.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "code")).withColumn("line", (F.col("line") + 1).cast("long"))


def verify_positions(cited: DataFrame, lines: DataFrame) -> DataFrame:
    """cited(path, line, offset, symbol) with a verdict: ok, no such line, beyond the line, or another token. The
    token is the last part of the symbol and must stand at the 0-based offset as a whole word."""
    token = F.element_at(F.split("symbol", "::"), -1)
    there = F.substring(F.col("code"), F.col("offset").cast("int") + 1, F.length(token))
    after = F.substring(F.col("code"), F.col("offset").cast("int") + 1 + F.length(token), F.lit(1))
    before = F.when(F.col("offset") > 0, F.substring(F.col("code"), F.col("offset").cast("int"), F.lit(1))).otherwise("")
    word = lambda c: c.rlike("^[A-Za-z0-9_]$")
    verdict = F.when(F.col("code").isNull(), "no such line").when(F.col("offset") >= F.length("code"), "beyond the line").when((there != token) | word(after) | word(before), "another token").otherwise("ok")
    return cited.join(lines, ["path", "line"], "left").withColumn("verdict", verdict).drop("code")


def inside_item(positions: DataFrame, items: DataFrame) -> DataFrame:
    """positions(path, line, item) with inside: does an item of that name (path, item, first, last) hold the line? An
    equi-join on path and item with the range as its residual."""
    same = positions.select("path", "item", "line").distinct()
    held = same.join(items, ["path", "item"]).where("line BETWEEN first AND last").select("path", "item", "line").distinct().withColumn("inside", F.lit(True))
    return positions.join(held, ["path", "item", "line"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def lock_entries(lines: DataFrame) -> DataFrame:
    """path, line, name and version of each `name = ".."` line that a `version = ".."` line follows."""
    from factloom.operators.joins import next_row

    paired = next_row(lines.where(F.col("code").rlike(r'^(name|version) = "')), ["path"], ["line"], "line", "_at")
    paired = next_row(paired, ["path"], ["line"], "code", "_next").where("_at = line + 1")
    name, version = F.regexp_extract("code", r'^name = "([^"]*)"$', 1), F.regexp_extract("_next", r'^version = "([^"]*)"$', 1)
    return paired.where((name != "") & (version != "")).select("path", "line", name.alias("name"), version.alias("version"))


def golden(actual: DataFrame, expected: DataFrame, line: str = "line") -> DataFrame:
    """Lines that only one side has; empty if the summary is as expected."""
    return two_way_diff(expected.select(line), actual.select(line))


def linked_not_walked(symbols: DataFrame, walked: DataFrame, classes: list[tuple[str, Column]], name: str = "symbol") -> DataFrame:
    """class and n of linked symbols that the walk did not meet."""
    chain: Column | None = None
    for label, holds in classes:
        chain = F.when(holds, label) if chain is None else chain.when(holds, label)
    left = symbols.join(walked.select(name).distinct(), name, "left_anti")
    return left.groupBy((chain.otherwise("gap") if chain is not None else F.lit("gap")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def review_sheet(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Labels beside the source lines they are about; labels of lines that are not there keep a null code."""
    return labels.join(lines, ["path", "line"], "left")
