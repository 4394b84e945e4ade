"""Sinks: text lines in order, documents, and conversion of another tool's report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """Lines in order, in files whose names follow that order (range partitions, so no task holds all lines)."""
    lines.select(column).repartitionByRange(column).sortWithinPartitions(column).write.text(path)


def write_document(docs: DataFrame, path: str) -> None:
    docs.select("document").write.text(path)


def convert_report(report: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Another tool's rows as occurrence rows: columns maps our names to theirs; missing ones are null."""
    return report.select(*[F.col(theirs).alias(ours) if theirs in report.columns else F.lit(None).alias(ours) for ours, theirs in columns.items()])
