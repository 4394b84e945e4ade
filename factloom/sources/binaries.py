"""Symbols of linked programs: the symbol tables of 64-bit little-endian ELF files, read without any tool."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Kinds of sections that hold symbols, and of symbols that are functions.
SYMBOL_SECTIONS, FUNCTION = (2, 11), 2


def elf_functions(data: bytes) -> list[tuple[str, int]]:
    """(name, size) of the functions that a program defines; none of what is no such file, or is cut short."""
    if data[:6] != b"\x7fELF\x02\x01" or len(data) < 64:
        return []
    at, width, count = struct.unpack_from("<Q", data, 40)[0], *struct.unpack_from("<HH", data, 58)
    if width < 64 or at + width * count > len(data):
        return []
    sections = [struct.unpack_from("<IIQQQQIIQQ", data, at + width * k) for k in range(count)]
    found = {}
    for _, kind, _, _, start, size, link, _, _, entry in sections:
        if kind not in SYMBOL_SECTIONS or entry < 24 or link >= count or start + size > len(data):
            continue
        names_at = sections[link][4]
        for place in range(start, start + size - entry + 1, entry):
            name, info, _, section, _, length = struct.unpack_from("<IBBHQQ", data, place)
            if info & 15 == FUNCTION and section:
                end = data.find(b"\0", names_at + name)
                found[data[names_at + name : end if end >= 0 else None].decode("utf-8", "replace")] = length
    return sorted(found.items())


def linked_symbols(spark: SparkSession, path: str) -> DataFrame:
    """path, symbol and size of the functions in the programs of a folder; a task reads a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, name, size) for p, data in zip(batch["path"], batch["content"], strict=True) for name, size in elf_functions(bytes(data))]
            yield pd.DataFrame(rows, columns=["path", "symbol", "size"]).astype({"size": "int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, symbol string, size long")
