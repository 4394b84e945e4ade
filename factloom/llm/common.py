"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from factloom.session import checkpoint_dir, cut

__all__ = ["bit_filter", "checkpoint_dir", "crc_mod", "cut", "filter_texts", "in_filter", "kept", "map_texts", "pick", "table", "utf8"]

#: Words of 64 bits that a key filter has at most: 8 MB of bits.
FILTER_WORDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under own names, so that no other column of df can clash."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32(id as text) mod n."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def crc_of(value) -> int:
    return zlib.crc32(str(value).encode())


_KEPT: dict[str, dict] = {}


def kept(module: str) -> dict:
    """What a Python worker keeps for the tasks of a module. It goes when a task of another module runs in the worker, so
    that no stage has the memory of those before it."""
    return _KEPT.setdefault(module, {})


def keep_only(module: str) -> None:
    """Drops what is kept for other modules than this."""
    for name in [m for m in _KEPT if m != module]:
        del _KEPT[name]


def filter_texts(df: DataFrame, decide: Callable[[], Callable[[list[str | None]], list[bool]]], text_col: str = "text", block: int = 512) -> DataFrame:
    """The rows of df whose text is decided to stay, as they are, with no shuffle. decide() is called once a task and
    gives the function that decides on a block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(decide.__module__)
        keep = decide()
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                yield some.filter(pa.array(keep(some.column(text_col).to_pylist()), pa.bool_()))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)


def map_texts(df: DataFrame, keep: list[str], fields: str, make: Callable[[], Callable[[list[str | None]], dict]], text_col: str = "text", block: int = 512) -> DataFrame:
    """The columns `keep` of df as they are, whatever their types, and the columns `fields` (DDL) that a function of a
    block of texts gives by name. make() is called once a task and gives the function; nothing is shuffled."""
    added = StructType.fromDDL(fields)
    schema = StructType([df.schema[c] for c in keep] + added.fields)
    types = [(f.name, to_arrow_type(f.dataType)) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(make.__module__)
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                got = work(some.column(text_col).to_pylist())
                columns = [some.column(c) for c in keep] + [pa.array(got[n], t) for n, t in types]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(n for n, _ in types)])
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _word(key: Column) -> Column:
    return F.shiftrightunsigned(key, 6).bitwiseAND(FILTER_WORDS - 1)


def _bit_of(key: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(`{key}` & 63 AS int))")


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """A Bloom filter of 64-bit hashes as rows of (filter_word, filter_bits): FILTER_WORDS rows at most, whatever the
    number of keys. A filter that fills up passes more keys, but never loses one."""
    return keys.select(_word(F.col(key)).alias("filter_word"), _bit_of(key).alias("bit")).groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits"))


def in_filter(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """df with a column in_filter: false only where the key is certainly not among the filter's keys."""
    with_word = df.withColumn("filter_word", _word(F.col(key)))
    joined = with_word.join(F.broadcast(bits), "filter_word", "left")  # at most FILTER_WORDS rows
    here = F.coalesce("filter_bits", F.lit(0).cast("long")).bitwiseAND(_bit_of(key)) != 0
    return joined.withColumn("in_filter", here).drop("filter_word", "filter_bits")
