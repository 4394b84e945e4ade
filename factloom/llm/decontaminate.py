"""Benchmark decontamination: n-gram seeds join training passages to test items, then Smith-Waterman scores them.

Seeds are all runs of SEED_WORDS words of the test items, with letters of every alphabet lower-cased. One pass finds
them in the texts, and each hit's passage of the document is aligned with the item by Smith-Waterman over words. The
similarity is the best local score over the score of the whole item, so edited and paraphrased copies score in between.
No seed is left out, however common or rare: a copy is aligned if one run of SEED_WORDS words of it is as in the item.
Passages of any number of documents are all aligned; nothing is capped.

The pass is map-side, without a shuffle. The items are the broadcast side: they go in blocks of at most BLOCK_WORDS
words, a pass over the texts each, so their size is bounded whatever the benchmark.

Cases: null or empty texts and items have no words and match nothing; an item of fewer words than a seed has one seed,
all its words; very long texts are searched whole; repeated rows are separate rows; equal items match each, and so do items without an id; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm import licenses
from factloom.llm.common import filter_texts, pick

SEED_WORDS = 4
BLOCK_WORDS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words as the licence scan has them, with all letters lower-cased and not only A-Z."""
    return licenses.words_of(None if text is None else text.lower())


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n ids."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = (out ^ ids[k : k + m].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(31)
    return out


class Items:
    """Test items as word numbers, and the seeds of each by length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int64) for _, t in items]
        item, at, code, size = [], [], [], []
        for k, w in enumerate(self.words):
            n = min(SEED_WORDS, len(w))
            if n:
                g = grams(w, n)
                item.append(np.full(len(g), k))
                at.append(np.arange(len(g)))
                code.append(g)
                size.append(np.full(len(g), n))
        self.item, self.at, self.code, self.size = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (item, at, code, size))
        order = np.argsort(self.code, kind="stable")
        self.item, self.at, self.code, self.size = (x[order] for x in (self.item, self.at, self.code, self.size))
        self.seeds = np.unique(self.code)
        self.lengths = sorted(set(self.size.tolist()))

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the text where a seed starts, the seed's code)."""
        where, codes = [], []
        for n in self.lengths:
            g = grams(ids, n)
            if len(g) and len(self.seeds):
                at = np.minimum(np.searchsorted(self.seeds, g), len(self.seeds) - 1)
                found = np.flatnonzero(self.seeds[at] == g)
                where.append(found)
                codes.append(g[found])
        return (np.concatenate(where), np.concatenate(codes)) if where else (np.empty(0, np.int64), np.empty(0, np.uint64))


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(best local score, where its alignment starts in the passage, where it ends) with linear gaps."""
    n = len(passage)
    steps = -GAP * np.arange(n + 1)
    best, first, last = 0, 0, 0
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for w in item:
        diagonal = row[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = row[1:] + GAP
        score = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        start = np.concatenate([[0], np.where(diagonal >= up, origin[:-1], origin[1:])])
        start = np.where(score > 0, start, np.arange(n + 1))
        # Gaps along the passage: a running maximum of the score with the gaps' cost taken out.
        lifted = score + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row = top - steps
        origin = start[source]
        k = int(row.argmax())
        if row[k] > best:
            best, first, last = int(row[k]), int(origin[k]), k
    return best, first, last


def align(items: Items, ids: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(item's place, similarity, first word, end) of the best passage for each item that shares a seed with a text."""
    where, codes = items.hits(ids)
    if not len(where):
        return []
    lo, hi = np.searchsorted(items.code, codes, "left"), np.searchsorted(items.code, codes, "right")
    entry = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
    start = np.repeat(where, hi - lo) - items.at[entry]  # where the item would start
    item = items.item[entry]
    out = []
    for k in np.unique(item):
        word = items.words[k]
        slack = len(word) // 2 + 2
        begins = np.sort(start[item == k])
        best = (0.0, 0, 0)
        a = 0
        while a < len(begins):  # hits that lie within an item's length are one passage
            b = int(np.searchsorted(begins, begins[a] + len(word), "right"))
            left, right = max(0, int(begins[a]) - slack), min(len(ids), int(begins[b - 1]) + len(word) + slack)
            score, first, last = smith_waterman(word, ids[left:right])
            value = score / (MATCH * len(word))
            if value > best[0]:
                best = (value, left + first, left + last)
            a = b
        out.append((int(k), *best))
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items with at most BLOCK_WORDS words, unless one item alone has more."""
    block, words = [], 0
    for r in benchmark.where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(r["text"]))
        if block and words + n > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((r["item_id"], r["text"]))
        words += n
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word and end_word for each document and item whose alignment reaches the
    threshold."""
    texts = pick(docs, doc_id=id_col, text=text_col)
    id_type, item_type = texts.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, similarity double, first_word long, end_word long"
    spark, out = docs.sparkSession, None
    for block in item_blocks(pick(benchmark, item_id="item_id", text="text")):
        shared = spark.sparkContext.broadcast(Items(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, kind = shared.value, to_arrow_type(item_type)
            for batch in batches:
                rows = [(r, items.ids[k], s, a, b) for r, t in enumerate(batch.column("text").to_pylist()) for k, s, a, b in align(items, items.numbers(t)) if s >= threshold]
                row, item, similarity, first, end = zip(*rows, strict=True) if rows else ((),) * 5
                found = [pa.array(item, kind), pa.array(similarity, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *found], names=["doc_id", "item_id", "similarity", "first_word", "end_word"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, as they are, that hold no test item to that similarity."""
    out, sc = docs, docs.sparkSession.sparkContext
    for block in item_blocks(pick(benchmark, item_id="item_id", text="text")):
        shared = sc.broadcast(Items(block))

        def decide(shared=shared):
            items = shared.value
            return lambda texts: [all(s < threshold for _, s, _, _ in align(items, items.numbers(t))) for t in texts]

        out = filter_texts(out, decide)
    return out
