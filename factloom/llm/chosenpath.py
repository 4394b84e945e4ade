"""N-gram Jaccard join by chosen paths.

Sets are the five-word shingles of lower-cased texts. A set's token at position p of its sketch is the shingle that
comes first in the p-th of 128 hashed orders, so two sets share it with probability equal to their similarity. A run
starts with one bucket of all sets; each bucket is split by CHOICES sampled positions (chosen by the bucket's path),
a set going to one child a position, until buckets have at most BUCKET sets; those are compared by brute force on
sketches. As many runs as bring the bound on recall for pairs at the threshold to RECALL go on at once. A large bucket
that a split leaves with CLUMP of its sets together holds near copies of one text, which no split will part; it is joined
as a whole, as is one still large after MAX_DEPTH splits. So near copies do not multiply by paths. All this only proposes
groups: every pair of texts inside a proposed group is then verified exactly on its shingle sets, in blocks, so no link is
lost for the size of a bucket or group, and link counts are exact.

Equal sets are one node, so copies are never paired, and large groups are verified in blocks of at most BLOCK sets and
BLOCK_TOKENS shingles a side; only counts and spanning links leave a block. A group of n different near copies costs n x n
comparisons and sends each of its texts to n / BLOCK blocks, as its links are counted one by one.

Exchanges carry ids and paths; sketches once, and again of sets that share a bucket; and texts of proposed groups. Which
texts these are is told by a Bloom filter of a fixed size (common.bit_filter), so that the others do not move. Where it
is full, more texts move; none is lost.

Cases: null and empty texts have the empty set; all of these are copies of each other. A text of fewer than five words
has one shingle, all its words. Very long texts are shingled whole. Repeated rows are copies. Ids may have any type; a null
id comes after all others. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bit_filter, cut, in_filter, map_texts, pick
from factloom.operators.graph import connected_components

WORDS = 5
THRESHOLD = 0.8
SKETCH = 128
CHOICES = 3
BUCKET = 256
MAX_DEPTH = 8
CLUMP = 0.6
RECALL = 0.9999
#: Sketches agree in at least this share for a pair to be proposed; at similarity 0.8 fewer than one pair in 50,000 agrees in less.
PROPOSE = 0.65
BLOCK = 1024
BLOCK_TOKENS = 1 << 20
WORD_MEMO = 1 << 18
#: Bytes of a sketch over those of a row of a node and a path.
ROWS_WIDE = 16

_rng = np.random.default_rng(20240607)
MULTIPLY = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS, memo: dict[str, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of so many words. The memo of words is the task's own, so that a worker
    keeps nothing of it for what it does next."""
    memo = {} if memo is None else memo
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(memo) > WORD_MEMO:
        memo.clear()
    ids = []
    for w in found:
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids.append(h)
    h = np.array(ids, np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x SKETCH 16-bit minima of hashed orders; zeros for empty sets."""
    out = np.zeros((len(sets), SKETCH), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = np.concatenate([sets[k] for k in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
    for p in range(SKETCH):
        v = x * MULTIPLY[p] + ADD[p]
        low = np.minimum.reduceat(v >> np.uint64(24), starts)
        out[full, p] = (low * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.uint16)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set key (two numbers and its size) and sketch of rows of doc_id, text and text_hash."""

    def make():
        memo: dict[str, int] = {}

        def work(texts: list[str | None]) -> dict:
            sets = [shingles(t, memo=memo) for t in texts]
            keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            return {"hi": np.array([k >> 64 for k in keys], np.uint64).view(np.int64), "lo": np.array([k & (1 << 64) - 1 for k in keys], np.uint64).view(np.int64), "n": [len(s) for s in sets], "sketch": [s.tobytes() for s in sketches(sets)]}

        return work

    return map_texts(docs, ["doc_id", "text_hash"], "hi long, lo long, n long, sketch binary", make, block=64)


def survival(similarity: float, depth: int) -> float:
    """Least probability that a pair of that similarity meets in a bucket after so many splits."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** CHOICES
    return p


def runs_needed(threshold: float) -> int:
    """Runs after which a pair at the threshold was missed with probability 1 - RECALL at most."""
    missed = 1 - survival(threshold, MAX_DEPTH)
    return 1 if missed <= 0 else max(1, math.ceil(math.log(1 - RECALL) / math.log(missed)))


def chosen_paths(nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of small buckets: path and node; links inside buckets that stay large; the nodes that share any bucket) of
    rows of node and sketch."""
    runs = F.explode(F.array(*[F.lit(k).cast("long") for k in range(runs_needed(threshold))]))
    level = nodes.select("node", "sketch", runs.alias("path"), F.lit(None).cast("long").alias("from"))
    small = large = live = None
    # Rows of a level's children; a split below the first reads all of live, of wide rows.
    count = nodes.count()
    most = count * runs_needed(threshold) * CHOICES
    for depth in range(1, MAX_DEPTH + 1):
        split = level.withColumn("choice", F.explode(F.sequence(F.lit(1), F.lit(CHOICES))))
        place = F.pmod(F.xxhash64("path", "choice"), F.lit(SKETCH)).cast("int")
        split = cut(split.select("node", F.xxhash64("path", "choice", F.substring("sketch", place * 2 + 1, F.lit(2))).alias("path"), "from"), max(most, count * ROWS_WIDE))
        sizes = split.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"), F.max("from").alias("from")).where("size > 1")
        sized = cut(split.drop("from").join(sizes, "path"), most)
        if live is None:
            live = cut(nodes.join(sized.select("node").distinct(), "node", "left_semi"))
        leaves = sized.where(F.col("size") <= BUCKET).select("path", "node")
        small = leaves if small is None else small.unionByName(leaves)
        big = sized.where(F.col("size") > BUCKET)
        clump = F.lit(True) if depth == MAX_DEPTH else F.coalesce(F.col("size") >= CLUMP * F.col("from"), F.lit(False))
        stuck = big.where(clump).select(F.col("node").alias("a"), F.col("least").alias("b"))
        large = stuck if large is None else large.unionByName(stuck)
        rest = big.where(~clump)
        most = rest.count() * CHOICES
        if not most:
            break
        level = rest.select("node", "path", F.col("size").alias("from")).join(live, "node")
    return small, large.distinct(), live


def spanning(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of count items' component under links a-b."""
    label = np.arange(count)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def runs_of(batches: Iterator[pd.DataFrame], key: str, most: int = 4096) -> Iterator[pd.DataFrame]:
    """Whole groups of rows sorted by key, some groups at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= most:
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            k = rows[key].to_numpy()
            last = int(np.searchsorted(k == k[-1], True))
            if last:
                yield rows[:last]
            held = [rows[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def propose(small: DataFrame, nodes: DataFrame) -> DataFrame:
    """Spanning links a-b of the pairs in small buckets whose sketches agree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs_of(batches, "path"):
            path, node = rows["path"].to_numpy(), rows["node"].to_numpy()
            sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(len(rows), SKETCH)
            first = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
            end = np.repeat(first[1:], np.diff(first))
            ahead = end - np.arange(len(path)) - 1
            good_a, good_b = [], []
            at = 0
            total = np.cumsum(ahead)
            while at < len(path):  # about 64k pairs at a time
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 65536)))
                n = ahead[at:to]
                a = np.repeat(np.arange(at, to), n)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                alike = (sketch[a] == sketch[b]).sum(axis=1) >= PROPOSE * SKETCH
                good_a.append(a[alike])
                good_b.append(b[alike])
                at = to
            a, b = np.concatenate(good_a), np.concatenate(good_b)
            label = spanning(len(path), a, b)
            moved = np.flatnonzero(label != np.arange(len(path)))
            yield pd.DataFrame({"a": node[moved], "b": node[label[moved]]})

    rows = small.join(nodes, "node").repartition("path").sortWithinPartitions("path")
    return rows.select("path", "node", "sketch").mapInPandas(run, "a long, b long")


def verify(groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b and links: spanning links (b not null) and counts of linked documents (b null) of rows of block, side,
    node, copies and text. Pairs are those of side 0 with side 1, or all pairs where a block has side 0 only."""

    def compare(rows: pd.DataFrame, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        sets = [shingles(t, memo=memo) for t in rows["text"]]
        side = rows["side"].to_numpy()
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(sizes, kind="stable")
        tokens = np.concatenate([sets[k] for k in order])
        ids = np.unique(tokens, return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(sizes[order])])
        mark = np.zeros(len(ids) and int(ids.max()) + 1, bool)
        ordered, two = sizes[order], bool(side.max())
        found_a, found_b = [], []
        for i in range(len(order)):
            # Later ones in order of size, as long as the sizes alone allow the threshold.
            last = int(np.searchsorted(ordered, ordered[i] / threshold + 1e-9, "right"))
            if last <= i + 1 or ordered[i] == 0:
                continue
            mine = ids[starts[i] : starts[i + 1]]
            mark[mine] = True
            common = np.add.reduceat(mark[ids[starts[i + 1] : starts[last]]].astype(np.int64), starts[i + 1 : last] - starts[i + 1])
            mark[mine] = False
            hit = common >= threshold * (ordered[i] + ordered[i + 1 : last] - common) - 1e-9
            if two:
                hit &= side[order[i + 1 : last]] != side[order[i]]
            j = np.flatnonzero(hit) + i + 1
            found_a.append(np.full(len(j), order[i]))
            found_b.append(order[j])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for rows in runs_of(batches, "block", 1024):
            out = []
            for _, block in rows.groupby("block", sort=False):
                node, copies = block["node"].to_numpy(), block["copies"].to_numpy()
                a, b = compare(block, memo)
                links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
                label = spanning(len(node), a, b)
                some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(node)))
                out.append(pd.DataFrame({"a": node[some], "b": pd.array([None] * len(some), "Int64"), "links": links[some].astype(np.int64)}))
                out.append(pd.DataFrame({"a": node[moved], "b": pd.array(node[label[moved]], "Int64"), "links": np.zeros(len(moved), np.int64)}))
            yield pd.concat(out, ignore_index=True)

    return groups.repartition("block").sortWithinPartitions("block").select("block", "side", "node", "copies", "text").mapInPandas(run, "a long, b long, links long")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, text_hash and key, a hash of the two that tell texts apart."""
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return texts.withColumn("key", F.xxhash64("doc_id", "text_hash"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, class_id (the least doc_id that links and copies reach), n_links (other documents linked
    directly, copies included), kept (one row of each class) and class_rows (rows of the class) of every row."""
    texts = keyed_texts(docs, id_col, text_col)
    rows = cut(describe(texts).withColumn("row_id", F.monotonically_increasing_id()))
    set_key = ["hi", "lo", "n"]
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row_id")
    classes = cut(rows.groupBy(*set_key).agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min(first).alias("first"), F.first("sketch").alias("sketch")))
    small, large, live = chosen_paths(classes.where("n > 0").select("node", "sketch"), threshold)
    groups = connected_components(propose(small, live).unionByName(large), most=small.count() + large.count())

    n_classes = classes.count()
    sized = groups.join(classes.select("node", "n", "copies", "first"), "node")
    sizes = sized.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("parts"))
    placed = sized.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    own = [F.col("first.doc_id").alias("p_id"), F.col("first.text_hash").alias("p_hash"), F.xxhash64("first.doc_id", "first.text_hash").alias("key")]
    placed = cut(placed.select("component", "node", "copies", "parts", "part", *own), n_classes)
    # One text of each set, so that no other text moves but what the filter lets pass; then a part meets every part,
    # itself included, in one block each.
    wanted = in_filter(texts, "key", cut(bit_filter(placed, "key"), n_classes)).where("in_filter").drop("in_filter")
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash"))
    whole = wanted.join(placed, "key").where(same).dropDuplicates(["key", "node"])
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other"))
    checked = cut(verify(whole.select(block.alias("block"), (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "copies", "text"), threshold))

    links = checked.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    spans = checked.where("b IS NOT NULL").select("a", "b")
    joined = connected_components(spans, most=spans.count())
    labelled = classes.drop("sketch").join(joined, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = cut(labelled.select(*set_key, "component", "first", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), n_classes)
    heads = labelled.groupBy("component").agg(F.min("first").alias("head"), F.sum("copies").alias("class_rows"))
    full = labelled.join(heads, "component").select(*set_key, "n_links", "head", "class_rows")
    out = rows.select("doc_id", "text_hash", "row_id", *set_key).join(full, set_key)
    return out.select("doc_id", "text_hash", F.col("head.doc_id").alias("class_id"), "n_links", (F.col("row_id") == F.col("head.row_id")).alias("kept"), "class_rows")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs, as it is, for each class of linked texts: one of the least doc_id. Rows that a Bloom filter
    knows to be alone in their class stay where they are; only the others are shuffled to be told apart."""
    found = cut(jaccard_join(docs, threshold).withColumn("key", F.xxhash64("doc_id", "text_hash")).select("key", "doc_id", "text_hash", "kept", "class_rows"))
    bits = cut(bit_filter(found.where("class_rows > 1"), "key"))
    kept = in_filter(found.where("kept"), "key", bits).where("in_filter").select("key", F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    # Packed, so that no column of docs can clash with ours.
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), text_hash.alias("own_hash"), F.xxhash64("doc_id", text_hash).alias("key"))
    packed = in_filter(packed, "key", bits)
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash"))
    told = packed.where("in_filter").join(kept, "key").where(same).dropDuplicates(["key", "kept_id", "kept_hash"])
    both = packed.where("NOT in_filter").select("row").unionByName(told.select("row"))
    return both.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
