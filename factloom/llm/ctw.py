"""Language-model scoring by context-tree weighting over bytes.

A text is a row of symbols, its lower-cased bytes and an end, which is a symbol of its own. Each symbol is decomposed into
binary decisions: whether the text ends, then the eight bits of a byte (256 decisions in all). For every decision and every
context of 0 to DEPTH symbols before it, a Krichevsky-Trofimov estimate is kept, and context-tree weighting mixes the
estimates of all depths: Pw = (Pe + product of the children's Pw) / 2. Given the training counts, the mixture's prediction
along a context path is a0 KT0 + (1 - a0)(a1 KT1 + (1 - a1)(...)) with a = Pe / (2 Pw). The tree is kept whole, so the model
grows with the input.

A code is the DEPTH nearest symbols and the one they stand before, 9 bits each, the nearest highest; so the codes of a
context are those that begin with it. The texts are read once and packed into bundles of about BUNDLE_BYTES: their
compressed texts, and their distinct codes with training counts, dealt out by a hash of the four nearest symbols. Then

1. each part merges its codes and sums its trees up to depth 4 (a context of depth 4 has at most 257^3 codes);
2. parts by the two nearest symbols sum these up to depth 2, and the driver the rest: at most 257^2 contexts x 256 decisions;
3. the mixture goes back down the same way, and each part answers every bundle with its codes' log10 probabilities;
4. bundles score their texts by a look-up for each position.

So all exchanges carry distinct codes of bundles and compressed texts, and nothing that grows is broadcast or collected.
Codes that only held-out texts have count nothing, and so change no estimate. Tokens of the base score (an add-one unigram
model of words) go the same way, dealt out by their own hash.

Probabilities travel as 16-bit numbers in steps of 10^-4 (log10), so the score of a text is exact to that a position.

Cases: a null or empty text is its end alone. Very long texts are scored whole. Repeated rows are scored each. A null id is
trained on. With no training rows every decision has probability one half, and N and V are 0. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import crc_mod, cut, pick, utf8

DEPTH = 6
SYMBOL = 9
#: Bytes of text in a bundle, in one blob of texts, and in what is worked on at once.
BUNDLE_BYTES, BLOB_BYTES, WORK_BYTES = 12 << 20, 4 << 20, 1 << 19
#: Bytes of text for each part that codes are dealt to, and the least number of parts.
PART_BYTES, LEAST_PARTS = 32 << 20, 64
UPPER_PARTS = 32
#: Steps of 1 / SCALE in which log10 probabilities travel.
SCALE = 10_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The end of a text as a token: no other holds white space.
END = b"\n"
PACK = zstandard.ZstdCompressor(level=3)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x > 0 (Stirling's series after a shift by 8)."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of each position of texts and of their ends, where each text's codes start)."""
    raw = np.frombuffer(b"".join(b"\0" * DEPTH + t + b"\0" for t in texts), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(t) + DEPTH + 1 for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw[(starts[:, None] + np.arange(DEPTH)).ravel()] = 0
    raw[ends - 1] = 0
    n = len(raw) - DEPTH
    code = raw[DEPTH:].copy()
    for k in range(DEPTH):  # the nearest symbol is the highest
        code |= raw[k : k + n] << np.uint64(SYMBOL * (k + 1))
    keep = np.ones(len(raw), bool)
    keep[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return code[keep[DEPTH:]], starts - DEPTH * np.arange(len(texts))


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """Parts by the four nearest symbols."""
    near = (codes >> np.uint64(SYMBOL * (DEPTH - 3))) * MIX
    return ((near ^ near >> np.uint64(32)) * MIX >> np.uint64(40)).astype(np.int64) % parts


def ranked(runs: Iterable[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct codes of all runs in order, and the place among them of each code of each run. Runs are sorted one by
    one, as a run fits into a processor's cache and all of them do not."""
    own, places = [], []
    for codes in runs:
        order = np.argsort(codes)
        codes = codes[order]
        first = np.ones(len(codes), bool)
        np.not_equal(codes[1:], codes[:-1], out=first[1:])
        place = np.empty(len(codes), np.int32)
        place[order] = np.cumsum(first, dtype=np.int32) - 1
        own.append(codes[first])
        places.append(place)
    every = counted(np.concatenate([np.empty(0, np.uint64), *own]))[0]
    return every, [np.searchsorted(every, o).astype(np.int32)[p] for o, p in zip(own, places, strict=True)]


class Numbers(dict):
    """Numbers of tokens, in the order in which they are met."""

    def __missing__(self, token: bytes) -> int:
        k = self[token] = len(self)
        return k


def pack_codes(codes: np.ndarray) -> bytes:
    """Sorted codes: their differences, byte by byte, compressed."""
    steps = np.diff(codes, prepend=np.uint64(0))
    return PACK.compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_codes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack(array: np.ndarray) -> bytes:
    """Numbers, byte by byte, compressed."""
    return PACK.compress(np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and how often each occurs; sorts in place."""
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.diff(first, append=len(codes))


def decisions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each code's decisions, node of each decision, its bit), the decisions of all codes in a row."""
    symbol = (codes & np.uint64((1 << SYMBOL) - 1)).astype(np.int64)
    byte = symbol - 1
    nodes, bits = np.zeros((len(codes), 9), np.int64), np.zeros((len(codes), 9), bool)
    bits[:, 0] = symbol == 0
    for level in range(8):
        nodes[:, level + 1] = (1 << level) | byte >> (8 - level)
        bits[:, level + 1] = byte >> (7 - level) & 1
    live = np.ones((len(codes), 9), bool)
    live[:, 1:] = symbol[:, None] > 0
    return live.sum(axis=1), nodes[live], bits[live]


class Level:
    """The nodes of one depth: sorted keys (context and decision), counts, log Pw, share and estimate of each."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = log_kt(zeros, ones)
        if children is None:  # the deepest
            self.log_pw, self.share = own, np.ones(len(keys))
        else:
            self.log_pw = np.logaddexp(own, children) - math.log(2)
            self.share = np.exp(own - math.log(2) - self.log_pw)
        self.estimate = (ones + 0.5) / (zeros + ones + 1)

    def up(self, symbols: int = 1) -> tuple[Level, np.ndarray]:
        """(the parents' level, the place of each node's parent)."""
        keys, where = np.unique((self.keys >> (8 + SYMBOL)) << 8 | self.keys & 255, return_inverse=True)
        add = lambda x: np.bincount(where, x, len(keys))
        return Level(keys, add(self.zeros), add(self.ones), add(self.log_pw)), where


def merged(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys of several blobs and the sums of their values."""
    every, where = np.unique(np.concatenate([np.empty(0, keys[0].dtype if keys else np.int64), *keys]), return_inverse=True)
    return every, *(np.bincount(where, np.concatenate([np.empty(0), *v]), len(every)) for v in values)


def deep_levels(codes: np.ndarray, counts: np.ndarray) -> tuple[list[Level], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(levels of depth DEPTH to 4, each node's parent below the last, decisions of each code, their place in the first
    level, their bits)."""
    n, node, bit = decisions(codes)
    context = np.repeat((codes >> np.uint64(SYMBOL)).astype(np.int64), n)
    keys, at = np.unique(context << 8 | node, return_inverse=True)
    weight = np.repeat(counts, n).astype(float)
    ones = np.bincount(at, weight * bit, len(keys))
    levels, parents = [Level(keys, np.bincount(at, weight, len(keys)) - ones, ones, None)], []
    for _ in range(DEPTH - 4):
        level, where = levels[-1].up()
        levels.append(level)
        parents.append(where)
    return levels, parents, n, at, bit


def down(level: Level, mixed: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mixture so far, weight left) behind a level, from those before it."""
    return mixed + rest * level.share * level.estimate, rest * (1 - level.share)


def answers(codes: np.ndarray, counts: np.ndarray, keys: np.ndarray, mixed: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 probability of each code in steps of 1 / SCALE, given the mixture behind depth 4 for all nodes there."""
    levels, parents, n, at, bit = deep_levels(codes, counts)
    place = np.searchsorted(keys, levels[-1].keys)
    mixed, rest = mixed[place], rest[place]
    for level, where in zip(reversed(levels[:-1]), reversed(parents), strict=True):
        mixed, rest = down(level, mixed[where], rest[where])
    one = np.clip(mixed, 1e-300, 1)[at]
    log = np.log10(np.where(bit, one, np.maximum(1 - one, 1e-300)))
    total = np.add.reduceat(log, np.cumsum(n) - n) if len(n) else np.empty(0)
    return np.maximum(np.rint(total * SCALE), -(1 << 15)).astype(np.int16)


class Bundle:
    """Texts on their way: what a task has read since the last bundle."""

    def __init__(self, bundle: int, parts: int):
        self.bundle, self.parts, self.size = bundle, parts, 0
        self.batches: list[pa.RecordBatch] = []
        self.codes: dict[bool, list[np.ndarray]] = {False: [], True: []}
        self.tokens: Counter = Counter()
        self.others: set = set()

    def add(self, batch: pa.RecordBatch) -> None:
        texts = [utf8(t).lower() for t in batch.column("text").to_pylist()]
        held = batch.column("held_out").to_pylist()
        for flag in (False, True):
            some = [t for t, h in zip(texts, held, strict=True) if h == flag]
            self.codes[flag] += [codes_of(part)[0] for part in in_pieces(some)]
            for t in some:
                if flag:
                    self.others.update(t.split())
                else:
                    self.tokens.update(t.split())
                    self.tokens[END] += 1
        self.size += sum(map(len, texts))
        self.batches.append(batch)

    def rows(self) -> Iterator[tuple]:
        """(kind, part, bundle, keys, values) of texts, codes and tokens."""
        held = [self.batches[0]] if self.batches else []
        for batch in [*self.batches[1:], None]:
            if batch is None or sum(b.nbytes for b in held) + batch.nbytes > BLOB_BYTES:
                yield "texts", -1, self.bundle, PACK.compress(batches_to_bytes(held)), None
                held = []
            held.append(batch)
        self.batches = []
        each = []
        for flag in (False, True):
            each.append(counted(np.concatenate([np.empty(0, np.uint64), *self.codes[flag]])))
            self.codes[flag] = []
        unseen = np.setdiff1d(each[1][0], each[0][0], assume_unique=True)
        codes = np.concatenate([each[0][0], unseen])
        counts = np.concatenate([each[0][1], np.zeros(len(unseen), np.int64)]).astype(np.int32)
        both = np.argsort(codes, kind="stable")  # two runs in order, merged
        codes, counts = codes[both], counts[both]
        order, part = dealt_order(codes, self.parts)
        for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(some):
                yield "codes", int(part[some[0]]), self.bundle, pack_codes(codes[some]), pack(counts[some])
        for p, tokens in dealt_tokens(self.tokens.keys() | self.others | {END}, self.parts).items():
            yield "tokens", p, self.bundle, PACK.compress(b" ".join(tokens)), pack(np.array([self.tokens[t] for t in tokens], np.int64))


def in_pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about WORK_BYTES."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= WORK_BYTES):
            size += len(texts[to])
            to += 1
        yield texts[at:to]
        at = to


def dealt_order(codes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order by part and code of distinct codes that stand in order, the part of each)."""
    part = part_of(codes, parts)
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable"), part


def dealt_tokens(tokens: set, parts: int) -> dict[int, list[bytes]]:
    """Tokens in order by part."""
    dealt: dict[int, list[bytes]] = {}
    for t in sorted(tokens):
        dealt.setdefault(zlib.crc32(t) % parts, []).append(t)
    return dealt


def batches_to_bytes(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as writer:
        for b in batches:
            writer.write_batch(b)
    return sink.getvalue().to_pybytes()


PACKED = "kind string, part int, bundle long, a binary, b binary"


def bundles(docs: DataFrame, parts: int) -> DataFrame:
    """The rows of bundles of docs (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in PACKED.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        open_bundle = Bundle(first, parts)

        def out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for row in rows:
                held.append(row)
                size += len(row[3])
                if size > BLOB_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                open_bundle.add(some)
                if open_bundle.size > BUNDLE_BYTES:
                    yield from out(open_bundle.rows())
                    open_bundle = Bundle(open_bundle.bundle + 1, parts)
        if open_bundle.batches:
            yield from out(open_bundle.rows())

    return docs.mapInArrow(run, PACKED)


def tree_tops(packed: DataFrame, parts: int) -> tuple[DataFrame, int, int]:
    """(part, keys, mixed and rest behind depth 4 for the nodes of each part; training tokens; distinct ones)."""
    spark = packed.sparkSession

    def low(rows: pd.DataFrame) -> pd.DataFrame:
        """Level 4 of a part's codes, dealt to upper parts; and the part's token sums."""
        out = []
        part = int(rows["part"].iloc[0])
        some = rows[rows["kind"] == "codes"]
        if len(some):
            codes, counts = merged([unpack_codes(x) for x in some["a"]], [unpack(x, np.int32) for x in some["b"]])
            level = deep_levels(codes, counts)[0][-1]
            upper = (level.keys >> (8 + 2 * SYMBOL)) * 40503 % UPPER_PARTS
            for u in np.unique(upper):
                here = upper == u
                out.append((int(u), part, pack(level.keys[here]), pack(np.stack([level.zeros[here], level.ones[here], level.log_pw[here]])), 0, 0))
        counts = token_counts(rows[rows["kind"] == "tokens"])
        out.append((-1, part, None, None, sum(counts.values()), sum(c > 0 for c in counts.values())))
        return pd.DataFrame(out, columns=["upper", "part", "keys", "sums", "n", "v"])

    lows = cut(packed.where("kind <> 'texts'").groupBy("part").applyInPandas(low, "upper int, part int, keys binary, sums binary, n long, v long"))
    whole = lows.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()

    def levels_of(rows: pd.DataFrame) -> tuple[list[Level], list[np.ndarray]]:
        sums = [unpack(x, np.float64).reshape(3, -1) for x in rows["sums"]]
        keys, zeros, ones, log_pw = merged([unpack(x, np.int64) for x in rows["keys"]], *[[s[k] for s in sums] for k in range(3)])
        fourth = Level(keys, zeros, ones, np.zeros(len(keys)))
        fourth.log_pw = log_pw
        fourth.share = np.exp(log_kt(zeros, ones) - math.log(2) - log_pw)
        third, to_third = fourth.up()
        second, to_second = third.up()
        return [fourth, third, second], [to_third, to_second]

    def middle(rows: pd.DataFrame) -> pd.DataFrame:
        second = levels_of(rows)[0][-1]
        return pd.DataFrame({"upper": [rows["upper"].iloc[0]], "keys": [pack(second.keys)], "sums": [pack(np.stack([second.zeros, second.ones, second.log_pw]))]})

    upper = lows.where("upper >= 0")
    # At most 257^2 contexts x 256 decisions, whatever the input.
    seconds = upper.groupBy("upper").applyInPandas(middle, "upper int, keys binary, sums binary").collect()
    given = []
    if seconds:
        sums = [unpack(r["sums"], np.float64).reshape(3, -1) for r in seconds]
        keys, zeros, ones, log_pw = merged([unpack(r["keys"], np.int64) for r in seconds], *[[s[k] for s in sums] for k in range(3)])
        second = Level(keys, zeros, ones, np.zeros(len(keys)))
        second.log_pw, second.share = log_pw, np.exp(log_kt(zeros, ones) - math.log(2) - log_pw)
        first, to_first = second.up()
        root, to_root = first.up()
        mixed, rest = down(root, np.zeros(len(root.keys)), np.ones(len(root.keys)))
        mixed, rest = down(first, mixed[to_root], rest[to_root])
        mixed, rest = down(second, mixed[to_first], rest[to_first])
        for r in seconds:
            own = unpack(r["keys"], np.int64)
            at = np.searchsorted(keys, own)
            given.append((r["upper"], -1, bytearray(pack(own)), bytearray(pack(np.stack([mixed[at], rest[at]])))))
    behind = spark.createDataFrame(given, "upper int, part int, keys binary, sums binary")

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        """The mixture behind depth 4, back to the parts."""
        mine = rows[rows["part"] >= 0]
        (fourth, third, _), (to_third, to_second) = levels_of(mine)
        mixed, rest = unpack(rows[rows["part"] < 0]["sums"].iloc[0], np.float64).reshape(2, -1)
        mixed, rest = down(third, mixed[to_second], rest[to_second])
        mixed, rest = down(fourth, mixed[to_third], rest[to_third])
        out = []
        for part, keys in zip(mine["part"], mine["keys"], strict=True):
            own = unpack(keys, np.int64)
            at = np.searchsorted(fourth.keys, own)
            out.append((part, pack(own), pack(np.stack([mixed[at], rest[at]]))))
        return pd.DataFrame(out, columns=["part", "keys", "sums"])

    both = upper.select("upper", "part", "keys", "sums").unionByName(behind)
    return cut(both.groupBy("upper").applyInPandas(spread, "part int, keys binary, sums binary")), whole["n"] or 0, whole["v"] or 0


def token_counts(rows: pd.DataFrame) -> Counter:
    counts: Counter = Counter()
    for a, b in zip(rows["a"], rows["b"], strict=True):
        for t, n in zip(zstandard.decompress(a).split(b" "), unpack(b, np.int64).tolist(), strict=True):
            counts[t] += n
    return counts


def answered(packed: DataFrame, tops: DataFrame) -> DataFrame:
    """For each bundle and part the log10 probabilities of its codes and the counts of its tokens, in their order: the
    bundle knows which these are."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, part = [], str(rows["part"].iloc[0]).encode()
        some, top = rows[rows["kind"] == "codes"], rows[rows["kind"] == "tops"]
        if len(some):
            each = [unpack_codes(x) for x in some["a"]]
            codes, counts = merged(each, [unpack(x, np.int32) for x in some["b"]])
            sums = [unpack(x, np.float64).reshape(2, -1) for x in top["b"]]
            keys, mixed, rest = merged([unpack(x, np.int64) for x in top["a"]], [s[0] for s in sums], [s[1] for s in sums])
            values = answers(codes, counts, keys, mixed, rest)
            for bundle, own in zip(some["bundle"], each, strict=True):
                out.append(("codes", bundle, part, pack(values[np.searchsorted(codes, own)])))
        some = rows[rows["kind"] == "tokens"]
        counts = token_counts(some)
        for bundle, tokens in zip(some["bundle"], some["a"], strict=True):
            out.append(("tokens", bundle, part, pack(np.array([counts[t] for t in zstandard.decompress(tokens).split(b" ")], np.int64))))
        return pd.DataFrame(out, columns=["kind", "bundle", "a", "b"])

    asked = packed.where("kind <> 'texts'").unionByName(tops.select(F.lit("tops").alias("kind"), "part", F.lit(-1).cast("long").alias("bundle"), F.col("keys").alias("a"), F.col("sums").alias("b")))
    return asked.groupBy("part").applyInPandas(run, "kind string, bundle long, a binary, b binary")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row; learns
    from the rows whose crc32(id as text) mod folds is not held_fold."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == held_fold, F.lit(False)).alias("held_out"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(LEAST_PARTS, size // PART_BYTES)
    packed = cut(bundles(rows, parts))
    tops, n_all, v_all = tree_tops(packed, parts)
    under = n_all + v_all + 1
    id_type = rows.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def score(rows: pd.DataFrame) -> pa.Table:
        told = {kind: {int(a): b for a, b in zip(some["a"], some["b"], strict=True)} for kind, some in rows[rows["kind"] != "texts"].groupby("kind")}
        batches = [(batch, [utf8(t).lower() for t in batch.column("text").to_pylist()]) for blob in rows[rows["kind"] == "texts"]["a"] for batch in pa.ipc.open_stream(zstandard.decompress(blob))]
        # Each text is read once: the codes of its pieces, and the numbers of its tokens.
        starts: list[np.ndarray] = []

        def runs() -> Iterator[np.ndarray]:
            for _, texts in batches:
                found, first, n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
                for codes, at in map(codes_of, in_pieces(texts)):
                    found.append(codes)
                    first.append(at + n)
                    n += len(codes)
                starts.append(np.concatenate(first))
                yield np.concatenate(found)

        codes, places = ranked(runs())
        order, _ = dealt_order(codes, parts)
        given = np.concatenate([unpack(b, np.int16) for _, b in sorted(told["codes"].items())]).astype(np.float32) / SCALE
        if len(given) != len(codes):
            raise RuntimeError(f"{len(codes)} codes have {len(given)} answers")
        values = np.empty(len(codes), np.float32)
        values[order] = given
        numbers = Numbers()
        end = numbers[END]
        tokens_of = [[np.fromiter(map(numbers.__getitem__, t.split()), np.int32) for t in texts] for _, texts in batches]
        counts = np.zeros(len(numbers), np.int64)
        for part, tokens in dealt_tokens(numbers.keys(), parts).items():
            counts[[numbers[t] for t in tokens]] = unpack(told["tokens"][part], np.int64)
        seen = counts > 0
        logs = [math.log10((c + 1) / under) for c in counts.tolist()]
        tables = []
        for (batch, texts), place, first, tokens in zip(batches, places, starts, tokens_of, strict=True):
            if texts:
                score = np.add.reduceat(values[place].astype(float), first)
                columns = {
                    "n_tokens": [len(t) + 1 for t in tokens],
                    "n_known": [int(np.count_nonzero(seen[t])) + int(seen[end]) for t in tokens],
                    "train_tokens": [n_all] * len(texts),
                    "base_score": [sum(map(logs.__getitem__, t.tolist())) + logs[end] for t in tokens],
                    "score": score,
                    "bits_per_byte": -score / math.log10(2) / np.array([len(t) + 1 for t in texts]),
                }
                arrays = [batch.column("doc_id"), batch.column("held_out"), *(pa.array(v, pa.float64() if "score" in c or c == "bits_per_byte" else pa.int64()) for c, v in columns.items())]
                tables.append(pa.Table.from_arrays(arrays, names=["doc_id", "held_out", *columns]))
        return pa.concat_tables(tables)

    def run(table: pa.Table) -> pa.Table:
        out = score(table.to_pandas())
        return out.set_column(0, "doc_id", out.column("doc_id").cast(to_arrow_type(id_type)))

    texts = packed.where("kind = 'texts'").select("kind", "bundle", "a", "b")
    return texts.unionByName(answered(packed, tops)).groupBy("bundle").applyInArrow(run, schema)
