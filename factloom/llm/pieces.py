"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A vocabulary file of a public tokenizer is read on the driver (its path is a parameter; nothing is trained). Its
pieces are kept as a double-array trie over UTF-8 bytes, which every Python worker gets once; its size is that of the
vocabulary, whatever the input. Files of merge ranks have no log scores, so a piece's log score is Zipf's law of its
rank. Characters that no piece covers fall back to byte pieces, so every text decodes to exactly itself.

Pieces hold the whitespace marker at their start only (checked on loading), so the best path through a text is the
concatenation of the best paths through its marker-led chunks, and repeated chunks are looked up. A vocabulary with
markers inside pieces is searched over whole texts.

Both directions are map-side: no shuffle, no state between rows. Cases: a null or empty text has no pieces and decodes
to the empty text; very long texts and chunks are encoded whole; a marker character in a text itself falls back to
bytes; repeated rows are separate rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from factloom.llm.common import kept, map_texts, pick

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Chunks remembered by a worker, in each of two generations.
MEMO_CHUNKS = 300_000
MEMO_LENGTH = 64


def read_vocabulary(path: str) -> tuple[list[bytes], list[float], list[int]]:
    """(piece bytes by id, log score by id, ids of the 256 byte pieces) of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    stored = [model.get_score(i) for i in normal]
    ranked = all(s == int(s) for s in stored)  # ranks of merges, not log scores
    total = math.log(sum(1 / (k + 2) for k in range(len(normal))))
    pieces, scores = [b""] * n, [-math.inf] * n
    for k, i in enumerate(normal):
        pieces[i] = model.id_to_piece(i).encode()
        scores[i] = -math.log(k + 2) - total if ranked else stored[k]
    by_byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return pieces, scores, by_byte


@dataclass
class DoubleArray:
    """A trie in two arrays: the child of node s by byte b is t = base[s] + b where check[t] == s."""

    base: list[int]
    check: list[int]
    value: list[int]

    @classmethod
    def build(cls, entries: list[tuple[bytes, int]]) -> DoubleArray:
        trie: dict = {}
        for key, value in entries:
            node = trie
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        start, queue = 1, [(0, trie)]
        while queue:
            at, node = queue.pop()
            value[at] = node.get(-1, -1)
            labels = sorted(b for b in node if b >= 0)
            if not labels:
                continue
            spot, seen, taken = max(start, labels[0] + 1), 0, 0
            while True:
                if spot + 256 >= len(check):
                    for column, fill in ((base, 0), (check, -1), (value, -1)):
                        column.extend([fill] * size)
                seen += 1
                if check[spot] >= 0:
                    taken += 1
                else:
                    offset = spot - labels[0]
                    if all(check[offset + b] < 0 for b in labels):
                        break
                spot += 1
            if seen > 64 and taken >= 0.9 * seen:  # a full stretch: later nodes start behind it
                start = spot
            base[at] = offset
            for b in labels:
                check[offset + b] = at
                queue.append((offset + b, node[b]))
        return cls(base, check, value)


class Unigram:
    """The best segmentation of texts under a vocabulary's log scores."""

    def __init__(self, pieces: list[bytes], scores: list[float], by_byte: list[int]):
        self.pieces, self.scores, self.by_byte = pieces, scores, by_byte
        self.trie = DoubleArray.build([(p, i) for i, p in enumerate(pieces) if p])
        self.fallback = min(s for s in scores if s > -math.inf) - 10.0
        self.split = not any(re.search(f"[^{MARK}]{MARK}", p.decode()) for p in pieces if p)
        self.out = [p.replace(MARK_BYTES, b" ") for p in pieces]
        for b, i in enumerate(by_byte):
            self.out[i] = bytes([b])
        self.bytes_of = frozenset(by_byte)
        # Characters of no piece stand alone on every path, so they end chunks too.
        alone = "".join(c for c in "\n\t\r" if not any(c.encode() in p for p in pieces))
        # In chunks, spaces stand for markers, with which a chunk would take two bytes a character instead of one.
        self.chunk = re.compile(f"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +")
        self.memo: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def best(self, chunk: str) -> tuple:
        """(byte pieces, log score, id, id, ...) of the best path through a chunk: one flat tuple, as a worker remembers
        hundreds of thousands of them."""
        data = chunk.replace(" ", MARK).encode("utf-8", "surrogatepass")
        n, base, check, value, scores = len(data), self.trie.base, self.trie.check, self.trie.value, self.scores
        best = [-math.inf] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -math.inf:
                continue
            lead = data[i]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            cost = here + self.fallback * step
            if cost > best[i + step]:
                best[i + step], back[i + step] = cost, (i, -1)
            node = 0
            for j in range(i, n):
                child = base[node] + data[j]
                if check[child] != node:
                    break
                node = child
                v = value[node]
                if v >= 0 and here + scores[v] > best[j + 1]:
                    best[j + 1], back[j + 1] = here + scores[v], (i, v)
        ids: list[int] = []
        at, n_bytes = n, 0
        while at:
            start, v = back[at]
            if v >= 0:
                ids.append(v)
            else:
                n_bytes += at - start
                ids.extend(self.by_byte[b] for b in reversed(data[start:at]))
            at = start
        return n_bytes, best[n], *reversed(ids)

    def encode(self, text: str | None) -> tuple[list[int], float, int]:
        """(ids, log score, byte pieces) of a whole text."""
        ids: list[int] = []
        score, n_bytes, memo = 0.0, 0, self.memo
        if not text:
            return ids, score, n_bytes
        for k, part in enumerate(text.split(MARK)):
            if k:  # a marker in the text itself
                ids += [self.by_byte[b] for b in MARK_BYTES]
                n_bytes += 3
                score += 3 * self.fallback
            spaced = part if k else " " + part
            for chunk in self.chunk.findall(spaced) if self.split else [spaced]:
                found = memo.get(chunk)
                if found is None:
                    found = self.older.get(chunk) or self.best(chunk)
                    if len(chunk) <= MEMO_LENGTH:
                        if len(memo) >= MEMO_CHUNKS:
                            self.older = memo
                            memo = self.memo = {}
                        memo[chunk] = found
                n_bytes += found[0]
                score += found[1]
                ids += found[2:]
        return ids, score, n_bytes

    def decode(self, ids) -> str:
        """The text of ids: byte pieces become bytes, markers become spaces, and the first marker goes."""
        out = self.out
        return b"".join([out[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def _shared(broadcast) -> Unigram:
    """One Unigram in each Python worker, kept between its tasks of this module."""
    key, loaded = broadcast.value[3], kept(__name__)
    if key not in loaded:
        loaded.clear()
        loaded[key] = Unigram(*broadcast.value[:3])
    return loaded[key]


def _vocabulary(docs: DataFrame, path: str):
    pieces, scores, by_byte = read_vocabulary(path)
    key = zlib.crc32(b"\0".join(pieces))
    return docs.sparkSession.sparkContext.broadcast((pieces, scores, by_byte, key))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, log_score and n_byte_pieces of every row."""
    vocabulary = _vocabulary(docs, path)

    def make():
        model = _shared(vocabulary)

        def work(texts: list[str | None]) -> dict:
            got = [model.encode(t) for t in texts]
            return {"ids": [np.asarray(g[0], np.int32) for g in got], "log_score": [g[1] for g in got], "n_byte_pieces": [g[2] for g in got]}

        return work

    return map_texts(pick(docs, doc_id=id_col, text=text_col), ["doc_id"], "ids array<int>, log_score double, n_byte_pieces long", make)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids."""
    vocabulary = _vocabulary(encoded, path)

    def make():
        model = _shared(vocabulary)
        return lambda rows: {"text": [model.decode(i if i is not None else ()) for i in rows]}

    return map_texts(pick(encoded, doc_id=id_col, ids=ids_col), ["doc_id"], "text string", make, text_col="ids")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every row in one pass: doc_id, n_pieces, n_byte_pieces, log_score, ids_crc32 (of the ids as
    little-endian 32-bit numbers) and whether the decoded text is the text itself."""
    vocabulary = _vocabulary(docs, path)

    def make():
        model = _shared(vocabulary)

        def work(texts: list[str | None]) -> dict:
            out: dict[str, list] = {n: [] for n in ("n_pieces", "n_byte_pieces", "log_score", "ids_crc32", "decodes")}
            for text in texts:
                ids, score, n_bytes = model.encode(text)
                for n, v in zip(out, (len(ids), n_bytes, score, zlib.crc32(array("i", ids).tobytes()), model.decode(ids) == (text or "")), strict=True):
                    out[n].append(v)
            return out

        return work

    return map_texts(pick(docs, doc_id=id_col, text=text_col), ["doc_id"], "n_pieces long, n_byte_pieces long, log_score double, ids_crc32 long, decodes boolean", make)
