"""Language identification by a bidirectional gated recurrent network over bytes.

The network (a byte table, a forward and a backward GRU of HIDDEN units, a softmax at every position) is trained in
numpy by backpropagation through time with Adam, on the driver, on a bounded sample: windows of WINDOW bytes from at
most TRAIN_ROWS labelled rows, those with the smallest hashes of id and text, at most TRAIN_WINDOWS from each. Every byte of every
text is then labelled: a text is cut into windows that overlap by WARM bytes on both sides, so that each position has
its context, and a document's probabilities are the mean of those at positions of letters.

Prediction is map-side: no shuffle; what is broadcast is the network (a few kB). Cases: a null text or one without
letters is `und` with score 1. Very long texts are cut into windows, all of which count. Ties go to the first language
in order. Repeated rows are predicted each. A null id is outside the held-out fold. With no labelled training rows every text is `und` with score 0. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import crc_mod, filter_texts, map_texts, pick, utf8

HIDDEN = 8
WINDOW = 96
WARM = 16
TRAIN_ROWS = 2048
#: Characters of each of these that are gathered.
PIECE = 4096
TRAIN_WINDOWS = 4
STEPS = 240
BATCH = 128
RATE = 0.02
PAD = 32
LETTER = regex.compile(r"\p{L}")


@dataclass
class Gru:
    """One direction. The update and reset gates are halves of tanh: s(x) = (1 + tanh(x)) / 2 with weights to suit."""

    table: np.ndarray  # 3H x 256: update, reset, candidate; byte embedding and bias in one
    inner: np.ndarray  # 3H x H
    bias: np.ndarray  # H, of the candidate's recurrent part

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: T x B bytes. States T x H x B, and what backpropagation needs."""
        n = self.inner.shape[1]
        h = np.zeros((n, x.shape[1]), np.float32)
        states, saved = np.empty((len(x), n, x.shape[1]), np.float32), []
        bias = self.bias[:, None]
        for t in range(len(x)):
            pre = self.table.take(x[t], axis=1)
            rec = self.inner @ h
            gates = np.tanh(pre[: 2 * n] + rec[: 2 * n])
            gates *= 0.5
            gates += 0.5
            z, r = gates[:n], gates[n:]
            q = rec[2 * n :] + bias
            c = np.tanh(pre[2 * n :] + r * q)
            new = c + z * (h - c)
            if keep:
                saved.append((h, z, r, q, c))
            h = new
            states[t] = h
        return states, saved

    def back(self, x: np.ndarray, saved: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of table, inner and bias, by backpropagation through time."""
        n = self.inner.shape[1]
        g_table, g_inner, g_bias = np.zeros_like(self.table), np.zeros_like(self.inner), np.zeros_like(self.bias)
        dh = np.zeros_like(d_states[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, q, c = saved[t]
            dh = dh + d_states[t]
            dz = dh * (h - c) * 2 * z * (1 - z)
            dc = dh * (1 - z) * (1 - c * c)
            dr = dc * q * 2 * r * (1 - r)
            dq = dc * r
            d_pre = np.concatenate([dz, dr, dc])
            d_rec = np.concatenate([dz, dr, dq])
            g_inner += d_rec @ h.T
            g_bias += dq.sum(axis=1)
            order = np.argsort(x[t], kind="stable")
            seen, first = np.unique(x[t][order], return_index=True)
            g_table[:, seen] += np.add.reduceat(d_pre[:, order], first, axis=1)
            dh = dh * z + self.inner.T @ d_rec
        return g_table, g_inner, g_bias


class BiGru:
    """Forward and backward Gru, and a softmax over languages at each position."""

    def __init__(self, langs: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs = langs

        def gru() -> Gru:
            return Gru((rng.normal(size=(3 * HIDDEN, 256)) * 0.3).astype(np.float32), (rng.normal(size=(3 * HIDDEN, HIDDEN)) / HIDDEN**0.5).astype(np.float32), np.zeros(HIDDEN, np.float32))

        self.forward, self.backward = gru(), gru()
        self.out = (rng.normal(size=(len(langs), 2 * HIDDEN)) * 0.1).astype(np.float32)
        self.bias = np.zeros((len(langs), 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*vars(self.forward).values(), *vars(self.backward).values(), self.out, self.bias]

    def states(self, x: np.ndarray, keep: bool = False):
        f, fs = self.forward.run(x, keep)
        b, bs = self.backward.run(x[::-1], keep)
        return f, b[::-1], fs, bs

    def probabilities(self, x: np.ndarray, part: tuple[int, int] | None = None) -> np.ndarray:
        """T x languages x B, of all positions or of a part of them."""
        f, b, _, _ = self.states(x)
        lo, hi = part or (0, len(x))
        logits = np.matmul(self.out[:, :HIDDEN], f[lo:hi])
        logits += np.matmul(self.out[:, HIDDEN:], b[lo:hi])
        logits += self.bias
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients."""
        f, b, fs, bs = self.states(x, keep=True)
        logits = np.matmul(self.out[:, :HIDDEN], f) + np.matmul(self.out[:, HIDDEN:], b) + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        columns = np.arange(x.shape[1])
        loss = -float(np.log(p[:, y, columns] + 1e-9).mean())
        p[:, y, columns] -= 1
        p /= p.shape[0] * p.shape[2]
        g_out = np.concatenate([np.einsum("tlb,thb->lh", p, f), np.einsum("tlb,thb->lh", p, b)], axis=1)
        g_bias = p.sum(axis=(0, 2))[:, None]
        d_f, d_b = np.matmul(self.out[:, :HIDDEN].T, p), np.matmul(self.out[:, HIDDEN:].T, p)
        return loss, [*self.forward.back(x, fs, d_f), *self.backward.back(x[::-1], bs, d_b[::-1]), g_out, g_bias]


def train(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 1) -> BiGru | None:
    """A network trained on (text, language) rows; None if there are none."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    windows: dict[str, list[bytes]] = {lang: [] for lang in langs}
    for text, lang in rows:
        data = utf8(text)
        for _ in range(min(TRAIN_WINDOWS, 1 + len(data) // WINDOW)):
            at = int(rng.integers(0, max(1, len(data) - WINDOW + 1)))
            windows[lang].append(data[at : at + WINDOW].ljust(WINDOW, bytes([PAD])))
        # A few words between padding, as short texts look to the network.
        at = data.find(b" ", int(rng.integers(0, max(1, len(data) - 64)))) + 1
        few = data[at : at + int(rng.integers(8, WINDOW - 2 * WARM))].rpartition(b" ")[0] or data[at : at + 16]
        windows[lang].append((bytes([PAD]) * WARM + few).ljust(WINDOW, bytes([PAD])))
    if not langs:
        return None
    model = BiGru(langs, seed)
    arrays = [np.frombuffer(b"".join(windows[lang]), np.uint8).reshape(-1, WINDOW) for lang in langs]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    # Between equal shares and the languages' own: ambiguous words lean to what is common, rare languages are learned.
    share = np.sqrt([len(a) for a in arrays])
    each = np.maximum(4, (BATCH * share / share.sum()).astype(int))
    y = np.repeat(np.arange(len(langs)), each)
    for k in range(1, steps + 1):
        x = np.concatenate([a[rng.integers(0, len(a), n)] for a, n in zip(arrays, each, strict=True)]).T
        _, grads = model.step(np.ascontiguousarray(x), y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - k / (steps + 1)))
        for p, g, (m, v) in zip(model.parameters(), grads, moments, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return model


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x (WARM + WINDOW + WARM) bytes, the text of each window, how many core positions are the text's)."""
    width = WINDOW + 2 * WARM
    pad, parts, owner, core = bytes([PAD]) * WARM, [], [], []
    for k, t in enumerate(texts):
        n = -(-len(t) // WINDOW)
        data = np.frombuffer(pad + t + bytes([PAD]) * (n * WINDOW - len(t) + WARM), np.uint8)
        parts.append(np.lib.stride_tricks.sliding_window_view(data, width)[::WINDOW] if n else np.empty((0, width), np.uint8))
        owner += [k] * n
        core += [WINDOW] * (n - 1) + [len(t) - (n - 1) * WINDOW] * (n > 0)
    return np.concatenate(parts) if parts else np.empty((0, width), np.uint8), np.array(owner, np.int64), np.array(core, np.int64)


#: Bytes that letters are made of: A-Z, a-z and all parts of longer characters.
LETTER_BYTE = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def predict_texts(model: BiGru | None, texts: list[str | None], block: int = 1024) -> list[tuple[str, float, list[float]]]:
    """(language, its probability, positions' share of each language) of every text."""
    data = [utf8(t) for t in texts]
    good = [t is not None and LETTER.search(t) is not None for t in texts]
    n = len(model.langs) if model else 0
    sums = np.zeros((len(texts), n))
    votes = np.zeros((len(texts), n))
    weight = np.zeros(len(texts))
    if model:
        index = [k for k, g in enumerate(good) if g]
        windows, owner, core = cut_windows([data[k] for k in index])
        owner = np.array(index, np.int64)[owner] if index else owner
        for at in range(0, len(windows), block):
            x = np.ascontiguousarray(windows[at : at + block].T)
            p = model.probabilities(x, (WARM, WARM + WINDOW))
            mask = (LETTER_BYTE[x[WARM : WARM + WINDOW]] & (np.arange(WINDOW)[:, None] < core[None, at : at + block])).astype(np.float32)
            np.add.at(sums, owner[at : at + block], np.einsum("tlb,tb->bl", p, mask))
            label = p.argmax(axis=1)
            np.add.at(votes, owner[at : at + block], np.stack([((label == k) * mask).sum(axis=0) for k in range(n)], axis=1))
            np.add.at(weight, owner[at : at + block], mask.sum(axis=0))
    out = []
    for k, g in enumerate(good):
        if not g:
            out.append(("und", 1.0, [0.0] * n))
        elif not model or weight[k] == 0:
            out.append(("und", 0.0, [0.0] * n))
        else:
            p = sums[k] / weight[k]
            out.append((model.langs[int(p.argmax())], float(min(1.0, p.max())), (votes[k] / weight[k]).tolist()))
    return out


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """At most TRAIN_ROWS labelled rows outside the held-out third, repeated ones once: those with the smallest hashes of
    id and text. Only hashes are sorted; then a semi-join fetches a piece of PIECE characters of each text, from which
    windows are drawn."""
    fold = docs.where(F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    fold = fold.select("text", "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("h2"))
    chosen = fold.select("h", "h2").orderBy("h", "h2").limit(TRAIN_ROWS).distinct()
    start = F.pmod(F.xxhash64("h", F.lit(3)), F.greatest(F.lit(1), F.length("text") - PIECE)).cast("int") + 1
    pieces = fold.join(F.broadcast(chosen), ["h", "h2"]).select("h", "h2", F.substring("text", start, F.lit(PIECE)).alias("text"), "lang")
    # A row for each chosen text, so TRAIN_ROWS at most, however often it occurs.
    rows = pieces.groupBy("h", "h2").agg(F.min(F.struct("lang", "text")).alias("x")).select("h", "h2", "x.*").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["h"], r["h2"]))]


def identify(docs: DataFrame, model: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and position_shares (of each language among the labels of letters) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        network = shared.value

        def work(texts: list[str | None]) -> dict:
            got = predict_texts(network, texts)
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "position_shares": [g[2] for g in got]}

        return work

    return map_texts(pick(docs, doc_id=id_col, text=text_col), ["doc_id"], "lang_pred string, score double, position_shares array<double>", make)


def language_id(docs: DataFrame) -> DataFrame:
    """Trains on docs' own labelled rows outside the held-out third and predicts every row."""
    model = train(training_rows(pick(docs, doc_id="doc_id", text="text", lang="lang")))
    out = identify(docs, model)
    return out.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)))


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of docs, as they are, whose language is known with at least that probability; trains on docs itself."""
    model = train(training_rows(pick(docs, doc_id="doc_id", text="text", lang="lang")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide():
        network = shared.value
        return lambda texts: [lang != "und" and score >= least for lang, score, _ in predict_texts(network, texts)]

    return filter_texts(docs, decide)
