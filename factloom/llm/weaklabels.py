"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on a text. Expectation-maximisation over the counts of
all vote patterns estimates how often each labeller is right on either class, with no hand label. The posterior of
its pattern labels each text, and these soft labels train a linear scorer over hashed features of the text.

All votes count: patterns are aggregated over the whole input (at most 3^labellers of them reach the driver). The
scorer is fitted on a bounded sample, TRAIN_ROWS texts with the smallest hashes of id and text in each class, repeated
ones once, of which only FEATURES numbers each are gathered. Then every whole text is scored map-side. The shuffles carry pattern counts only.

Toxicity is learned where labels are given: a logistic scorer over the words' beginnings, which say a language's
insults however they are inflected, is fitted on at most TOXIC_ROWS labelled texts of each class, taken by hashes over
all languages. Labels of the held-out fold are never learned from. A word of a fixed list is toxic in any case.

Cases: a null or empty text gets no votes but for its length, which calls it bad. Very long texts are read whole. Repeated rows
are scored each. A null id is an id like others. If a class has no sample rows, the score is the posterior. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import crc_mod, cut, map_texts, pick, utf8

FEATURES = 1024
TRAIN_ROWS = 1024
EM_ROUNDS = 60
#: Labellers are built to object rarely to good texts: this rate is believed with TRUST times the weight of the data.
FALSE_ALARM, TRUST = 0.01, 4.0
EPOCHS = 300
MEMO = 1 << 18
#: Labelled texts of each class that toxicity is learned from, the fold of labels that is held out, the hashed
#: beginnings of words, and how many of these the scorer has.
TOXIC_ROWS = 2048
FOLDS, HELD_FOLD = 7, 2
STEMS, KEPT_STEMS = 1 << 20, 2048
BEGINNINGS = (3, 4, 5, 6, 7)

# Marks that prose rarely has, frequent words of four languages, and insults.
MARKS = b"#$%&*|!{}<>=~^\\"
FREQUENT = frozenset("the of and to in is that it for as with on be at by this de la el en que los del las un una y se por con der die das und ist ein nicht von zu den mit le les des et est dans du une pour".split())
INSULTS = frozenset("pathetic scum moron idiot loser worthless clown trash disgusting stupid".split())

#: Characters that are no part of a bare word. Characters of texts whose words are looked up together, one text at least.
AROUND = ".,;:!?\"'()#$%&*|"
TOGETHER = 1 << 20

LABELLERS = ("marks", "shouting", "repeats", "lines", "length", "frequent", "vocabulary")


class Classes(dict):
    """A for capitals, a for other letters, 0 for digits; other characters as they are. By code points, for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        mark = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return mark


CLASSES = Classes()
RUNS = re.compile(r"([^\n])\1+")


class Lexicon(dict):
    """Numbers of words, and arrays of what is known of each word and each bare word. Whatever is read off a word is
    worked out once, for all new words of some texts together: joined by line ends, which no word holds."""

    def __init__(self, toxicity: Toxicity | None = None, voting_only: bool = False):
        self.toxicity, self.voting_only = toxicity, voting_only
        if toxicity is not None:
            self.place = np.full(STEMS + 1, len(toxicity.stems), np.int32)
            self.place[toxicity.stems] = np.arange(len(toxicity.stems))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.bares: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.bare, self.shape, self.ending = (np.zeros(0, np.int64) for _ in range(3))  # of words
        self.frequent, self.insult, self.telling = (np.zeros(0, bool) for _ in range(3))  # of bare words
        self.places = np.zeros((0, len(BEGINNINGS) + 1), np.int32)

    def learn(self, words: set[str]) -> None:
        """Numbers the words that are new; forgets all others first if they became too many."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMO:
            self.forget()
            new = list(words)
        if not new:
            return
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        known = len(self.bares)
        stripped = "\n".join([w.strip(AROUND) for w in new]).lower().split("\n")
        self._add("bare", np.array([self.bares.setdefault(b, len(self.bares)) for b in stripped], np.int64))
        bares = list(itertools.islice(self.bares, known, None))
        self._add("frequent", np.array([b in FREQUENT for b in bares], bool))
        self._add("insult", np.array([b in INSULTS for b in bares], bool))
        if self.voting_only:
            return
        self._add("shape", self.hashed("s", word_shapes(new)))
        self._add("ending", self.hashed("e", "\n".join([w[-3:] for w in new]).lower().split("\n")))
        if self.toxicity is not None:
            places = np.sort(self.place[stem_table(bares)], axis=1)
            places[:, 1:][places[:, 1:] == places[:, :-1]] = len(self.toxicity.stems)  # each stem of a word counts once
            self._add("places", places)
            self._add("telling", (places < len(self.toxicity.stems)).any(axis=1))

    def _add(self, name: str, more: np.ndarray) -> None:
        setattr(self, name, np.concatenate([getattr(self, name), more]))

    def hashed(self, kind: str, texts: list[str]) -> np.ndarray:
        """The features of shapes or endings."""
        marks, out = self.marks, []
        for mark in texts:
            k = marks.get(kind + mark)
            if k is None:
                k = marks[kind + mark] = 2 + zlib.crc32((kind + mark).encode("utf-8", "surrogatepass")) % (FEATURES - 2)
            out.append(k)
        return np.array(out, np.int64)


def word_shapes(words: list[str]) -> list[str]:
    """A for capitals, a for other letters, 0 for digits and other characters as they are, runs as one."""
    text = "\n".join(words).translate(CLASSES)
    for mark in "aA0":  # runs of these are shortened by plain replacement, most at once
        while mark * 2 in text:
            text = text.replace(mark * 4, mark).replace(mark * 2, mark)
    return RUNS.sub(r"\1", text).split("\n")


def bare_word(word: str) -> str:
    return word.strip(AROUND).lower()


class Reading:
    """What labellers and scorers need of a text."""

    def __init__(self, text: str | None, words: list[str], lexicon: Lexicon):
        self.data, self.lexicon = utf8(text), lexicon
        self.ids = np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))
        self.bare = lexicon.bare[self.ids]
        self.twins = int((self.ids[1:] == self.ids[:-1]).sum())

    def votes(self) -> tuple[tuple[int, ...], bool]:
        """((1 good, 0 bad, -1 nothing) of each labeller, whether an insult is a word of the text)."""
        data, bare, lexicon = self.data, self.bare, self.lexicon
        n, size = len(bare), max(1, len(data))

        def vote(value: float, good: float, bad: float) -> int:
            return 1 if value <= good else 0 if value >= bad else -1

        marks = (len(data) - len(data.translate(None, MARKS))) / size
        shouting = (len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size
        lines = [x for x in data.split(b"\n") if x]
        twice = 1 - len(set(lines)) / max(1, len(lines))
        common = int(lexicon.frequent[bare].sum()) / max(1, n)
        long = n >= 20
        few = 0.1 * n**0.8
        # The first words mostly have so many different ones that the others need not be counted.
        poor = long and len(set(bare[: 4 * int(few) + 4].tolist())) < few and len(np.unique(bare)) < few
        return (
            vote(marks, 0.01, 0.04),
            vote(shouting, 0.06, 0.2),
            vote(self.twins / max(1, n - 1), 0.02, 0.15) if n > 1 else -1,
            0 if len(lines) > 3 and twice >= 0.5 else -1,
            0 if n < 2 else -1,
            0 if long and common < 0.03 else 1 if common >= 0.15 else -1,
            0 if poor else -1,
        ), bool(lexicon.insult[bare].any())

    def features(self) -> np.ndarray:
        """Hashed features: shares of words' shapes and endings, and of words that repeat the one before."""
        out, n = np.zeros(FEATURES, np.float32), len(self.ids)
        if not n:
            out[1] = 1
            return out
        out += np.bincount(np.concatenate([self.lexicon.shape[self.ids], self.lexicon.ending[self.ids]]), minlength=FEATURES) / n
        out[0] = self.twins / n
        return np.sqrt(out)

    def toxicity(self) -> float:
        return self.lexicon.toxicity.score(self.lexicon.places[self.bare[self.lexicon.telling[self.bare]]])


def readings(texts: list[str | None], lexicon: Lexicon) -> Iterator[Reading]:
    """Readings of texts in order. The lexicon may forget words between them, so each is to be used before the next."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= TOGETHER):
            size += len(texts[to] or "")
            to += 1
        words = [(t or "").split() for t in texts[at:to]]
        lexicon.learn(set().union(*words))
        for text, own in zip(texts[at:to], words, strict=True):
            yield Reading(text, own, lexicon)
        at = to


def votes(text: str | None) -> tuple[tuple[int, ...], bool]:
    return next(readings([text], Lexicon(voting_only=True))).votes()


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS, trust: float = TRUST) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """(posterior of good by pattern, P(vote | class) as labellers x 2 classes x 3 votes) by expectation-maximisation.
    A labeller's silence is an outcome too, as some only ever object. It starts from texts without any objection."""
    if not patterns:
        return {}, np.zeros((0, 2, 3))
    x = np.array([p for p, _ in patterns]) + 1  # 0 nothing, 1 bad, 2 good
    n = np.array([c for _, c in patterns], float)
    good = np.where((x == 1).any(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        prior = min(0.99, max(0.01, float((n * good).sum() / n.sum())))
        table = np.zeros((x.shape[1], 2, 3))
        for k in range(x.shape[1]):
            for v in range(3):
                here = x[:, k] == v
                table[k, :, v] = (n * (1 - good))[here].sum() + 1, (n * good)[here].sum() + 1
            kept = table[k, 1, 0] + table[k, 1, 2]
            alarm = (table[k, 1, 1] + trust * FALSE_ALARM * table[k, 1].sum()) / (1 + trust)
            table[k, 1] *= (table[k, 1].sum() - alarm) / kept
            table[k, 1, 1] = alarm
        table /= table.sum(axis=2, keepdims=True)
        ratio = np.log(prior / (1 - prior)) + sum(np.log(table[k, 1, x[:, k]] / table[k, 0, x[:, k]]) for k in range(x.shape[1]))
        good = 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))
    return {p: float(g) for (p, _), g in zip(patterns, good, strict=True)}, table


def fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights and bias of a logistic scorer of soft labels, by Adam on the whole sample."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    y = y.astype(x.dtype)  # one precision throughout, so that nothing of the sample's size is converted
    w, m, v = (np.zeros(x.shape[1], x.dtype) for _ in range(3))
    for k in range(1, epochs + 1):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(x) + 1e-4 * w
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def stems(word: str) -> tuple[int, ...]:
    """Hashes of a word and its beginnings."""
    w = bare_word(word)
    return tuple({zlib.crc32(x.encode("utf-8", "surrogatepass")) % STEMS for x in (w[:k] for k in (*BEGINNINGS, len(w))) if x})


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ (c & 1) * np.uint32(0xEDB88320)
    return c


CRC = _crc_table()


def stem_table(bares: list[str], longest: int = 64) -> np.ndarray:
    """The stems of bare words, a row of len(BEGINNINGS) + 1 hashes each, some of them equal; STEMS, which
    no hash is, of the empty word. CRC-32 is carried on byte by byte for all words at once; those over `longest` bytes go by themselves."""
    data = np.frombuffer("\n".join([*bares, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    long = int(np.searchsorted(-sizes, -longest))  # words before this one have more bytes
    starts, sizes = starts[long:], sizes[long:]
    crc, letters = np.full(len(sizes), 0xFFFFFFFF, np.uint32), np.zeros(len(sizes), np.int64)
    out = np.zeros((len(sizes), len(BEGINNINGS) + 1), np.uint32)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j))  # words of more than j bytes
        b, c = data[starts[:n] + j], crc[:n]
        begins = (b & 0xC0) != 0x80  # a character, so the ones before it are whole
        letters[:n] += begins
        if j >= BEGINNINGS[0]:
            for k, length in enumerate(BEGINNINGS):
                now = np.flatnonzero(begins & (letters[:n] == length + 1))
                out[now, k] = c[now]
        crc[:n] = CRC[(c ^ b) & 0xFF] ^ (c >> 8)
    out[:, -1] = crc
    for k, length in enumerate(BEGINNINGS):
        out[:, k] = np.where(letters > length, out[:, k], crc)
    table = np.empty((len(bares), out.shape[1]), np.int64)
    table[order[long:]] = np.where(sizes[:, None] > 0, (out ^ np.uint32(0xFFFFFFFF)) % STEMS, STEMS)
    for row in order[:long]:
        own = stems(bares[row])
        table[row] = [*own, *[own[0]] * (out.shape[1] - len(own))]
    return table


def stem_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of the text's words and their beginnings, how often each occurs)."""
    places: list[int] = []
    for w, n in Counter((text or "").split()).items():
        places += stems(w) * n
    return np.unique(np.array(places, np.int64), return_counts=True)


class Toxicity:
    """A logistic scorer of log counts of the KEPT_STEMS beginnings of words that tell the classes apart best."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray):
        at = np.concatenate([k for k, _ in rows])
        row = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
        value = np.log1p(np.concatenate([n for _, n in rows]).astype(float))
        kinds, where = np.unique(at, return_inverse=True)
        bad, fine = (np.bincount(where, value * (toxic[row] == c), len(kinds)) / max(1, (toxic == c).sum()) for c in (True, False))
        spread = np.sqrt(np.bincount(where, value * value, len(kinds)) / len(rows)) + 0.05
        self.stems = np.sort(kinds[np.argsort(-np.abs(bad - fine) / spread, kind="stable")[:KEPT_STEMS]])
        x = np.zeros((len(rows), len(self.stems)), np.float32)
        place = np.minimum(np.searchsorted(self.stems, at), len(self.stems) - 1)
        known = self.stems[place] == at
        x[row[known], place[known]] = value[known]
        self.weights = fit(x, toxic.astype(float))
        self.place = {int(k): i for i, k in enumerate(self.stems)}

    def score(self, places: np.ndarray) -> float:
        """Of the places of a text's stems; the number of stems stands for none."""
        counts = np.bincount(places.ravel(), minlength=len(self.stems) + 1)[:-1]
        return float(1 / (1 + np.exp(-np.clip(np.log1p(counts) @ self.weights[:-1] + self.weights[-1], -30, 30))))


def sampled(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of texts for each of the wanted (h, h2): as many as these, however often a text occurs."""
    return texts.join(F.broadcast(wanted), ["h", "h2"]).groupBy("h", "h2").agg(F.first("text").alias("text"))


def learn_toxicity(texts: DataFrame, labels: DataFrame) -> Toxicity | None:
    """The scorer of a bounded sample of labelled texts outside the held-out fold; None where a class has none."""
    told = pick(labels, doc_id="doc_id", toxic="toxic").where((crc_mod(F.col("doc_id"), FOLDS) != HELD_FOLD) & F.col("toxic").isin(0, 1))
    told = told.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    told = cut(told.join(texts.select("doc_id", "h", "h2"), "doc_id").select("h", "h2", "toxic"))
    chosen = [told.where(F.col("toxic") == c).orderBy("h", "h2").limit(TOXIC_ROWS) for c in (0, 1)]
    wanted = cut(chosen[0].unionByName(chosen[1]).groupBy("h", "h2").agg(F.max("toxic").alias("toxic")))  # 2 x TOXIC_ROWS at most

    def work(some: list[str | None]) -> dict:
        got = [stem_counts(t) for t in some]
        return {"at": [k.astype(np.int32).tobytes() for k, _ in got], "n": [n.astype(np.int32).tobytes() for _, n in got]}

    measured = map_texts(sampled(texts, wanted.drop("toxic")), ["h", "h2"], "at binary, n binary", lambda: work)
    sample = sorted(tuple(r) for r in measured.join(F.broadcast(wanted), ["h", "h2"]).select("h", "h2", "toxic", "at", "n").collect())
    toxic = np.array([t == 1 for _, _, t, _, _ in sample], bool)
    if not toxic.any() or toxic.all():
        return None
    return Toxicity([(np.frombuffer(bytes(k), np.int32), np.frombuffer(bytes(n), np.int32)) for *_, k, n in sample], toxic)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """doc_id, votes, posterior, score, good (score at least one half), toxic and keep of every row; labels (doc_id,
    toxic 0 or 1) of some rows are what toxicity is learned from."""
    texts = pick(docs, doc_id=id_col, text=text_col).withColumns({"h": F.xxhash64("doc_id"), "h2": F.xxhash64(F.coalesce("text", F.lit("")))})

    def cast():
        lexicon = Lexicon(voting_only=True)
        return lambda some: {"votes": [list(r.votes()[0]) for r in readings(some, lexicon)]}

    voted = cut(map_texts(texts, ["h", "h2"], "votes array<int>", cast))
    patterns = sorted((tuple(r["votes"]), r["n"]) for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect())
    posterior, _ = estimate(patterns)

    bad = [list(p) for p, g in posterior.items() if g < 0.5]
    is_bad = F.exists(F.array(*[F.array(*map(F.lit, p)) for p in bad]), lambda p: p == F.col("votes")) if bad else F.lit(False)
    chosen = [voted.where(c).select("h", "h2").orderBy("h", "h2").limit(TRAIN_ROWS) for c in (is_bad, ~is_bad)]

    def measure():
        lexicon = Lexicon()

        def work(some: list[str | None]) -> dict:
            read = [(list(r.votes()[0]), r.features().tobytes()) for r in readings(some, lexicon)]
            return {"votes": [v for v, _ in read], "x": [x for _, x in read]}

        return work

    wanted = cut(chosen[0].unionByName(chosen[1]).distinct())  # 2 x TRAIN_ROWS at most
    sample = sorted(tuple(r) for r in map_texts(sampled(texts, wanted), ["h", "h2"], "votes array<int>, x binary", measure).collect())
    y = np.array([posterior[tuple(v)] for *_, v, _ in sample])
    weights = None
    if len(sample) and (y < 0.5).any() and (y >= 0.5).any():
        weights = fit(np.frombuffer(b"".join(bytes(x) for *_, x in sample), np.float32).reshape(len(sample), -1), y)
    shared = docs.sparkSession.sparkContext.broadcast((posterior, weights, None if labels is None else learn_toxicity(texts, labels)))

    def score():
        posterior, weights, learned = shared.value
        lexicon = Lexicon(learned)

        def work(some: list[str | None]) -> dict:
            out: dict[str, list] = {n: [] for n in ("votes", "posterior", "score", "good", "toxic", "keep")}
            for read in readings(some, lexicon):
                v, insult = read.votes()
                p = posterior[v]
                s = p if weights is None else float(1 / (1 + np.exp(-np.clip(read.features() @ weights[:-1] + weights[-1], -30, 30))))
                toxic = insult or (learned is not None and read.toxicity() >= 0.5)
                for n, x in zip(out, (",".join(map(str, v)), p, s, s >= 0.5, toxic, s >= 0.5 and not toxic), strict=True):
                    out[n].append(x)
            return out

        return work

    return map_texts(texts, ["doc_id"], "votes string, posterior double, score double, good boolean, toxic boolean, keep boolean", score)
