"""op2, op1 and op7: laws, gradients, probabilities and counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ctw, kdshards, langid


def test_shards_hold_the_law(spark):
    rng = random.Random(1)
    texts = ["copy " * 40 if k % 3 == 0 else "x" * rng.randint(1, 400) for k in range(600)]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 5}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = kdshards.kd_shards(docs, shards=7).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    total = Counter()
    for r in got:
        size = len(texts[r["doc_id"]]) + 8
        assert (r["size"], r["text_crc32"]) == (size, zlib.crc32(texts[r["doc_id"]].encode()))
        total[r["shard"]] += size
    assert set(total) == set(range(7))
    assert max(total.values()) - min(total.values()) <= 2 * max(len(t) + 8 for t in texts) + sum(map(len, texts)) / 7 / 8
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    whole = sum(total.values()) // (16 * 7)
    small = {t for t in texts if texts.count(t) * (len(t) + 8) <= whole}
    where = {}
    for r in got:
        if texts[r["doc_id"]] in small:
            where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_shards_of_awkward_rows(awkward, awkward_rows, empty):
    got = kdshards.kd_shards(awkward, shards=3).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in awkward_rows)
    assert {r["size"] for r in got if r["doc_id"] in (5, 6)} == {8}
    assert kdshards.kd_shards(empty, shards=3).count() == 0
    assert kdshards.kd_shards(awkward, target_bytes=1 << 30).agg(F.max("shard")).first()[0] == 0
    assert kdshards.shard_count(100, 30) == 4


def test_gradients_by_differences():
    model = langid.BiGru(["a", "b"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (7, 5)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    _, grads = model.step(x, y)
    for p, g in zip(model.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = model.step(x, y)[0]
        p[at] = old - 1e-2
        down = model.step(x, y)[0]
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_windows_cover_every_byte():
    texts = [b"", b"a", b"b" * langid.WINDOW, b"c" * (3 * langid.WINDOW + 5)]
    windows, owner, core = langid.cut_windows(texts)
    for k, t in enumerate(texts):
        got = b"".join(windows[j, langid.WARM : langid.WARM + core[j]].tobytes() for j in np.flatnonzero(owner == k))
        assert got == t


def language(rng, lang, n):
    words = {"aa": ["otho", "the", "ing", "thon"], "bb": ["zzu", "kek", "ukz", "zek"]}[lang]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def network():
    rng = random.Random(5)
    return langid.train([(language(rng, lang, 40), lang) for lang in ("aa", "bb") for _ in range(60)], steps=60)


def test_languages_are_told_apart(network):
    rng = random.Random(6)
    cases = [(language(rng, lang, n), lang) for lang in ("aa", "bb") for n in (3, 20, 300)]
    got = langid.predict_texts(network, [t for t, _ in cases])
    assert [g[0] for g in got] == [lang for _, lang in cases]
    assert all(0 <= g[1] <= 1 and abs(sum(g[2]) - 1) < 1e-6 for g in got)
    assert langid.predict_texts(network, [None, "", "12 .", "日本"])[:3] == [("und", 1.0, [0.0, 0.0])] * 3
    assert langid.train([]) is None


def test_batches_do_not_matter(network):
    rng = random.Random(7)
    texts = [language(rng, "aa", rng.randint(1, 200)) for _ in range(9)]
    together = langid.predict_texts(network, texts, block=4)
    alone = [langid.predict_texts(network, [t])[0] for t in texts]
    assert [g[0] for g in together] == [g[0] for g in alone]
    assert all(abs(a[1] - b[1]) < 1e-4 for a, b in zip(together, alone, strict=True))


def test_language_rows(awkward, awkward_rows, empty, network):
    got = {r["doc_id"]: r for r in langid.language_id(awkward).collect()}
    assert all(got[i]["lang_pred"] == "und" for i in (5, 6, 7, 12))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert langid.language_id(empty).count() == 0
    kept = langid.keep_identified(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in awkward_rows} - {5, 6, 7, 12}


def kt(a, b):
    p, zeros, ones = 1.0, 0, 0
    for bit in [0] * a + [1] * b:
        p *= ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
        zeros, ones = zeros + (not bit), ones + bit
    return p


def test_kt_by_definition():
    for a, b in [(0, 0), (1, 0), (3, 5), (40, 2)]:
        assert abs(ctw.log_kt(np.array([[float(a)]]), np.array([[float(b)]]))[0, 0] - math.log(kt(a, b))) < 1e-9


def decisions_of(symbol):
    """The decisions of a byte, or of the end (None), as text."""
    return "1" if symbol is None else "0" + format(symbol, "08b")


def weighted(seen, context, prefix, depth):
    """Pw of a node by its definition: seen are (context nearest first, symbol)."""
    here = [(c, s) for c, s in seen if c[: len(context)] == context and decisions_of(s).startswith(prefix) and len(decisions_of(s)) > len(prefix)]
    bits = [decisions_of(s)[len(prefix)] for _, s in here]
    own = kt(bits.count("0"), bits.count("1"))
    if depth == 0:
        return own
    product = 1.0
    for child in {c[len(context)] for c, _ in here}:
        product *= weighted(here, (*context, child), prefix, depth - 1)
    return (own + product) / 2


def pairs_of(texts):
    out = []
    for t in texts:
        data = [None] * ctw.DEPTH + list(t.encode().lower()) + [None]
        out += [(tuple(data[k - d] for d in range(1, ctw.DEPTH + 1)), data[k]) for k in range(ctw.DEPTH, len(data))]
    return out


def test_predictions_are_ratios_of_weighted_probabilities(spark):
    """Two held-out texts, one with a NUL byte, against the recursion's own prediction: what one more such decision would
    do to Pw at the root."""
    ids = range(60)
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    train = [i for i in ids if i not in held and zlib.crc32(str(i).encode()) % 7 != 2][:6]
    texts = dict(zip([*train, *held], ["abab abab", "abba", "Aab abab", "", "ababab", "b\0a", "abab abc", "ab\0\0"], strict=True))
    got = {r["doc_id"]: r["score"] for r in ctw.lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    seen = pairs_of([texts[i] for i in train])
    for i in [*held, train[0]]:
        want = 0.0
        for c, s in pairs_of([texts[i]]):
            bits = decisions_of(s)
            for k in range(len(bits)):
                want += math.log10(weighted([*seen, (c, s)], (), bits[:k], ctw.DEPTH) / weighted(seen, (), bits[:k], ctw.DEPTH))
        assert abs(got[i] - want) < 1e-3


def test_code_order_and_packing():
    rng = np.random.default_rng(3)
    codes, starts = ctw.codes_of([b"abc", b"", b"xyzxyzxyz"])
    assert len(codes) == 15 and list(starts) == [0, 4, 5]
    assert (codes[1] >> np.uint64(54)) == ord("a") + 1 and (codes[3] & np.uint64(511)) == 0
    some = np.unique(rng.integers(0, 1 << 62, 1000, dtype=np.uint64))
    assert (ctw.unpack_codes(ctw.pack_codes(some)) == some).all()
    for x in (np.arange(-5, 5, dtype=np.int16), rng.normal(size=9), np.array([], np.int32)):
        assert (ctw.unpack(ctw.pack(x), x.dtype) == x).all()


def test_base_score_by_hand(spark, awkward, awkward_rows, empty):
    got = ctw.lm_scores(awkward).collect()
    assert len(got) == len(awkward_rows)
    tokens = lambda t: (t or "").encode().lower().split()
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in awkward_rows}
    counts = Counter()
    for r in awkward_rows:
        if not held[r[0]]:
            counts.update([*tokens(r[1]), None])
    n, v, texts = sum(counts.values()), len(counts), {r[0]: r[1] for r in awkward_rows}
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in awkward_rows)
    for r in got:
        words = [*tokens(texts[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r["score"] < 0
    assert ctw.lm_scores(empty).count() == 0


def test_bundles_and_parts_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, language(rng, "aa" if k % 2 else "bb", 20)) for k in range(30)] + [(None, "x y"), (4, None)], "doc_id long, text string").repartition(3)
    rows = lambda: sorted((str(r["doc_id"]), round(r["score"], 3), round(r["base_score"], 6), r["n_known"]) for r in ctw.lm_scores(docs).collect())
    before = rows()
    monkeypatch.setattr(ctw, "BUNDLE_BYTES", 200)
    monkeypatch.setattr(ctw, "BLOB_BYTES", 100)
    monkeypatch.setattr(ctw, "WORK_BYTES", 50)
    monkeypatch.setattr(ctw, "LEAST_PARTS", 5)
    assert rows() == before
    named = docs.selectExpr("concat('k', doc_id) AS doc_id", "text")
    assert ctw.lm_scores(named).count() == 32


def test_groups_of_equal_texts_stay_whole(spark):
    """A group of most of a shard's share stays whole and the shards stay near equal; one above a share is dealt out."""
    rng = random.Random(4)
    big, huge = "b" * 1000, "h" * 4000
    rows = [(k, "".join(rng.choice("xyz") for _ in range(rng.randint(20, 60)))) for k in range(900)]
    rows += [(1000 + k, big) for k in range(6)] + [(2000 + k, huge) for k in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in kdshards.kd_shards(docs, shards=8).collect()}
    total = Counter()
    for r in got.values():
        total[r["shard"]] += r["size"]
    share = sum(total.values()) / 8
    assert 0.5 * share < 6 * 1008 < share < 10 * 4008
    assert len({got[1000 + k]["shard"] for k in range(6)}) == 1
    assert len({got[2000 + k]["shard"] for k in range(10)}) > 1
    assert max(total.values()) - min(total.values()) <= 0.8 * share and len(total) == 8


def test_shards_of_null_and_text_ids(spark):
    docs = spark.createDataFrame([(None, f"text {k % 7} " * (k % 3), None, None, None) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    got = kdshards.kd_shards(docs, shards=4).collect()
    assert len(got) == 60
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert kdshards.kd_shards(docs.selectExpr("'x' AS doc_id", "text", "lang", "source", "n_chars"), shards=3).count() == 60


def test_training_rows_are_bounded_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 10)
    docs = spark.range(400).selectExpr("CAST(7 AS BIGINT) AS doc_id", "concat('text ', id % 50) AS text", "'aa' AS lang")
    assert zlib.crc32(b"7") % 3 != 1
    assert len(langid.training_rows(docs)) <= 10
    named = langid.identify(docs.selectExpr("concat('k', doc_id) AS doc_id", "text"), None)
    assert dict(named.dtypes)["doc_id"] == "string" and named.count() == 400


def test_ctw_codes_are_ranked_run_by_run():
    rng = np.random.default_rng(5)
    runs = [rng.integers(0, 1 << 62, n, dtype=np.uint64) >> np.uint64(s) for n, s in ((0, 0), (1, 0), (5000, 54), (5000, 50), (64, 0))]
    codes, places = ctw.ranked(runs)
    want, where = np.unique(np.concatenate(runs), return_inverse=True)
    assert (codes == want).all() and (np.concatenate(places) == where).all() and [len(p) for p in places] == [len(r) for r in runs]
    order, part = ctw.dealt_order(codes, 7)
    assert (order == np.lexsort((codes, part))).all()
    assert len(ctw.ranked([])[0]) == 0
