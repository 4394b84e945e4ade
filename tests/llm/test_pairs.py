"""op3, op8 and op10: against all pairs by brute force."""

import collections
import itertools
import random

import numpy as np
import pytest

from factloom import session
from factloom.llm import chosenpath, decontaminate, multiindex
from factloom.operators import graph

from .conftest import prose


def groups_by_hand(ids, linked):
    """(least id of each id's component, number of linked others)."""
    head = {i: i for i in ids}
    while True:
        new = {i: min([head[i], *(head[j] for j in linked[i])]) for i in ids}
        if new == head:
            return head, {i: len(linked[i]) for i in ids}
        head = new


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_by_hand(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    linked = {i: set() for i in texts}
    for i, j in itertools.combinations(texts, 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
            linked[i].add(j)
            linked[j].add(i)
    return groups_by_hand(list(texts), linked)


def corpus(seed, n, shared):
    """Families of near copies with few and many edits, exact copies, and a passage that many texts share."""
    rng = random.Random(seed)
    passage, texts = prose(rng, 40), {}
    while len(texts) < n:
        words = prose(rng, rng.randint(3, 120)).split()
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            texts[len(texts)] = " ".join([passage, *w] if shared and rng.random() < 0.4 else w)
    return texts


def joined(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in chosenpath.jaccard_join(docs).collect()}


@pytest.mark.parametrize(("bucket", "block"), [(256, 2048), (4, 7)])
def test_links_and_classes(spark, monkeypatch, bucket, block):
    """Small buckets and blocks force splits, clumps and blocks, and change nothing."""
    monkeypatch.setattr(chosenpath, "BUCKET", bucket)
    monkeypatch.setattr(chosenpath, "BLOCK", block)
    texts = corpus(bucket, 150, True)
    got = joined(spark, texts)
    head, links = jaccard_by_hand(texts)
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (head[i], links[i]) for i in texts}
    assert all(r["kept"] == (r["class_id"] == i) for i, r in got.items())


def test_recall_on_many_texts(spark):
    """2,000 texts, many of them at similarities about the threshold, against all pairs by an inverted index."""
    texts = corpus(11, 2000, False)
    got = joined(spark, texts)
    sets = {i: shingle_set(t) for i, t in texts.items()}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    linked = {i: set() for i in texts}
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in holders[x] if j < i)
        for j, n in common.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                linked[i].add(j)
                linked[j].add(i)
    want = sum(map(len, linked.values()))
    found = sum(r["n_links"] for r in got.values())
    assert 0.99 * want <= found <= want and want > 500
    head, _ = groups_by_hand(list(texts), linked)
    assert np.mean([got[i]["class_id"] == head[i] for i in texts]) > 0.99


def test_one_row_of_each_class_is_kept(spark):
    """Repeated ids with one text, and rows without an id: one row each."""
    rows = [(1, "a b c d e f")] * 3 + [(None, "g h i j k l")] * 2 + [(None, "a b c d e f"), (7, "alone here now and then")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = chosenpath.jaccard_join(docs).collect()
    assert sum(r["kept"] for r in got) == 3
    assert sorted((r["class_rows"], r["n_links"]) for r in got) == [(1, 0)] + [(2, 1)] * 2 + [(4, 3)] * 4
    assert sorted(map(str, chosenpath.keep_one(docs).collect())) == sorted(map(str, docs.distinct().where("doc_id IS NOT NULL OR text LIKE 'g%'").collect()))
    assert chosenpath.jaccard_join(docs.selectExpr("concat('k', doc_id) AS doc_id", "text")).where("kept").count() == 3


def test_join_of_awkward_rows(awkward, awkward_rows, empty):
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in chosenpath.jaccard_join(awkward).collect()]
    assert len(got) == len(awkward_rows)
    classes = {i: c for i, c, _ in got}
    assert [classes[i] for i in (1, 2, 3, 13)] == [1, 1, 1, 1] and classes[4] == 4
    assert {classes[5], classes[6], classes[7]} == {5}  # texts without words are copies of each other
    assert {n for i, _, n in got if i in (1, 3, 13)} == {4}  # the repeated row counts
    kept = chosenpath.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in classes.values()})
    assert chosenpath.jaccard_join(empty).count() == 0


def sw_by_hand(item, passage):
    rows = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a == b else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_by_hand():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in "ab")
        score, first, last = decontaminate.smith_waterman(np.array(a), np.array(b))
        assert score == sw_by_hand(a, b)
        assert 0 <= first <= last <= len(b)
        assert sw_by_hand(a, b[first:last]) == score


def leaks_by_hand(docs, items):
    from factloom.llm.licenses import words_of

    out = set()
    for (i, t), (k, x) in itertools.product(docs, items):
        item, words = words_of(x), words_of(t)
        if item and words and sw_by_hand(item, words) / (2 * len(item)) >= decontaminate.THRESHOLD:
            out.add((i, k))
    return out


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_leaks_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(2)
    items = [(k, " ".join(f"{w}{rng.randrange(30)}" for w in prose(rng, 30).split())) for k in range(6)] + [(7, items_text := "only three words"), (8, None), (9, "")]
    docs = []
    for k in range(30):
        words = [f"{w}{rng.randrange(30)}" for w in prose(rng, 60).split()]
        if k % 2:
            item = items[k % 6][1].split()
            for _ in range(k % 5):
                item[rng.randrange(len(item))] = "edited"
            words[20:20] = item
        docs.append((k, " ".join(words)))
    docs += [(40, items_text.upper() + "!"), (41, None), (42, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(frame, bench).collect()}
    assert set(got) == leaks_by_hand(docs, items)
    assert all(0.5 <= r["similarity"] <= 1 and r["first_word"] < r["end_word"] for r in got.values())
    clean = decontaminate.drop_leaks(frame, bench)
    assert {r[0] for r in clean.select("doc_id").collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_edited_copies_without_or_beside_an_exact_one(spark):
    """Every fifth word replaced breaks most seeds: whether no other text holds them or one does, the copy is found."""
    rng = random.Random(6)
    items = [(k, " ".join(f"{w}{k}x{rng.randrange(30)}" for w in prose(rng, 40).split())) for k in range(4)] + [(9, "Äpfel ÜBER Öl ÉTÉ")]
    docs = [(k, " ".join("edited" if n % 5 == 4 else w for n, w in enumerate(t.split()))) for k, t in items[:4]]
    docs += [(10, items[0][1]), (11, items[1][1]), (12, "und äpfel über öl été dazu")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(frame, bench).collect()}
    assert set(got) == {*((k, k) for k in range(4)), (10, 0), (11, 1), (12, 9)}
    assert all(abs(got[k, k] - 0.7) < 0.02 for k in range(4)) and got[12, 9] == 1
    assert decontaminate.drop_leaks(frame, bench).count() == 0


def test_items_without_an_id_and_ids_of_text(spark):
    rng = random.Random(3)
    item = prose(rng, 30)
    docs = spark.createDataFrame([("a", prose(rng, 20) + " " + item), ("b", prose(rng, 50))], "doc_id string, text string")
    bench = spark.createDataFrame([(None, item), ("q", None)], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [("a", None)]
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()] == ["b"]


def test_leaks_of_awkward_rows(spark, awkward, awkward_rows, empty):
    bench = spark.createDataFrame([(1, awkward_rows[0][1]), (2, "short text")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(awkward, bench).collect())
    assert [g for g in got if g[0] in (1, 2, 3, 13)] == [(1, 1), (1, 1), (2, 1), (3, 1), (13, 1)] and (8, 2) in got
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(awkward, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(awkward, bench).columns == awkward.columns


def test_vectors_by_hand(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "RESIDENTS", 16)
    monkeypatch.setattr(multiindex, "VISITORS", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 16))
    for k in range(0, 120, 4):
        x[k + 1] = x[k] + 0.15 * rng.normal(size=16)
        x[k + 2] = x[k] * 3
    x[200:240] = x[200]
    x = x.astype(np.float32)
    rows = [(int(k), [float(c) for c in v], 0) for k, v in enumerate(x)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [1.0], 1), (305, [float("inf")] * 16, 1), (306, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: r for r in multiindex.near_duplicates(frame).collect()}
    unit = multiindex.unit(x)
    alike = unit @ unit.T >= 0.95
    linked = {i: {int(j) for j in np.flatnonzero(alike[i]) if j != i} for i in range(len(x))}
    head, links = groups_by_hand(range(len(x)), linked)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.99 * sum(links.values()) and all(got[i]["n_links"] <= links[i] for i in range(len(x)))
    assert sum(got[i]["component_id"] == head[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(300, 307))
    assert multiindex.near_duplicates(frame.limit(0)).count() == 0


def test_extreme_mixed_and_repeated_vectors(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e200, 2.0001e200]), (3, [1e-200, 5e-200]), (4, [5e-200, 1e-200]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.01]), (6, [1.0, 2.0, 3.01]), (None, [7.0, 0.0, 7.0]), (8, [5e-324, 0.0]), (9, [0.0, -0.0]), (10, [1e308, -1e308])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component string")
    got = multiindex.near_duplicates(frame).collect()
    told = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got))
    near = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    assert near([1, 2], [1, 5]) > 0.95 > near([1, 2], [5, 1])
    assert told == [(0, 0, 0, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 2, 5, True), (6, 2, 5, False), (6, 2, 5, False), (8, 1, 4, False), (9, 0, 9, True), (10, 0, 10, True)]
    assert {r["recall"] for r in got} == {1.0}


def test_rare_links_are_found_at_a_measured_recall(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 32))
    x[1::300] = x[::300] + 0.12 * rng.normal(size=(10, 32))
    frame = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = multiindex.near_duplicates(frame).collect()
    assert {r["vec_id"] for r in got if r["n_links"]} == {k for a in range(0, 3000, 300) for k in (a, a + 1)}
    assert all(r["recall"] >= multiindex.LEAST_RECALL for r in got)


def test_cells_are_calibrated_without_any_link(spark):
    """No vector has a neighbour; copies at the threshold must be met all the same, at the recall that is told."""
    rng = np.random.default_rng(8)
    x = multiindex.unit(rng.normal(size=(1500, 64)))
    assert (np.triu(x @ x.T, 1) < 0.95).all()
    index = multiindex.MultiIndex(x[:70, :32], x[70:140, 32:])
    nodes = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "node long, v array<double>")
    cells, recall = multiindex.calibrate(nodes, spark.sparkContext.broadcast(index), 0.95)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    near = 0.95 * x + (1 - 0.95**2) ** 0.5 * multiindex.unit(side)
    d, e = index.halves(x), index.halves(near)
    met = np.minimum(index.rank(*d, index.home(*e)), index.rank(*e, index.home(*d)))
    assert (met < multiindex.MIN_VISITS).mean() < 0.97 and (met < cells).mean() > 0.98 and recall >= multiindex.TARGET_RECALL


def test_cells_go_on_until_the_recall_is_met(spark):
    """A grid so fine that links lie thousands of cells apart: more than 512 cells are needed, and are visited."""
    rng = np.random.default_rng(9)
    x = multiindex.unit(rng.normal(size=(400, 2)))
    line = np.linspace(-1, 1, 200)[:, None]
    index = multiindex.MultiIndex(line, line)
    nodes = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "node long, v array<double>")
    cells, recall = multiindex.calibrate(nodes, spark.sparkContext.broadcast(index), 0.95)
    assert 512 < cells <= 200 * 200 and recall >= multiindex.TARGET_RECALL
    d1, d2 = index.halves(x[:20])
    assert index.visit(d1, d2, cells).shape == (20, cells)


def test_traversal_order():
    rng = np.random.default_rng(4)
    index = multiindex.MultiIndex(rng.normal(size=(7, 2)), rng.normal(size=(5, 3)))
    d1, d2 = index.halves(rng.normal(size=(9, 5)))
    whole = (d1[:, :, None] + d2[:, None, :]).reshape(9, -1)
    for cells in (1, 6, 35):
        got = index.visit(d1, d2, cells)
        assert np.allclose(np.take_along_axis(whole, got, 1), np.sort(whole, axis=1)[:, :cells])
        assert (index.rank(d1, d2, got[:, -1]) == cells - 1).all()


def test_words_are_not_kept_between_tasks(awkward_rows):
    def words_kept():
        return sum(len(v) for v in vars(chosenpath).values() if isinstance(v, dict) and "changed" in v)

    memo: dict[str, int] = {}
    texts = [r[1] for r in awkward_rows]
    plain, shared = [chosenpath.shingles(t) for t in texts], [chosenpath.shingles(t, memo=memo) for t in texts]
    assert all((a == b).all() for a, b in zip(plain, shared, strict=True)) and "changed" in memo
    assert words_kept() == 0


def test_files_of_a_join_follow_its_rows(spark, monkeypatch):
    """Few rows are written in few files, however many shuffle partitions there are; in many small files, with the same result."""
    held, parts = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, []

    def counted(*given, **named):
        parts.append((out := session.cut(*given, **named)).rdd.getNumPartitions())
        return out

    before = {k: spark.conf.get(k) for k in held}
    for module in (chosenpath, graph):
        monkeypatch.setattr(module, "cut", counted)
    texts = corpus(5, 120, True)
    head, links = jaccard_by_hand(texts)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for rows in (1 << 14, 50):
            monkeypatch.setattr(session, "FILE_ROWS", rows, raising=False)
            parts.clear()
            got = joined(spark, texts)
            assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (head[i], links[i]) for i in texts}
            assert len(parts) > 12 and (rows == 50 or sum(parts) <= 4 * 40 + len(parts))
        assert sum(parts) > 4 * 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
