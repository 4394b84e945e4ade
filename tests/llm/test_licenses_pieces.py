"""op6 and op4: against brute force over words, and exact round trips."""

import gc
import math
import os
import random
import re
import sys
import types
import weakref

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import common, licenses, pieces
from factloom.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(k, label) for k in range(len(words)) for phrase, label in licenses.BASE_PHRASES.items() if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["cc", "by", "CC-BY", "general", "public", "license", "all", "Rights reserved", "x", "é", "1", ".", "\n", "K", "SPDX-License-Identifier: MIT"]), max_size=25).map(" ".join))
def test_base_by_hand(text):
    machine = licenses.automaton([*licenses.BASE_PHRASES, *licenses.NOTICE_PHRASES, licenses.TAG])
    got = licenses.scan_text(text, machine)
    assert got[:5] == by_hand(text)
    assert set(got[4].split(",")) - {""} <= set(got[5].split(","))
    assert 0 <= got[6] <= 1


@pytest.mark.parametrize(("expression", "names", "freedom"), [("MIT", {"mit"}, 3), ("MIT AND GPL-2.0", {"mit", "gpl-2.0"}, 1), ("MIT OR GPL-2.0", {"mit", "gpl-2.0"}, 3), ("GPL-2.0 WITH x", {"gpl-2.0"}, 2), ("MIT OR GPL-2.0 AND AGPL-3.0", {"mit", "gpl-2.0", "agpl-3.0"}, 3), ("(MIT OR GPL-2.0) AND AGPL-3.0", {"mit", "gpl-2.0", "agpl-3.0"}, 1)])
def test_expressions(expression, names, freedom):
    assert licenses.evaluate(licenses.to_postfix(expression)) == (frozenset(names), freedom)


@pytest.mark.parametrize("bad", ["", "AND", "MIT AND", "(MIT", "MIT)", "MIT MIT", "MIT (ISC)", "OR MIT"])
def test_malformed_expressions(bad):
    assert licenses.to_postfix(bad) is None


@pytest.mark.parametrize(("line", "expression"), [("MIT OR Apache-2.0 this file is free", "mit or apache-2.0"), ("MIT.", "mit"), ("MIT and this file", "mit"), ("(MIT OR ISC) AND GPL-2.0 or so", "( mit or isc ) and gpl-2.0"), ("AND", None), ("", None), ("x", "x"), ("GPL-2.0 WITH Classpath-exception-2.0", "gpl-2.0 with classpath-exception-2.0")])
def test_tags_before_prose(line, expression):
    assert licenses.tag_expression(line) == expression
    if expression:
        machine = licenses.automaton([*licenses.BASE_PHRASES, *licenses.NOTICE_PHRASES, licenses.TAG])
        labels = licenses.scan_text(f"SPDX-License-Identifier: {line}\nmore", machine)[5].split(",")
        assert set(re.findall(r"[a-z0-9.-]+", re.sub(r"with \S+", "", expression))) - {"or", "and"} == set(labels)


def test_license_rows(awkward, awkward_rows, empty):
    got = sorted((tuple(r)[:6] for r in licenses.scan_licenses(awkward).collect()), key=str)
    assert got == sorted(((r[0], *by_hand(r[1])) for r in awkward_rows), key=str)
    assert licenses.scan_licenses(empty).count() == 0


needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="the public vocabulary is not here")


@pytest.fixture(scope="module")
def model():
    return pieces.Unigram(*pieces.read_vocabulary(MODEL))


def exhaustive(model, text):
    """The best score over all segmentations, with a plain dictionary."""
    data = text.encode()
    scores = {p: s for p, s in zip(model.pieces, model.scores, strict=True) if p}
    longest = max(map(len, scores))
    best = [0.0] + [float("-inf")] * len(data)
    for i in range(len(data)):
        if best[i] > float("-inf") and data[i] & 0xC0 != 0x80:
            step = next((k for k in range(1, 5) if i + k == len(data) or data[i + k] & 0xC0 != 0x80), 1)
            best[i + step] = max(best[i + step], best[i] + model.fallback * step)
            for j in range(i + 1, min(len(data), i + longest) + 1):
                if data[i:j] in scores:
                    best[j] = max(best[j], best[i] + scores[data[i:j]])
    return best[-1]


@needs_model
def test_best_path_is_best(model):
    rng = random.Random(1)
    for text in ["Hello  world", "the quick brown fox", "aé日\n x", "    ", "under_score 12345"] + ["".join(rng.choice("abe th\n") for _ in range(30)) for _ in range(20)]:
        ids, score, _ = model.encode(text)
        assert abs(score - exhaustive(model, "▁" + text.replace(" ", "▁"))) < 1e-6, text
        assert abs(score - sum(model.scores[i] if model.scores[i] > float("-inf") else model.fallback for i in ids)) < 1e-6


@needs_model
@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    m = test_round_trip.model = getattr(test_round_trip, "model", None) or pieces.Unigram(*pieces.read_vocabulary(MODEL))
    assert m.decode(m.encode(text)[0]) == text


@needs_model
def test_memo_generations_change_nothing(model, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c") for _ in range(50)) for _ in range(50)]
    before = [model.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "MEMO_CHUNKS", 3)
    model.memo, model.older = {}, {}
    assert [model.encode(t) for t in texts] == before


@needs_model
def test_remembered_chunks_are_small(model, monkeypatch):
    monkeypatch.setattr(model, "memo", {})
    monkeypatch.setattr(model, "older", {})
    rng = random.Random(3)
    model.encode(" ".join("".join(rng.choice("etaoinshr") for _ in range(8)) for _ in range(2000)))

    def size(x):
        return sys.getsizeof(x) + (sum(map(size, x)) if isinstance(x, tuple) else 0) if not isinstance(x, int) else 0

    assert len(model.memo) > 1900
    assert sum(size(k) + size(v) for k, v in model.memo.items()) / len(model.memo) < 190


def test_worker_keeps_nothing_for_other_stages():
    """What a worker keeps for encoding stays between its tasks and goes when it does something else."""

    class Frame:
        schema = None

        def mapInArrow(self, run, schema):
            return lambda: [b.num_rows for b in run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a"]})]))]

    vocabulary = types.SimpleNamespace(value=([b"a", *[b""] * 256], [-1.0, *[-math.inf] * 256], list(range(1, 257)), 7))
    left = weakref.ref(pieces._shared(vocabulary))
    gc.collect()
    assert left() is pieces._shared(vocabulary)
    assert common.filter_texts(Frame(), lambda: lambda texts: [True for _ in texts])() == [1]
    gc.collect()
    assert left() is None


@needs_model
def test_piece_rows(awkward, awkward_rows, empty):
    got = pieces.round_trip(awkward, MODEL).collect()
    assert len(got) == len(awkward_rows) and all(r["decodes"] for r in got)
    assert {r["n_pieces"] for r in got if r["doc_id"] in (5, 6)} == {0}
    back = pieces.decode(pieces.encode(awkward, MODEL), MODEL).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((r[0], r[1] or "") for r in awkward_rows)
    assert pieces.round_trip(empty, MODEL).count() == 0


@needs_model
def test_double_array_is_the_dictionary():
    rng = random.Random(4)
    keys = sorted({bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    trie = pieces.DoubleArray.build([(k, n) for n, k in enumerate(keys)])
    for key in keys:
        node = 0
        for b in key:
            child = trie.base[node] + b
            assert trie.check[child] == node
            node = child
        assert trie.value[node] == keys.index(key)
