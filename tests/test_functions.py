"""Scalar functions against the behaviour their docstrings state."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import names, templates


@pytest.mark.parametrize(("path", "bare"), [("Queue<T, fn(K) -> V>::pop", "Queue::pop"), ("io::Ring::<4>::tick", "io::Ring::tick"), ("word", "word"), ("fn() -> Y", "fn() -> Y"), ("", ""), ("x::Y<open", "x::Y"), ("x>::y", "x::y")])
def test_bare_path(path, bare):
    assert names.bare_path(path) == bare


@pytest.mark.parametrize(("name", "item"), [("zoo::feed::<zoo::Cat>", "zoo::feed"), ("<Cat as Pet>::hug::<u8>::{closure#2}", "<Cat as Pet>::hug::{closure#2}"), ("q::<W<E>>::r::<T>", "q::r"), ("<Cat<q::<W>> as Pet>::hug", "<Cat<q> as Pet>::hug"), ("plain", "plain")])
def test_generic_item(name, item):
    assert names.generic_item(name) == item


@pytest.mark.parametrize(("path", "method"), [("<Die<Six> as Into<Cup<Die>>>::into", "Die::into"), ("<Die>::m", "::m"), ("<fn(A) -> B as Call<A>>::call", "fn(A) -> B::call"), ("io::Cup<Die>::put", "io::Cup::put")])
def test_method_by_type(path, method):
    assert names.method_by_type(path) == method


def test_type_numbers_and_bindings():
    bits = lambda *bs: "typenum::uint::UTerm" if not bs else f"typenum::uint::UInt<{bits(*bs[:-1])}, typenum::bit::B{bs[-1]}>"
    for n in (0, 1, 5, 12):
        assert names.folded_integers(f"Buf<{bits(*map(int, format(n, 'b')) if n else ())}, u8>") == f"Buf<typenum::U{n}, u8>"
    assert names.folded_integers("a -> B<C>") == "a -> B<C>"
    assert names.sorted_bindings("dyn Flow<In, Out = u8, Err = E<Y = 2, X = 1>>") == "dyn Flow<In, Err = E<X = 1, Y = 2>, Out = u8>"
    assert names.sorted_bindings("f<(B = 1, A), K = fn(x, y<Z = 1, W = 2>) -> q>") == "f<(B = 1, A), K = fn(x, y<W = 2, Z = 1>) -> q>"


FULL, USUAL = "AES-{key}-GCM[-{tag}-{nonce}]", {"tag": "128", "nonce": "96"}


@pytest.mark.parametrize(
    ("template", "values", "defaults", "name"),
    [
        ("AES-{key}-GCM", {}, {}, "AES-GCM"),
        ("P-{hash}-{n}-{len}", {"hash": "SHA-256", "len": "32"}, {}, "P-SHA-256"),
        (FULL, {"key": "256", "tag": "128", "nonce": "96"}, USUAL, "AES-256-GCM"),
        (FULL, {"key": "256", "tag": "128", "nonce": "128"}, USUAL, "AES-256-GCM-128-128"),
        (FULL, {"key": "256", "tag": "128"}, USUAL, "AES-256-GCM"),
        ("O-{h}[-MGF1-{m}]", {"h": "SHA-256", "m": "SHA-256"}, {"m": "{h}"}, "O-SHA-256"),
        ("O-{h}[-MGF1-{m}]", {"h": "SHA-256", "m": "SHA-1"}, {"m": "{h}"}, "O-SHA-256-MGF1-SHA-1"),
    ],
)
def test_templates(template, values, defaults, name):
    assert templates.filled(template, values, defaults) == name


@pytest.mark.parametrize(("range_", "version", "inside"), [(">=0.9, <0.11", "0.10.0", True), (">=0.9, <0.11", "0.10.0-rc.18", True), (">=0.9, <0.11", "0.11.0-rc.1", False), (">=0.9, <0.11", "0.8.9", False), ("1.2", "1.9.0", True), ("1.2", "2.0.0", False), ("0.3", "0.4.0", False), ("~1.2.3", "1.2.9", True), ("~1.2.3", "1.3.0", False), ("=1.2", "1.2.7", True), ("*", "9.1.0", True), ("<=1.2", "1.2.9", True), (">1.2", "1.2.9", False), ("1", "no", False)])
def test_versions(range_, version, inside):
    assert templates.covers(range_, version) is inside


def test_grammar():
    g = templates.NameGrammar(["SHA-(224|256)", "HMAC[-{algorithm}][-{number}]", "OAEP[-{algorithm}[-{maskgen}]]", "ECDSA[-{curve}]"], ["P-256"])
    good = ["SHA-256", "HMAC-SHA-256-128", "HMAC", "OAEP-SHA-256-MGF1-SHA-224", "OAEP-SHA-256-MGF1", "ECDSA-P-256"]
    bad = ["SHA-1", "ECDSA-X", "HMAC-", "OAEP-MGF1", ""]
    assert [g.valid(n) for n in good + bad] == [True] * len(good) + [False] * len(bad)


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=40))
def test_fnv_by_definition(data):
    h = templates.FNV_OFFSET
    for b in data:
        h = ((h ^ b) * templates.FNV_PRIME) % 2**128
    assert templates.fnv128(data) == h


def test_columns(spark):
    rows = spark.createDataFrame([("/a/./b/../c", "rust-aes-gcm", "x::f::{closure#0}::{closure#1}", "A b_c"), ("../x/..", "sha2", "x::f", ""), (None, None, None, None)], "p string, k string, f string, l string")
    got = rows.select(names.normal_path(F.col("p")).alias("p"), names.names_algorithm(F.col("k"), ["aes", "sha2"]).alias("k"), names.enclosing_function(F.col("f")).alias("f"), names.normal_label(F.col("l")).alias("l"), names.strip_generics("f").alias("g")).collect()
    assert [tuple(r) for r in got] == [("/a/c", True, "x::f", "ABC", "x::f::{closure#0}::{closure#1}"), ("..", True, "x::f", "", "x::f"), (None, None, None, None, None)]
    text = spark.createDataFrame([("ab\ncdé f", 6)], "t string, n int").select(names.line_of(F.col("t"), F.col("n")), names.column_of(F.col("t"), F.col("n"))).first()
    assert tuple(text) == (2, 3)
    said = spark.createDataFrame([("algorithm one of 3 that may reach the call: X in the arguments", 1), ("algorithm from X in the arguments", 2), ("algorithm one of 3 that may reach the call from other functions: X", 1), ("other", 5)], "s string, n int")
    assert [r[0] for r in said.select(names.renumbered(F.col("s"), F.col("n"))).collect()] == ["algorithm from X in the arguments", "algorithm one of 2 that may reach the call: X in the arguments", "algorithm from X, reaching the call from another function", "other"]
    keyed = spark.createDataFrame([("1.2.0",), ("1.10.0",), ("1.10.0-rc.2",), ("1.10.0-rc.10",)], "v string").orderBy(templates.semver_key("v")).collect()
    assert [r[0] for r in keyed] == ["1.2.0", "1.10.0-rc.2", "1.10.0-rc.10", "1.10.0"]
