"""Functions on item paths and type texts. Balanced nesting is not regular, so these are pandas UDFs over plain
Python functions; everything regular stays a built-in column expression."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Group(list):
    """The parts between a `<` and its `>`: texts and groups. A group at the end of a text may lack its `>`."""

    closed = False

    def __str__(self) -> str:
        return "<" + "".join(map(str, self)) + (">" if self.closed else "")


def parsed(text: str) -> Group:
    """A text as parts outside angle brackets and groups inside them, the one parser of all functions below. An arrow
    is text, and a `>` that closes nothing is a part of its own."""
    open_groups = [Group()]
    for token in re.split("(->|[<>])", text):
        if token == "<":
            open_groups.append(Group())
            open_groups[-2].append(open_groups[-1])
        elif token == ">" and len(open_groups) > 1:
            open_groups.pop().closed = True
        elif token:
            open_groups[-1].append(token)
    return open_groups[0]


def _outside(parts: list) -> str:
    """What stands outside groups, path separators that meet there as one."""
    return "".join(p for p in parts if isinstance(p, str) and p != ">").replace("::::", "::")


def bare_path(path: str) -> str:
    """The path without its <..> groups: `a::B<C>::d` is `a::B::d`."""
    return _outside(parsed(path))


def _without_turbofish(parts: list) -> str:
    out = ""
    for part in parts:
        if not isinstance(part, Group):
            out += part
        elif out.endswith("::"):
            out = out[:-2]
        else:
            out += "<" + _without_turbofish(part) + (">" if part.closed else "")
    return out


def generic_item(name: str) -> str:
    """The item that an instance's name names: `::<..>` groups go, `<A as T>` stays."""
    return _without_turbofish(parsed(name))


def method_by_type(path: str) -> str:
    """`<T as Trait>::m` is `T::m`, without generic arguments; other paths just lose those."""
    parts = parsed(path)
    if len(parts) > 1 and isinstance(parts[0], Group) and parts[0].closed and str(parts[1]).startswith("::"):
        for k, part in enumerate(parts[0]):
            if isinstance(part, str) and " as " in part:
                owner = [*parts[0][:k], part.partition(" as ")[0]]
                return _outside(owner) + "::" + _outside([parts[1][2:], *parts[2:]])
    return _outside(parts)


# The names of type-level binary numbers.
BITS, END, NUMBER = "typenum::uint::UInt", "typenum::uint::UTerm", "typenum::U"
_NUMBER_AND_BIT = re.compile(r"typenum::U(\d+), typenum::bit::B([01])")


def _folded(parts: list) -> str:
    out = ""
    for part in parts:
        if isinstance(part, str):
            out += part.replace(END, NUMBER + "0")
            continue
        inside = _folded(part)
        bit = _NUMBER_AND_BIT.fullmatch(inside) if part.closed and out.endswith(BITS) else None
        out = f"{out[: -len(BITS)]}{NUMBER}{2 * int(bit[1]) + int(bit[2])}" if bit else out + "<" + inside + (">" if part.closed else "")
    return out


def folded_integers(text: str) -> str:
    """Nested type-level binary numbers by their values: `UInt<UInt<UTerm, B1>, B0>` is `U2`."""
    return _folded(parsed(text)) if "typenum::" in text else text


def _with_sorted_bindings(parts: list) -> str:
    out = ""
    for part in parts:
        if not isinstance(part, Group):
            out += part
        elif not part.closed:
            out += str(part)
        else:
            arguments, depth = [""], 0
            for piece in part:
                if isinstance(piece, Group):
                    arguments[-1] += _with_sorted_bindings([piece])
                    continue
                for c in piece:
                    depth += (c in "([{") - (c in ")]}")
                    if c == "," and depth == 0:
                        arguments.append("")
                    else:
                        arguments[-1] += c
            arguments = [a.strip() for a in arguments]
            named = [re.match(r"\w+ = ", a) is not None for a in arguments]
            first = named.index(True) if True in named else len(arguments)
            if all(named[first:]):
                arguments = arguments[:first] + sorted(arguments[first:])
            out += "<" + ", ".join(arguments) + ">"
    return out


def sorted_bindings(text: str) -> str:
    """Trailing `Name = type` bindings of every argument list in order, inside out."""
    return _with_sorted_bindings(parsed(text))


def _udf(f):
    @F.pandas_udf(T.StringType())
    def mapped(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return mapped


strip_generics = _udf(bare_path)
instance_base = _udf(generic_item)
by_type = _udf(method_by_type)
typenum_folded = _udf(folded_integers)
canonical = _udf(sorted_bindings)


def enclosing_function(path: Column) -> Column:
    """A closure's function; other paths as they are."""
    return F.regexp_replace(path, r"::\{closure.*$", "")


def normal_label(label: Column) -> Column:
    return F.upper(F.regexp_replace(label, r"[\s_]", ""))


def asset_key(name: Column, primitive: Column, material: Column) -> Column:
    """Key material is one asset whatever it is used for; other names are one asset a primitive."""
    return F.when(material.isNotNull(), F.concat(name, F.lit("||"), material)).otherwise(F.concat(name, F.lit("|"), primitive, F.lit("|")))


def names_algorithm(package: Column, words: list[str]) -> Column:
    """Does a package's name, without its language affix, begin with or spell a word of the list?"""
    lower = F.lower(package)
    unprefixed = F.regexp_replace(lower, "^(rust|rs)[-_]", "")
    core = F.when(unprefixed != lower, unprefixed).otherwise(F.regexp_replace(lower, "[-_](rs|rust)$", ""))
    return F.regexp_extract(core, "^([^-_]*)", 1).isin(words) | F.regexp_replace(core, "[^a-z0-9]", "").isin(words)


def typenum_value(bits: Column) -> Column:
    """The number of an array of bits, highest first."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc * 2 + b)


def normal_path(path: Column) -> Column:
    """The path without `.` and `dir/..` parts."""
    parts = F.split(path, "/", -1)
    start = F.array().cast("array<string>")
    absolute = path.startswith("/")

    def add(acc, p):
        last = F.element_at(acc, -1)
        folds = (p == "..") & (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last).otherwise("..") != "..")
        return F.when((p == ".") | (p == ""), acc).when(folds, F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(p)))

    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(parts, start, add), "/"))


def line_of(text: Column, characters: Column) -> Column:
    """1-based line of the position after so many characters."""
    before = F.substring(text, F.lit(1), characters)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def column_of(text: Column, characters: Column) -> Column:
    """0-based column of the position after so many characters."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), characters), "\n", -1)).cast("long")


def context_text(*parts: Column) -> Column:
    """The parts that are there, joined."""
    return F.array_join(F.array_compact(F.array(*parts)), "; ")


def renumbered(sentence: Column, n: Column) -> Column:
    """The sentence of a member of a set for a set of n members."""
    # The sentences.
    one_of = r"^algorithm one of \d+ (that .*)$"
    lone_args = r"^algorithm one of \d+ that may reach the call: ((?:(?!, ).)* in the arguments)$"
    lone_far = r"^algorithm one of \d+ that may reach the call from other functions: ((?:(?!, ).)*)$"
    from_args = r"^algorithm from (.*) in the arguments$"
    from_far = r"^algorithm from (.*), reaching the call from another function$"
    many = F.concat(F.lit("algorithm one of "), n.cast("string"), F.lit(" "))
    return (
        F.when(sentence.rlike(one_of) & (n > 1), F.concat(many, F.regexp_extract(sentence, one_of, 1)))
        .when(sentence.rlike(lone_args), F.concat(F.lit("algorithm from "), F.regexp_extract(sentence, lone_args, 1)))
        .when(sentence.rlike(lone_far), F.concat(F.lit("algorithm from "), F.regexp_extract(sentence, lone_far, 1), F.lit(", reaching the call from another function")))
        .when((n > 1) & sentence.rlike(from_args), F.concat(many, F.lit("that may reach the call: "), F.regexp_extract(sentence, from_args, 1), F.lit(" in the arguments")))
        .when((n > 1) & sentence.rlike(from_far), F.concat(many, F.lit("that may reach the call from other functions: "), F.regexp_extract(sentence, from_far, 1)))
        .otherwise(sentence)
    )
