"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser
evaluates the and/or/with expression that follows a tag.

Each text is read once, map-side, with no shuffle: the plan is a scan and one Python stage, whatever the keys' skew.

Cases: a null or empty text has no words, null first and last word, empty labels and score 0. Very long texts are
scanned whole. Prose behind a tag's expression, on its line, is not part of it. Repeated rows are scanned as separate rows. An empty table gives an empty result. Only the id and
text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from factloom.llm.common import map_texts, pick, utf8

# The base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Further notice phrases, their labels and how sure a match makes us.
NOTICE_PHRASES = {
    "apache license": ("apache", 0.7),
    "apache license version 2 0": ("apache-2.0", 0.95),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "this is free and unencumbered software": ("unlicense", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "public domain": ("public-domain", 0.5),
}
# How sure the base phrases make us.
BASE_WEIGHT = {"cc-by": 0.8, "gpl": 0.8, "reserved": 0.6}
TAG = "spdx license identifier"
TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([a-z0-9.+\-() \t]*)")
# How freely a licence lets one reuse a text, 0 (not at all) to 3 (freely).
FREEDOM = {"mit": 3, "isc": 3, "0bsd": 3, "cc0-1.0": 3, "unlicense": 3, "apache-2.0": 3, "bsd-2-clause": 3, "bsd-3-clause": 3, "mpl-2.0": 2, "lgpl-2.1": 2, "lgpl-3.0": 2, "cc-by-4.0": 3, "cc-by-sa-4.0": 2, "gpl-2.0": 1, "gpl-3.0": 1, "agpl-3.0": 1}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: Every byte to the byte that stands for it in a word, or to a space where it ends one.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, freedom int"


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return utf8(text).translate(WORD_BYTES).split()


def tag_expression(line: str) -> str | None:
    """The longest start of a tag's line that is an expression, as prose may follow it; None if there is none. Behind
    the first name, words are names only if they look like a licence's: known, or with a digit or hyphen."""
    tokens = [t.rstrip(".") or t for t in re.findall(r"[()]|[a-z0-9.+\-]+", line.lower())]
    best, seen = None, False
    for k, t in enumerate(tokens):
        if t not in PRECEDENCE and t not in "()":
            if seen and not (t in FREEDOM or re.search(r"[0-9-]", t)):
                break
            seen = True
        start = " ".join(tokens[: k + 1])
        if to_postfix(start):
            best = start
    return best


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: an and/or/with expression in postfix order; None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in re.findall(r"[()]|[a-z0-9.+\-]+", expression.lower()):
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[frozenset[str], int]:
    """Licence names of an expression, and its freedom: `and` binds to the strictest part, `or` lets one choose the
    freest, and `with` (an exception) frees a licence by one step. An unknown name has freedom 0."""
    stack: list[tuple[frozenset[str], int]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            name = re.sub(r"(-only|-or-later|\+)$", "", token)
            stack.append((frozenset([token]), FREEDOM.get(name, 0)))
            continue
        (right, r), (left, x) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, min(3, x + 1)))
        else:
            stack.append((left | right, min(x, r) if token == "and" else max(x, r)))
    return stack[0]


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Matches whole words: each phrase stands between spaces. Values are (phrase, length with both spaces)."""
    machine = ahocorasick.Automaton()
    for phrase in phrases:
        padded = f" {phrase} "
        machine.add_word(padded, (phrase, len(padded)))
    machine.make_automaton()
    return machine


def scan_text(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """One row of SCHEMA."""
    words = words_of(text)
    if not words:
        return 0, 0, None, None, "", "", 0.0, None, None
    joined = b" " + b" ".join(words) + b" "
    n_base, starts, base, labels, doubt, tagged = 0, [], set(), set(), 1.0, False
    at = counted = 0
    ends = list(machine.iter(joined.decode("latin-1")))
    for end, (phrase, length) in sorted((e - v[1] + 1, v) for e, v in ends):
        if phrase in BASE_PHRASES:
            counted += joined.count(b" ", at, end)
            at = end
            n_base += 1
            starts.append(counted)
            base.add(BASE_PHRASES[phrase])
        if phrase in NOTICE_PHRASES:
            label, weight = NOTICE_PHRASES[phrase]
            if label not in labels:
                doubt *= 1 - weight
            labels.add(label)
        tagged |= phrase == TAG
    for label in base:
        doubt *= 1 - BASE_WEIGHT[label]
    expression = freedom = None
    if tagged:
        for found in TAG_LINE.findall(utf8(text).lower()):
            line = tag_expression(found.decode())
            if line:
                postfix = to_postfix(line)
                names, free = evaluate(postfix)
                labels |= names
                doubt *= 0.01
                if freedom is None or free < freedom:
                    expression, freedom = " ".join(postfix), free
    labels |= base
    return len(words), n_base, starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt if labels else 0.0, expression, freedom


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of SCHEMA for each row of docs."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def make():
        machine = automaton([*BASE_PHRASES, *NOTICE_PHRASES, TAG])
        return lambda texts: dict(zip(names, zip(*[scan_text(t, machine) for t in texts], strict=True), strict=True))

    return map_texts(pick(docs, doc_id=id_col, text=text_col), ["doc_id"], SCHEMA, make)
