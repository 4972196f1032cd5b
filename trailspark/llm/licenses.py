"""Licence scans: Aho-Corasick over the words, a shunting-yard for licence expressions.

One automaton holds all notice phrases and the identifier tag and runs once over the words of
a text, joined by single spaces. Where it finds the identifier tag, the licence expression
behind the tag in the raw line is parsed by a shunting-yard and evaluated: `or` takes the less
restricting side, `and` the more restricting one, `with` an exception lowers the restriction.

Defined cases: null and empty texts have no words, no labels and score 0; a text of any length
is scanned whole; a phrase counts at each place, overlaps included; an expression that does not
parse labels `unparsed` and scores as an unknown licence; equal rows give equal rows; an empty
table gives no rows; other columns are passed through.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from trailspark.llm.batches import map_rows

#: The base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Phrases of notices; words as the scan sees them, so punctuation is gone.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "creative commons": "cc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "isc license": "isc",
    "eclipse public license": "epl",
    "without express written permission": "proprietary",
    "do not distribute": "proprietary",
}
TAG = "spdx license identifier"
#: How much each licence restricts reuse, from 0 (not at all) to 1 (all rights reserved).
RESTRICTION = {
    "cc0": 0.05, "public-domain": 0.05, "unlicense": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1,
    "apache": 0.15, "cc": 0.3, "cc-by": 0.2, "cc-by-sa": 0.5, "mpl": 0.5, "epl": 0.5,
    "lgpl": 0.6, "cc-by-nc": 0.8, "cc-by-nd": 0.8, "gpl": 0.8, "agpl": 0.9,
    "proprietary": 1.0, "reserved": 1.0,
}
UNKNOWN = 0.5
EXCEPTION_FACTOR = 0.75

_TO_WORDS = bytes.maketrans(
    bytes(c for c in range(128) if not chr(c).isalnum()) + bytes(range(65, 91)),
    b" " * sum(not chr(c).isalnum() for c in range(128)) + bytes(range(97, 123)),
)
_EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def licence_family(identifier: str) -> str:
    """The family of a licence identifier: `GPL-2.0-or-later` is `gpl`."""
    name = identifier.lower().rstrip("+")
    families = sorted(RESTRICTION, key=len, reverse=True)
    return next((f for f in families if name == f or name.startswith((f + "-", f + "."))), name)


def parse_expression(expression: str) -> list[str] | None:
    """Reverse Polish notation by the shunting-yard, None if the expression does not parse."""
    output, operators, expects_name = [], [], True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _PRECEDENCE:
            if expects_name:
                return None
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[word]:
                output.append(operators.pop())
            operators.append(word)
            expects_name = True
        elif token == "(":
            if not expects_name:
                return None
            operators.append(token)
        elif token == ")":
            if expects_name:
                return None
            while operators and operators[-1] != "(":
                output.append(operators.pop())
            if not operators:
                return None
            operators.pop()
        else:
            if not expects_name:
                break  # what follows a whole expression on the line is a comment
            output.append(token)
            expects_name = False
    if expects_name or "(" in operators:
        return None
    return output + operators[::-1]


def evaluate(notation: list[str]) -> tuple[float, set[str]]:
    """(restriction, families of licences) of an expression in reverse Polish notation."""
    stack: list[tuple[float, set[str]]] = []
    for token in notation:
        if token.lower() not in _PRECEDENCE:
            family = licence_family(token)
            stack.append((RESTRICTION.get(family, UNKNOWN), {family}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token.lower() == "with":
            stack.append((a * EXCEPTION_FACTOR, left))
        else:
            stack.append(((min if token.lower() == "or" else max)(a, b), left | right))
    return stack[0]


def words_text(text: str) -> str:
    """The lower-cased words, joined by single spaces, with a space at both ends."""
    words = text.encode().translate(_TO_WORDS).split()
    return f" {b' '.join(words).decode()} " if words else ""


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    entries = {p: [False, label] for p, label in NOTICE_PHRASES.items()}
    entries |= {p: [True, label] for p, label in BASE_PHRASES.items()}
    entries[TAG] = [False, None]
    for phrase, (base, label) in entries.items():
        needle = f" {phrase} "
        automaton.add_word(needle, (len(needle), base, label))
    automaton.make_automaton()
    return automaton


def scan_text(automaton: ahocorasick.Automaton, text: str | None) -> tuple:
    """(words, base places, first, last, base labels, labels, score) of one text."""
    text = text or ""
    spaced = words_text(text)
    n_words = spaced.count(" ") - 1 if spaced else 0
    starts, base, labels, tagged = [], set(), set(), False
    for end, (length, is_base, label) in automaton.iter(spaced):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            starts.append(end - length + 1)
            base.add(label)
    score = max((RESTRICTION.get(x, UNKNOWN) for x in labels), default=0.0)
    if tagged:
        for expression in _EXPRESSION.findall(text):
            notation = parse_expression(expression)
            restriction, families = (UNKNOWN, {"unparsed"}) if notation is None else evaluate(notation)
            labels |= {x for x in families if "," not in x}
            score = max(score, restriction)
    first = last = None
    if starts:
        first = spaced.count(" ", 0, min(starts))
        last = first + spaced.count(" ", min(starts), max(starts))
    return n_words, len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


LICENSE_COLUMNS = StructType(
    [
        StructField("n_words", LongType(), False),
        StructField("n_base", LongType(), False),
        StructField("first_word", LongType()),
        StructField("last_word", LongType()),
        StructField("base_labels", StringType(), False),
        StructField("labels", StringType(), False),
        StructField("score", DoubleType(), False),
    ]
)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of `LICENSE_COLUMNS`; they replace columns of the same name."""

    def make():
        automaton = _automaton()
        return lambda texts: [scan_text(automaton, t) for t in texts]

    names = set(LICENSE_COLUMNS.names)
    return map_rows(docs, [c for c in docs.columns if c not in names], [text], LICENSE_COLUMNS, make)
