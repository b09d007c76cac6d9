"""Licence scan: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates tagged expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.text import ascii_words

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of the method and their labels, as plain words.
NOTICES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "bsd license": "bsd", "isc license": "isc",
    "mozilla public license": "mpl", "eclipse public license": "epl", "boost software license": "bsl", "creative commons": "cc", "cc by": "cc-by", "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa", "cc0": "cc0", "public domain": "public-domain", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Families of identifiers by prefix, longest first; an unknown identifier is its own label.
FAMILIES = ("mit", "apache", "agpl", "lgpl", "gpl", "bsd", "isc", "mpl", "epl", "bsl", "cc0", "cc-by-nc", "cc-by-sa", "cc-by")
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "bsl", "cc0", "public-domain", "cc-by"})
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")
_TAG_IN_TEXT = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[^\S\n]*:?", re.ASCII | re.IGNORECASE)


def family(name: str) -> str:
    name = name.lower()
    return next((f for f in FAMILIES if name == f or name.startswith((f + "-", f + "+"))), name)


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, or None if the expression is malformed.

    ``with`` binds tighter than ``and``, that tighter than ``or``; equal operators group from the left.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand may come next
    for token in _TOKEN.findall(expression):
        op = token.lower()
        if op in PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Labels of all operands and whether the licensee can choose terms that are all permissive.

    An exception after ``with`` changes nothing but is no licence of its own.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (right, r), (left, le) = stack.pop(), stack.pop()
            stack.append((left, le) if token == "with" else (left | right, (le or r) if token == "or" else (le and r)))
        else:
            stack.append(({family(token)}, family(token) in PERMISSIVE))
    return stack.pop()


def tagged_expressions(text: str) -> list[tuple[str, list[str]]]:
    """Expressions after identifier tags with their postfix form; the longest well-formed run of tokens counts."""
    found = []
    for m in _TAG_IN_TEXT.finditer(text):
        end = text.find("\n", m.end())
        tokens = _leading_tokens(text[m.end() : end if end >= 0 else len(text)])
        while tokens and (post := to_postfix(" ".join(tokens))) is None:
            tokens.pop()
        if tokens:
            found.append((" ".join(tokens), post))
    return found


def _leading_tokens(line: str) -> list[str]:
    """Tokens that can belong to one expression: operands joined by operators; reading stops where two operands meet."""
    tokens: list[str] = []
    for m in _TOKEN.finditer(line):
        t = m.group()
        if tokens and t not in "()" and t.lower() not in PRECEDENCE and tokens[-1] != "(" and tokens[-1].lower() not in PRECEDENCE:
            break
        tokens.append(t)
    return tokens


def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase, label in [*BASE.items(), *NOTICES.items(), (TAG, "")]:
        machine.add_word(f" {phrase} ", (phrase, label))
    machine.make_automaton()
    return machine


_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"


def scan_text(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """The columns of ``_COLUMNS`` for one text."""
    words = ascii_words(text)
    joined = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    base_at, base, labels, notices, tags = [], set(), set(), 0, 0
    for end, (phrase, label) in machine.iter(joined):
        if phrase in BASE:
            base_at.append(end - len(phrase) - 1)
            base.add(label)
        elif phrase == TAG:
            tags += 1
        else:
            labels.add(label)
            notices += 1
    starts = sorted(base_at)
    place = lambda at: joined.count(" ", 0, at + 1) - 1
    expressions, free = [], None
    for written, post in tagged_expressions(text) if tags else []:
        expressions.append(written)
        named, good = evaluate(post)
        labels |= named
        free = good if free is None else free and good
    labels |= base
    evidence = len(starts) + notices + 2 * len(expressions)
    return (
        len(words), len(starts), place(starts[0]) if starts else None, place(starts[-1]) if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)),
        1.0 - 0.5**min(evidence, 60), expressions, free,
    )


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    machine = _automaton()
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    for frame in frames:
        rows = [scan_text(t, machine) for t in frame["text"]]
        out = pd.DataFrame(rows, columns=names)
        for c in ("first_word", "last_word"):
            out[c] = out[c].astype("Int64")
        out["permissive"] = out["permissive"].astype("boolean")
        out.insert(0, "doc_id", np.asarray(frame["doc_id"]))
        yield out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, word count, places and labels of base phrases, all labels, score, expressions.

    ``first_word`` and ``last_word`` are the smallest and largest word index where a base phrase starts (null without one).
    ``labels`` adds the labels of further notice phrases and of the licences in tagged expressions; ``permissive`` tells whether every tagged expression
    leaves a choice of permissive terms (null without one). ``score`` is 1 - 0.5^(places, an expression counting twice).

    Null and empty texts have no words and score 0. Overlapping phrases all count. Malformed expressions are read as far as they are well formed.
    Repeated rows are scanned each for itself; other columns are ignored; an empty table gives an empty table.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInPandas(_scan, f"doc_id long, {_COLUMNS}")
