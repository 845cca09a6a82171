"""Licence scans: an Aho-Corasick automaton over words, and a shunting-yard parser for licence expressions.

Words are runs of digits, letters and non-ASCII characters of the lower-cased text. One pass of the automaton over the
words finds base phrases, notice phrases and identifier tags at once, overlapping ones included. What follows a tag
in its line, up to the next tag, is an expression of licence ids with and, or, with and parentheses; it is brought to postfix order and
evaluated: `and` takes the union of obligations, `or` leaves a choice (the mildest side counts), `with` attaches an
exception that makes a licence one step milder.

Columns of `scan`: n_words; n_base, first_word, last_word, base_labels over the base phrases; labels, with those of notices
and expressions; expressions (text, valid, postfix, strength from 0 public domain to 4 network copyleft, or null);
places (label, first word) of all matches; score, 1 minus the product of (1 - weight) over the distinct labels found. A label
found several ways counts once: as an expression if it is one, else as a base phrase, else as a notice.

Defined results: null text is empty: no words, no labels (empty strings), score 0; a broken expression is kept with
valid = false and adds no labels; repeated rows are repeated; only the id, the text and the columns in `carry` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# fixed values: base phrases and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: public licence notices
NOTICES = {
    "permission is hereby granted free of charge": "mit", "mit license": "mit", "apache license": "apache",
    "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd",
    "mozilla public license": "mpl", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "eclipse public license": "epl", "creative commons attribution": "cc-by", "creative commons zero": "cc0",
    "public domain": "public-domain", "free documentation license": "gfdl",
}
# fixed values: tags before a licence expression
TAGS = ("spdx license identifier", "license expression")
# fixed values: start of a public licence id, its label and its strength (0 none, 1 notice, 2 weak, 3 strong, 4 network)
FAMILIES = (
    ("agpl-", "agpl", 4), ("lgpl-", "lgpl", 2), ("gpl-", "gpl", 3), ("gfdl-", "gfdl", 3), ("mpl-", "mpl", 2), ("epl-", "epl", 2),
    ("apache-", "apache", 1), ("bsd-", "bsd", 1), ("0bsd", "bsd", 0), ("mit", "mit", 1), ("isc", "isc", 1), ("zlib", "zlib", 1),
    ("cc0-", "cc0", 0), ("cc-by-sa-", "cc-by-sa", 3), ("cc-by-nc-", "cc-by-nc", 3), ("cc-by-", "cc-by", 1), ("unlicense", "public-domain", 0),
    ("licenseref-", "other", 3),
)
WEIGHT = {"base": 0.6, "notice": 0.7, "expression": 0.9}
_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_TO_BLANK = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
_AFTER_TAG = re.compile(r"\s*:?[ \t]*")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")


def family(name: str) -> tuple[str, int] | None:
    return next(((label, strength) for start, label, strength in FAMILIES if name.startswith(start)), None)


def tokens_of(text: str) -> list[str]:
    """The longest head of `text` that can be an expression: ids, operators and parentheses up to anything else."""
    out, at, operand = [], 0, True
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        found = _TOKEN.match(text, at)
        if not found:
            return out
        token = found[0]
        word = token not in ("(", ")", "and", "or", "with")
        if word and not operand:
            return out
        out.append(token)
        operand = token not in (")",) and not word
        at = found.end()


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: with binds before and, and before or; None if the expression is broken."""
    rank = {"or": 1, "and": 2, "with": 3}
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # one is expected
    for token in tokens:
        if token == "(":
            if not operand:
                return None
            waiting.append(token)
        elif token == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in rank:
            if operand:
                return None
            while waiting and rank.get(waiting[-1], 0) >= rank[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(order: list[str]) -> tuple[set[str], int] | None:
    """Labels and strength; None if an id is unknown or `with` does not join a licence to an exception."""
    stack: list[tuple[set[str], int, str | None]] = []
    for token in order:
        if token in ("and", "or", "with"):
            right, left = stack.pop(), stack.pop()
            if token == "with":
                if left[2] is None or right[2] is None or "exception" not in right[2]:
                    return None
                stack.append((left[0], max(0, left[1] - 1), None))
            else:
                pick = max if token == "and" else min
                stack.append((left[0] | right[0], pick(left[1], right[1]), None))
        elif "exception" in token:
            stack.append((set(), -1, token))
        else:
            known = family(token)
            if known is None:
                return None
            stack.append(({known[0]}, known[1], token))
    labels, strength, _ = stack[0]
    return (labels, strength) if strength >= 0 else None


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    phrases: dict[str, list[tuple[str, str]]] = {}
    for kind, table in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in table.items():
            phrases.setdefault(phrase, []).append((kind, label))
    for phrase, uses in phrases.items():
        made.add_word(f" {phrase} ", (len(phrase) + 1, uses))
    made.make_automaton()
    return made


def scan_text(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    raw = (text or "").encode().lower()  # bytes: A-Z only
    words = raw.translate(_TO_BLANK).split()
    line = " " + b" ".join(words).decode() + " "
    places: list[tuple[str, int, str]] = []
    tags: list[tuple[int, int]] = []  # first word and the one after the last
    word, upto = 0, 0
    for end, (back, uses) in machine.iter(line):
        start = end - back  # of the blank before the phrase
        if start >= upto:
            word += line.count(" ", upto, start)
        else:
            word -= line.count(" ", start, upto)
        upto = start
        for kind, label in uses:
            if kind == "tag":
                tags.append((word, word + line.count(" ", start + 1, end + 1)))
            else:
                places.append((kind, word, label))
    base = [(at, label) for kind, at, label in places if kind == "base"]
    weights = {label: WEIGHT[kind] for kind, _, label in sorted(places, reverse=True)}
    expressions = []
    if tags:
        lowered = raw.decode()
        spans = [found.span() for found in _WORD.finditer(lowered)]
        tags.sort()
        for (_, after), (following, _) in zip(tags, [*tags[1:], (len(spans), 0)]):
            at = _AFTER_TAG.match(lowered, spans[after - 1][1]).end()
            upto = spans[following][0] if following < len(spans) else len(lowered)
            tokens = tokens_of(lowered[at:upto].split("\n", 1)[0])
            order = postfix(tokens)
            value = evaluate(order) if order else None
            expressions.append((" ".join(tokens), value is not None, " ".join(order or []), value[1] if value else None))
            for label in value[0] if value else ():
                weights[label] = WEIGHT["expression"]
    rest = 1.0
    for label in sorted(weights):
        rest *= 1 - weights[label]
    return (len(words), len(base), min((at for at, _ in base), default=None), max((at for at, _ in base), default=None),
            ",".join(sorted({label for _, label in base})), ",".join(sorted(weights)), 1 - rest,
            expressions, sorted((at, label) for _, at, label in places))


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "expressions array<struct<text: string, valid: boolean, postfix: string, strength: int>>, "
          "places array<struct<word: bigint, label: string>>")


def scan(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, `carry` and the columns above."""
    rows = docs.select("doc_id", *carry, "text")
    kept = rows.columns[:-1]
    schema = T.StructType(list(rows.select(*kept).schema.fields) + list(T.StructType.fromDDL(RESULT).fields))
    names = schema.names[len(kept):]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for frame in frames:
            found = pd.DataFrame([scan_text(t, machine) for t in frame["text"]], columns=names, dtype=object)
            out = frame[kept].copy()
            for name in names:
                out[name] = found[name].to_numpy()
            yield out

    return rows.mapInPandas(run, schema)
