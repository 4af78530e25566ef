"""License scan: phrases by an Aho-Corasick automaton, expressions by a parser.

A text is lower-cased (A-Z), cut into words, and read once by an automaton of all
phrases: base phrases, notice phrases and the identifier tag. Where a tag stands,
the expression after it, up to the next tag or the end of the line, is parsed by
the shunting-yard method: WITH binds most, then AND, then OR. An expression is permissive if its licenses are, either one
for OR, both for AND; an exception after WITH makes no license permissive.

A null text counts as empty and has no words and no labels. Malformed expressions
give no verdict, but the identifiers in them are still labels. Texts are read
whole. Each row is scanned for itself, so repeated rows give repeated results.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import bounded_batches

#: Words of a phrase and its label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TAG = "spdx license identifier"
#: Opening words of well-known notices.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit", "mit"),
    ("licensed under the apache", "apache"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("isc license", "isc"),
    ("cc by nc", "cc-by-nc"), ("cc by sa", "cc-by-sa"), ("cc by nd", "cc-by-nd"), ("cc by", "cc-by"),
    ("creative commons attribution", "cc-by"), ("cc0", "cc0"), ("unlicense", "unlicense"),
    ("all rights reserved", "reserved"),
)
PERMISSIVE = frozenset("mit apache bsd isc cc-by cc0 unlicense zlib 0bsd bsl".split())
FAMILIES = ("cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "lgpl", "agpl", "gpl", "apache", "bsd", "mit", "mpl", "epl", "isc", "cc0", "unlicense", "zlib", "0bsd", "bsl")
#: Shares of the doubt that one piece of evidence leaves.
DOUBT = {"tag": 0.05, "base": 0.3, "notice": 0.5}

WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: The tag alone, as the automaton finds it: three whole words with anything but words between them.
TAGS = re.compile(r"(?<![W])spdx[^W]++license[^W]++identifier(?![W])".replace("W", r"a-z0-9\x80-\U0010ffff"), re.I | re.A)
GAP = re.compile(r"[\s:]*")
LINE_END = re.compile(r"[\n\r]")
PIECES = re.compile(r"[()]|[A-Za-z0-9.+\-]+|[^\s]")
ORDER = {"or": 1, "and": 2, "with": 3}


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and anything beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def family(identifier: str) -> str:
    """The label of a license identifier: its family, or itself in lower case."""
    name = identifier.lower().rstrip("+")
    return next((f for f in FAMILIES if name == f or name.startswith(f + "-")), name)


def parse(expression: str) -> list[str] | None:
    """Identifiers and operators in reverse Polish order; None if malformed. What
    follows a complete expression on the line is not read."""
    out: list[str] = []
    held: list[str] = []
    operand = False
    for found in PIECES.finditer(expression):
        piece = found[0]
        name = piece.lower()
        if name in ORDER:
            if not operand:
                return None
            while held and held[-1] != "(" and ORDER[held[-1]] >= ORDER[name]:
                out.append(held.pop())
            held.append(name)
            operand = False
        elif piece == "(":
            if operand:
                break
            held.append(piece)
        elif piece == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif not re.fullmatch(r"[A-Za-z0-9.+\-]+", piece) or operand:
            break
        else:
            out.append(piece)
            operand = True
    if not operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(polish: list[str]) -> bool | None:
    """Whether a parsed expression is permissive."""
    stack: list[bool] = []
    for piece in polish:
        if piece in ORDER:
            if len(stack) < 2:
                return None
            right, left = stack.pop(), stack.pop()
            stack.append(left if piece == "with" else left and right if piece == "and" else left or right)
        else:
            stack.append(family(piece) in PERMISSIVE)
    return stack[0] if len(stack) == 1 else None


def identifiers(polish: list[str]) -> list[str]:
    """License identifiers, without operators and exceptions."""
    names: list[str] = []
    starts: list[int] = []  # of each operand in names
    for piece in polish:
        if piece in ORDER:
            right = starts.pop()
            if piece == "with":
                del names[right:]
        else:
            starts.append(len(names))
            names.append(piece)
    return names


def tagged_expressions(text: str):
    """What stands after each tag, up to the next tag or the end of the line."""
    tags = [match.span() for match in TAGS.finditer(text)]
    for (_, end), (following, _) in zip(tags, [*tags[1:], (len(text), 0)]):
        start = GAP.match(text, end, following).end()
        line_end = LINE_END.search(text, start, following)
        yield text[start:line_end.start() if line_end else following]


@lru_cache(maxsize=4)
def _automaton(base, notices):
    found: dict[str, list] = {}
    for kind, phrases in (("base", base), ("notice", notices), ("tag", ((TAG, ""),))):
        for phrase, label in phrases:
            found.setdefault(" " + " ".join(phrase.split()) + " ", []).append((kind, label, len(phrase.split())))
    automaton = ahocorasick.Automaton()
    for key, meanings in found.items():
        automaton.add_word(key, (len(key), meanings))
    automaton.make_automaton()
    return automaton


def scan(text: str | None, base=BASE, notices=NOTICES) -> dict:
    words = words_of(text)
    line = " " + b" ".join(words).decode("utf-8", "replace") + " "
    starts: list[int] = []
    base_labels, labels, kinds, verdicts, expressions = set(), set(), [], [], []
    at = count = 0
    tagged = False
    for end, (length, meanings) in _automaton(base, notices).iter(line):
        start = end - length + 1
        # Matches come by their ends; a longer one may start before the last.
        count += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
        at = start
        for kind, label, _ in meanings:
            kinds.append(kind)
            if kind == "base":
                starts.append(count)
                base_labels.add(label)
            elif kind == "notice":
                labels.add(label)
            tagged |= kind == "tag"
    if tagged:
        for expression in tagged_expressions(text):
            polish = parse(expression)
            if polish is None:
                first = PIECES.search(expression)
                labels.update(family(p) for p in ([first[0]] if first else []) if re.match(r"[A-Za-z0-9]", p))
                continue
            expressions.append(" ".join(polish))
            labels.update(family(name) for name in identifiers(polish))
            verdicts.append(evaluate(polish))
    doubt = 1.0
    for kind in dict.fromkeys(kinds):
        doubt *= DOUBT[kind]
    known = [v for v in verdicts if v is not None]
    return {
        "n_words": len(words), "n_base": len(starts),
        "first_word": min(starts) if starts else None, "last_word": max(starts) if starts else None,
        "base_labels": sorted(base_labels), "labels": sorted(labels | base_labels),
        "expressions": expressions, "permissive": all(known) if known else None, "score": 1.0 - doubt,
    }


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("expressions", T.ArrayType(T.StringType())), T.StructField("permissive", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
])
ARROW = pa.struct([
    *(pa.field(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")),
    *(pa.field(n, pa.list_(pa.string())) for n in ("base_labels", "labels", "expressions")),
    pa.field("permissive", pa.bool_()), pa.field("score", pa.float64()),
])


def scan_column(text: str | Column, base=BASE, notices=NOTICES) -> Column:
    """A struct of what was found; ``expressions`` are in reverse Polish order."""

    @F.arrow_udf(FIELDS)
    def scanned(texts: pa.Array) -> pa.Array:
        return pa.array([scan(t, base, notices) for t in texts.to_pylist()], ARROW)

    return scanned(F.col(text) if isinstance(text, str) else text)


def scan_documents(docs: DataFrame, into: str = "licenses") -> DataFrame:
    """The documents with a struct of licenses; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, scan_column("text"))


def report(docs: DataFrame) -> DataFrame:
    found = scan_documents(docs.select("doc_id", "text")).select("doc_id", "licenses.*")
    return found.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn(
        "labels", F.array_join("labels", ",")
    ).withColumn("expressions", F.array_join("expressions", "; "))
