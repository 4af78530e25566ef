"""Token counts per field or section of a document.

A document is encoded once as a whole. The bytes of its tokens give each token a
span of characters; the spans are joined with the spans of the sections, which
tile the text. A token that lies in one section counts there. One that crosses a
boundary is allocated by a rule:

``first``  the section that holds its first character
``last``   the section that holds its last character
``most``   the section that holds most of its characters, the earlier one of equals
``share``  each section by its share of the token's characters

A token of part of a character has that whole character as its span. The sums
over the sections of a document are its token count under every rule. A null or
empty text is one empty section of no tokens; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import bounded_batches, clean_text, tool

RULES = ("first", "last", "most", "share")
LINES = re.compile(r"\n+")


def _encoding(path: str, pattern: str):
    return tool("token_counts", (path, pattern), lambda: _made_encoding(path, pattern))


def _made_encoding(path: str, pattern: str):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, number in ranks.items():
        lengths[number] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token, and the one after its last."""
    encoding, lengths = _encoding(path, pattern)
    ids = np.array(encoding.encode_ordinary(text), dtype=np.int64)
    ends = np.cumsum(lengths[ids])
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    if len(data) == len(text):
        return ends - lengths[ids], ends
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[ends - lengths[ids]], character[ends - 1] + 1


def line_starts(text: str) -> list[int]:
    """Lines as sections; the line breaks belong to the line before."""
    return [0, *(m.end() for m in LINES.finditer(text) if m.end() < len(text))]


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its tokens reach into another one.
    ``sections``: ascending first characters, the first 0, of sections that tile the text."""
    n = len(sections)
    if not len(starts):
        return np.zeros(n), np.zeros(n, dtype=np.int64)
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    inside = first == last
    counts = np.bincount(first[inside], minlength=n).astype(np.float64)
    crossing = np.zeros(n, dtype=np.int64)
    bounds = np.append(sections, length)
    for token in np.flatnonzero(~inside):
        span = np.arange(first[token], last[token] + 1)
        crossing[span] += 1
        held = np.minimum(bounds[span + 1], ends[token]) - np.maximum(bounds[span], starts[token])
        if rule == "share":
            counts[span] += held / held.sum()
        else:
            counts[{"first": span[0], "last": span[-1], "most": span[np.argmax(held)]}[rule]] += 1
    return counts, crossing


FIELDS = T.ArrayType(T.StructType([
    T.StructField("section", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("n_tokens", T.DoubleType()), T.StructField("n_crossing", T.LongType()),
]))


def _lists(counts: list[int], columns: dict[str, np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    rows = pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets), rows)


def sections_column(text: Column, starts: Column | None, path: str, pattern: str, rule: str = "most") -> Column:
    """An array of sections with their tokens. ``starts``: a column of ascending
    first characters; without it, the lines of the text. Starts beyond the text
    or before it are moved to its ends."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def one(value: str, own) -> tuple:
        at = np.array(line_starts(value) if own is None else sorted({0, *(min(max(0, s), len(value)) for s in own if s is not None)}), dtype=np.int64)
        counts, crossing = allocate(*token_spans(value, path, pattern), at, len(value), rule)
        return at, np.append(at[1:], len(value)), counts, crossing

    def packed(found: list[tuple]) -> pa.Array:
        join = lambda i, kind: np.concatenate([f[i] for f in found]).astype(kind) if found else np.zeros(0, kind)
        sizes = [len(f[0]) for f in found]
        number = np.concatenate([np.arange(n) for n in sizes]).astype(np.int32) if found else np.zeros(0, np.int32)
        return _lists(sizes, {"section": number, "start": join(0, np.int64), "end": join(1, np.int64), "n_tokens": join(2, np.float64), "n_crossing": join(3, np.int64)})

    if starts is None:
        @F.arrow_udf(FIELDS)
        def lines(texts: pa.Array) -> pa.Array:
            return packed([one(t, None) for t in texts.to_pylist()])

        return lines(clean_text(text))

    @F.arrow_udf(FIELDS)
    def given(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return packed([one(t, s or []) for t, s in zip(texts.to_pylist(), lists.to_pylist())])

    return given(clean_text(text), starts.cast("array<bigint>"))


def by_section(docs: DataFrame, path: str, pattern: str, rule: str = "most", starts: str | None = None) -> DataFrame:
    """One row per section: ``doc_id, section, start, end, n_tokens, n_crossing``."""
    bounded_batches(docs.sparkSession)
    column = sections_column(F.col("text"), F.col(starts) if starts else None, path, pattern, rule)
    return docs.select("doc_id", column.alias("s")).select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.*")


def by_field(rows: DataFrame, key: str, fields: list[str], path: str, pattern: str, rule: str = "most", joint: str = "\n") -> DataFrame:
    """Tokens of each text column when the columns are joined and encoded as one
    text: ``key, field, n_tokens, n_crossing``. The joint belongs to the field
    before it; a null field is empty and has no row."""
    bounded_batches(rows.sparkSession)
    parts = [F.concat(clean_text(f), F.lit(joint if i < len(fields) - 1 else "")) for i, f in enumerate(fields)]
    held = [(f, p) for f, p in zip(fields, parts)]
    lengths = [F.length(p) for p in parts]
    begin, starts = F.lit(0), []
    for length in lengths:
        starts.append(begin)
        begin = begin + length
    plain = rows.select(
        F.col(key).alias("key"), F.concat(*parts).alias("text"),
        F.array(*(F.struct(s.cast("bigint").alias("start"), F.lit(f).alias("field"), n.alias("n")) for s, (f, _), n in zip(starts, held, lengths))).alias("fields"),
    ).withColumn("fields", F.expr("filter(fields, f -> f.n > 0)"))
    found = plain.withColumn("s", sections_column(F.col("text"), F.col("fields.start"), path, pattern, rule))
    return found.select("key", F.explode(F.arrays_zip("fields", "s")).alias("z")).where("z.fields IS NOT NULL").select(
        F.col("key").alias(key), F.col("z.fields.field").alias("field"), F.col("z.s.n_tokens").alias("n_tokens"),
        F.col("z.s.n_crossing").alias("n_crossing"),
    )
