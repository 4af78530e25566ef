"""Alignment of two tokenizers over the same bytes.

Both encode a space and the text, A by the tokenizers library and B by
sentencepiece. Offsets at which tokens of both end cut the tokens into groups;
two tokens are linked when their byte ranges overlap, and an id pair's count is the
number of its links in all documents.

Fragments form a monoid. A byte range of a document holds the tokens that end in
it. Its fragment is an open prefix (the tokens up to its first cut, whose group may
have begun before), closed groups, and an open suffix (those after its last cut);
without a cut all of it is open. To compose two neighbours, the suffix of the
first and the prefix of the second become one closed group, or, where one of them
has no cut, a longer open part. Composition is associative, so the ranges of a
document longer than ``LONG`` bytes go to many tasks, and a tree of ``FAN``
neighbours at a time reduces them. Closed groups are written where they close, in
order, and only open parts travel up the tree.

A text is encoded in pieces between single spaces that stand between other
characters, as long as both vocabularies let no token cross such a place
(``Pair.cuts``); else as a whole. Such a place is a cut, so equal pieces have equal
groups and links, which a task works out once while it remembers them.

Texts are read and encoded once; tokens are staged with each piece once in a block of
documents, and looked up there when the pairs are counted. The ``PAIRS`` most frequent pairs at most are broadcast, 20 bytes each;
links of rarer ones are joined by a shuffle, where no pair is frequent.

A text that is null or empty, or whose tokens of A or B don't give back the bytes
(as with U+2581, which B reads as a space), has no tokens: zeros and an empty
``groups_sha256``, and nothing of it is counted. Strings of special tokens are
plain text. Repeated rows count each time and give repeated rows, a null ``doc_id``
is kept, an empty table gives none. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import bounded_batches, clean_text
from tidemark.session import session_conf, staged

#: Documents of more bytes are reduced over several tasks, in ranges of as many bytes.
LONG = 1 << 15
FAN = 16
#: Pairs that are broadcast at most.
PAIRS = 4_000_000
#: Pieces that a task remembers, and their characters; those that are encoded in one text.
_PIECES, _CHARS = 150_000, 8 << 20
_TOGETHER = 100
_SINGLE_SPACE = re.compile(r" (?<=\S )(?=\S)")


def _byte_letters() -> dict[str, int]:
    """The letters of a byte-level vocabulary: a visible Latin-1 character is its own
    byte, the other bytes follow from U+0100 on in their order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """The two tokenizers of a task, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max([*vocabulary.values(), *added]) + 1)
        for token, number in vocabulary.items():
            self.bytes_a[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for number, token in added.items():
            self.bytes_a[number] = token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.length_a = np.array([len(t) for t in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], dtype=np.int64)
        self._flat = [np.frombuffer(b"".join(t), dtype=np.uint8) for t in (self.bytes_a, self.bytes_b)]
        self._first = [np.append(0, np.cumsum(n)) for n in (self.length_a, self.length_b)]
        with open(path_a, encoding="utf-8") as file:
            form = json.load(file)
        before = form.get("pre_tokenizer") or {}
        self.cuts = (
            form.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not any("▁" in p.lstrip("▁") for p in pieces)
        )

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that are encoded by themselves; a single space between two of them is dropped."""
        return _SINGLE_SPACE.split(text) if self.cuts else [text]

    def _ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        found = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype=np.int64) for e in found], [np.array(b, dtype=np.int64) for b in self.b.encode(texts, num_threads=1)]

    def gives_back(self, ids: tuple[np.ndarray, np.ndarray], data: bytes) -> bool:
        """Whether the tokens of both are these bytes."""
        for flat, first, own in zip(self._flat, self._first, ids):
            at, _ = _spans(first, own)
            if len(at) != len(data) or flat[at].tobytes() != data:
                return False
        return True

    def encode(self, pieces: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of A and of B of all pieces that give back their bytes, one after
        another; the number of tokens of each piece; and whether it does.

        Pieces that neither begin nor end with white space are encoded many in one
        text, with single spaces between them, where no token crosses."""
        joined, single = [], []
        for i, piece in enumerate(pieces):
            (single if not self.cuts or piece[:1].isspace() or piece[-1:].isspace() else joined).append(i)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64) if all(map(str.isascii, pieces)) else np.array([len(p.encode("utf-8")) for p in pieces], dtype=np.int64)
        counts, whole = np.zeros((len(pieces), 2), dtype=np.int64), np.zeros(len(pieces), dtype=bool)
        parts: list[tuple[list[int], tuple[np.ndarray, np.ndarray]]] = []
        blocks = [joined[k:k + _TOGETHER] for k in range(0, len(joined), _TOGETHER)]
        for block, a, b in zip(blocks, *self._ids([" ".join([pieces[i] for i in block]) for block in blocks])):
            ends = np.cumsum(lengths[block] + 1)
            if self.gives_back((a, b), " ".join(["", *(pieces[i] for i in block)]).encode("utf-8")):
                for side, (own, length) in enumerate(((a, self.length_a), (b, self.length_b))):
                    counts[block, side] = np.diff(np.searchsorted(np.cumsum(length[own]), ends, side="right"), prepend=0)
                whole[block] = True
                parts.append((block, (a, b)))
            else:
                single += block
        for i, a, b in zip(single, *self._ids([pieces[i] for i in single])):
            if self.gives_back((a, b), b" " + pieces[i].encode("utf-8")):
                counts[i], whole[i] = (len(a), len(b)), True
                parts.append(([i], (a, b)))
        order = np.array([i for block, _ in parts for i in block], dtype=np.int64)
        ids = []
        for side in (0, 1):
            held = np.concatenate([p[1][side] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
            first = np.zeros(len(pieces) + 1, dtype=np.int64)
            begins = np.cumsum(counts[order, side]) - counts[order, side]
            first[order] = begins
            at = np.repeat(first[:-1] - (np.cumsum(counts[:, side]) - counts[:, side]), counts[:, side]) + np.arange(counts[:, side].sum())
            ids.append(held[at])
        return ids, counts, whole


@dataclass
class Tokens:
    """Ids and end offsets, ascending."""

    ids: np.ndarray
    ends: np.ndarray

    def part(self, begin: int, end: int) -> "Tokens":
        """The tokens that end after ``begin`` and not after ``end``."""
        i, j = np.searchsorted(self.ends, [begin, end], side="right")
        return Tokens(self.ids[i:j], self.ends[i:j])


def cuts_of(a: Tokens, b: Tokens) -> np.ndarray:
    if not len(a.ends) or not len(b.ends):
        return a.ends[:0]
    return a.ends[b.ends[np.minimum(np.searchsorted(b.ends, a.ends), len(b.ends) - 1)] == a.ends]


def links_of(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset at which each overlap ends, and the ids of the two tokens that overlap.
    Between two neighbouring ends lies exactly one pair of tokens, and each pair once."""
    ends = np.sort(np.concatenate([a.ends, b.ends]), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    return ends, a.ids[np.searchsorted(a.ends, ends)], b.ids[np.searchsorted(b.ends, ends)]


class Writer:
    """Writes groups as ``a1,a2|b1;`` one after another."""

    def __init__(self, size_a: int, size_b: int):
        self.width = len(str(max(size_a, size_b))) + 1
        self.tables = [self._table(n) for n in (size_a, size_b)]

    def _table(self, n: int) -> np.ndarray:
        table = np.zeros((n, self.width), dtype=np.uint8)
        numbers, digits = np.arange(n), self.width - 1
        for place in range(digits):
            unit = 10 ** (digits - 1 - place)
            shown = numbers >= unit if unit > 1 else np.ones(n, dtype=bool)
            table[shown, place] = 48 + numbers[shown] // unit % 10
        table[:, -1] = ord(",")
        return table

    def text(self, a: Tokens, b: Tokens, cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The text of closed groups, and where each group's text ends."""
        group_a, group_b = np.searchsorted(cuts, a.ends), np.searchsorted(cuts, b.ends)
        rows = np.empty((len(a.ids) + len(b.ids), self.width), dtype=np.uint8)
        at_a = np.arange(len(a.ids)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b.ids)) + np.searchsorted(group_a, group_b, side="right")
        for table, tokens, at, group, mark in zip(self.tables, (a, b), (at_a, at_b), (group_a, group_b), b"|;"):
            rows[at] = table[tokens.ids]
            if len(at):
                last = np.append(group[1:] != group[:-1], True)
                rows[at[last], -1] = mark
        flat = rows.ravel()
        shown = flat != 0
        ends = np.cumsum(shown.reshape(rows.shape).sum(axis=1)) if len(rows) else np.zeros(0, dtype=np.int64)
        last = np.append(group_b[1:] != group_b[:-1], True) if len(group_b) else np.zeros(0, dtype=bool)
        return flat[shown].tobytes(), ends[at_b[last]]


def group_text(a: np.ndarray, b: np.ndarray) -> bytes:
    """One group from its ids."""
    return f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))};".encode()


class _Numbers(dict):
    """Numbers pieces as they come and lists the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


def _smallest(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


class Table:
    """Pieces with their tokens: groups, links and the text of the groups of each."""

    def __init__(self, counts: np.ndarray, ids: list[np.ndarray], lengths: tuple[np.ndarray, np.ndarray], size_b: int):
        self.ids = ids
        self.tokens = [Tokens(own, np.cumsum(length[own])) for own, length in zip(ids, lengths)]
        self.cuts = cuts_of(*self.tokens)
        ends, linked_a, linked_b = links_of(*self.tokens)
        self.pairs = linked_a * size_b + linked_b
        self.first_id = [np.append(0, np.cumsum(counts[:, side])) for side in (0, 1)]
        last = self.first_id[0][1:]
        border = np.where(last > 0, self.tokens[0].ends[last - 1], 0) if len(ids[0]) else np.zeros(len(counts), dtype=np.int64)
        self.last_group = np.searchsorted(self.cuts, border, side="right")
        self.first = np.append(0, np.searchsorted(ends, border, side="right"))
        #: Tokens of A, of B, groups, links, bytes.
        self.sizes = np.column_stack([counts, np.diff(self.last_group, prepend=0), np.diff(self.first), np.diff(border, prepend=0)])

    def texts(self, writer: "Writer") -> list[bytes]:
        text, ends = writer.text(*self.tokens, self.cuts)
        at = np.append(0, ends)[self.last_group].tolist()
        return [text[i:j] for i, j in zip([0, *at], at)]

    def links(self, pieces: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of pieces that occur so many times, and how often they are linked."""
        at, counts = _spans(self.first, pieces)
        pairs, group = np.unique(self.pairs[at], return_inverse=True)
        return pairs, np.bincount(group, weights=np.repeat(times, counts), minlength=len(pairs)).astype(np.int64)

    def all_ids(self, pieces: np.ndarray) -> list[np.ndarray]:
        return [ids[_spans(first, pieces)[0]] for ids, first in zip(self.ids, self.first_id)]


class Pieces:
    """What a task remembers of the pieces it has encoded, and how often they occurred."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.chars = 0
        self.counts = np.zeros((0, 2), dtype=np.int64)
        self.whole = np.zeros(0, dtype=bool)
        self.times = np.zeros(0, dtype=np.int64)
        self.ids = [np.zeros(0, dtype=np.int64)] * 2
        self.first = [np.zeros(1, dtype=np.int64)] * 2

    @property
    def full(self) -> bool:
        return len(self.number) > _PIECES or self.chars > _CHARS

    def _learn(self) -> None:
        fresh, self.number.fresh = self.number.fresh, []
        if not fresh:
            return
        self.chars += sum(map(len, fresh))
        ids, counts, whole = self.pair.encode(fresh)
        self.first = [np.append(f, f[-1] + np.cumsum(counts[:, side])) for side, f in enumerate(self.first)]
        self.ids = [np.concatenate([old, new]) for old, new in zip(self.ids, ids)]
        self.counts = np.concatenate([self.counts, counts])
        self.whole = np.concatenate([self.whole, whole])
        self.times = np.concatenate([self.times, np.zeros(len(fresh), dtype=np.int64)])

    def documents(self, texts: list[str]) -> list[np.ndarray | None]:
        """The pieces of each text; None where it has no tokens."""
        found = []
        for text in texts:
            pieces = self.pair.pieces(text) if text else None
            found.append(np.array([*map(self.number.__getitem__, pieces)], dtype=np.int64) if pieces else None)
        self._learn()
        return [own if own is not None and self.whole[own].all() else None for own in found]

    def block(self, documents: list[np.ndarray | None]) -> tuple[bytes, ...]:
        """Documents and the tokens of just their pieces, as bytes (see ``BLOCKS``)."""
        held = np.concatenate([np.zeros(0, dtype=np.int64), *(d for d in documents if d is not None)])
        own, place, times = np.unique(held, return_inverse=True, return_counts=True)
        self.times[own] += times
        sizes = np.array([-1 if d is None else len(d) for d in documents], dtype=np.int32)
        ids = [
            i[_spans(f, own)[0]].astype(_smallest(len(t))).tobytes()
            for i, f, t in zip(self.ids, self.first, (self.pair.bytes_a, self.pair.bytes_b))
        ]
        return sizes.tobytes(), place.astype(np.int32).tobytes(), self.counts[own].astype(np.int32).tobytes(), *ids

    def counted(self) -> tuple[bytes, bytes]:
        """Linked pairs of all that occurred since the task last forgot, and how often."""
        lengths = self.pair.length_a, self.pair.length_b
        table = Table(self.counts, self.ids, lengths, len(self.pair.bytes_b))
        seen = np.flatnonzero(self.times)
        return tuple(v.tobytes() for v in table.links(seen, self.times[seen]))


def _spans(first: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the pieces, one piece after another, and their number in each."""
    counts = first[pieces + 1] - first[pieces]
    before = np.cumsum(counts) - counts
    return np.repeat(first[pieces] - before, counts) + np.arange(counts.sum()), counts


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_text().alias("text"))


BLOCKS = "doc_ids array<bigint>, sizes binary, pieces binary, counts binary, ids_a binary, ids_b binary, pairs binary, links binary"
_BLOCK = [("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("sizes", "pieces", "counts", "ids_a", "ids_b", "pairs", "links"))]


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of ``BLOCKS``, about a tenth of a megabyte for a hundred documents: some
    documents, the pieces of each, and the tokens of these pieces; or linked pairs
    and how often a task has seen them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or Pieces(Pair(path_a, path_b))
            rows = []
            if known.full:
                rows.append((*[None] * 6, *known.counted()))
                known.forget()
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                block = known.block(known.documents(part.column("text").to_pylist()))
                rows.append((part.column("doc_id").to_pylist(), *block, None, None))
            yield _record(rows, _BLOCK)
        if known is not None:
            yield _record([(*[None] * 6, *known.counted())], _BLOCK)

    return _texts(docs).mapInArrow(encode, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n``: links of each id pair; a pair is A's id times B's size and B's id."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, links in zip(batch.column("pairs").to_pylist(), batch.column("links").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(_array(pairs)), pa.array(_array(links))], ["pair", "n"])

    listed = blocks.where("pairs IS NOT NULL").select("pairs", "links").mapInArrow(spread, "pair bigint, n bigint")
    return listed.groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(pairs: DataFrame, size_b: int) -> DataFrame:
    """Add ``best``: whether the count is the highest of the pair's id of B. There
    are as many highest counts as B has ids."""
    of = F.col("pair") % size_b
    highest = pairs.groupBy(of.alias("b")).agg(F.max("n").alias("most"))
    return pairs.withColumn("b", of).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(pairs: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs above a count that leaves ``limit`` at most, ascending, with their counts
    and whether they are best; and that count, 0 if it takes all."""
    least = 0
    if pairs.count() > limit:
        spread = pairs.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("n")).limit(limit + 1).toArrow()
        above = np.cumsum(spread.column("pairs").to_numpy())
        taken = int(np.searchsorted(above, limit, side="right"))
        least = int(spread.column("n")[taken].as_py()) if taken < len(above) else 0
    table = pairs.where(F.col("n") > least).toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    return (*(np.asarray(table.column(c).to_numpy())[order] for c in ("pair", "n", "best")), least)


FOUND = (
    "key bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string, rare_pairs binary, rare_links binary, range int, a_ids binary, a_begin bigint, b_ids binary, b_begin bigint"
)
_KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
_FIELDS = [(f.split()[0], _KINDS[f.split()[1]]) for f in FOUND.split(", ")]


def _record(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def look_up(blocks: DataFrame, shared, long: int) -> DataFrame:
    """Rows of ``FOUND``: one for each document, whose hash is missing if it is long
    and whose rare links aren't counted yet; and the ranges of long ones. ``shared``:
    a broadcast of the frequent pairs and of the lengths of the tokens."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pairs, counts, best), lengths = shared.value
        sizes_of = [len(n) for n in lengths]
        kinds = [_smallest(n) for n in sizes_of]
        writer, key = Writer(*sizes_of), TaskContext.get().partitionId() << 40
        for batch in batches:
            for row in batch.to_pylist():
                ids = [np.frombuffer(row[f"ids_{side}"], dtype=kind).astype(np.int64) for side, kind in zip("ab", kinds)]
                table = Table(np.frombuffer(row["counts"], dtype=np.int32).astype(np.int64).reshape(-1, 2), ids, lengths, sizes_of[1])
                texts = table.texts(writer)
                at, hit = _found_in(pairs, table.pairs)
                running = np.zeros((len(at) + 1, 3), dtype=np.int64)
                np.cumsum(np.where(hit, best[at] if len(pairs) else 0, 0), out=running[1:, 0])
                np.cumsum(np.where(hit, counts[at] if len(pairs) else 0, 0), out=running[1:, 1])
                np.cumsum(~hit, out=running[1:, 2])
                sums = np.column_stack([table.sizes, np.diff(running[table.first], axis=0)])
                place = np.frombuffer(row["pieces"], dtype=np.int32)
                rows, begin = [], 0
                for doc_id, size in zip(row["doc_ids"], np.frombuffer(row["sizes"], dtype=np.int32).tolist()):
                    key += 1
                    if size < 0:
                        rows.append((key, doc_id, 0, 0, 0, 0, 0, 0, "", *[None] * 7))
                        continue
                    pieces, begin = place[begin:begin + size], begin + size
                    *sizes, n_bytes, n_best, count_sum, n_rare = sums[pieces].sum(axis=0).tolist()
                    head, rare = (key, doc_id, *sizes, n_best, count_sum), (None, None)
                    if n_rare:
                        found, n = table.links(*np.unique(pieces, return_counts=True))
                        miss = ~_found_in(pairs, found)[1]
                        rare = (found[miss].tobytes(), n[miss].tobytes())
                    if n_bytes > long:
                        rows.append((*head, None, *rare, *[None] * 5))
                        for r in _ranges(lengths, table.all_ids(pieces), long):
                            rows.append((key, *[None] * 10, *r))
                            if len(rows) >= 100:
                                yield _record(rows, _FIELDS)
                                rows = []
                    else:
                        text = b"".join([texts[p] for p in pieces.tolist()])
                        rows.append((*head, hashlib.sha256(text[:-1]).hexdigest(), *rare, *[None] * 5))
                yield _record(rows, _FIELDS)

    return blocks.where("doc_ids IS NOT NULL").drop("pairs", "links").mapInArrow(one, FOUND)


def _found_in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among sorted ones, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _ranges(lengths: tuple, ids: list[np.ndarray], size: int) -> Iterator[tuple]:
    """The tokens that end in each range, and the offset at which its first one begins."""
    ends = [np.cumsum(length[own]) for own, length in zip(ids, lengths)]
    for number in range(-(-int(ends[0][-1]) // size)):
        row = [number]
        for own, end in zip(ids, ends):
            i, j = np.searchsorted(end, [number * size, (number + 1) * size], side="right")
            row += [own[i:j].astype(np.int32).tobytes(), int(end[i - 1]) if i else 0]
        yield tuple(row)


@dataclass
class Fragment:
    """Tokens of neighbouring ranges: ``left`` and ``right`` are the ids of A and of B
    in the open prefix and suffix, ``first`` the range of the first cut. Without a
    cut ``first`` is None and all tokens are in ``left``. Closed groups aren't kept:
    each is passed on when it closes, as (range, part, text)."""

    left: tuple[np.ndarray, np.ndarray]
    right: tuple[np.ndarray, np.ndarray]
    first: int | None

    def __add__(self, other: "Fragment") -> tuple["Fragment", list[tuple[int, int, bytes]]]:
        if self.first is None:
            return Fragment(_joined(self.left, other.left), other.right, other.first), []
        if other.first is None:
            return Fragment(self.left, _joined(self.right, other.left), self.first), []
        closed = (other.first, 0, group_text(*_joined(self.right, other.left)))
        return Fragment(self.left, other.right, self.first), [closed]


def _joined(x: tuple, y: tuple) -> tuple:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def fragment_of(number: int, a: Tokens, b: Tokens, writer: Writer) -> tuple[Fragment, list[tuple[int, int, bytes]]]:
    """The fragment of a range, and the text of its closed groups."""
    cuts = cuts_of(a, b)
    if not len(cuts):
        return Fragment((a.ids, b.ids), (a.ids[:0], b.ids[:0]), None), []
    i, j = np.searchsorted(a.ends, cuts[[0, -1]], side="right")
    k, m = np.searchsorted(b.ends, cuts[[0, -1]], side="right")
    made = Fragment((a.ids[:i], b.ids[:k]), (a.ids[j:], b.ids[m:]), number)
    if len(cuts) == 1:
        return made, []
    text, _ = writer.text(Tokens(a.ids[i:j], a.ends[i:j]), Tokens(b.ids[k:m], b.ends[k:m]), cuts[1:])
    return made, [(number, 1, text)]


LEVEL = "key bigint, at int, first int, left_a binary, left_b binary, right_a binary, right_b binary, range int, part int, text binary"
_LEVEL = [(f.split()[0], _KINDS[f.split()[1]]) for f in LEVEL.split(", ")]


def _level(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(_LEVEL)
    return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, _LEVEL)], names=[name for name, _ in _LEVEL])


def _row(key: int, at: int, f: Fragment) -> tuple:
    return (key, at, f.first, *(v.tobytes() for v in (*f.left, *f.right)), None, None, None)


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def _leaves(ranges: DataFrame, shared) -> DataFrame:
    """Fragments of the ranges, and the pieces of text that are closed in them."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value[1]
        writer = Writer(*map(len, lengths))
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = [np.frombuffer(r[f"{s}_ids"], dtype=np.int32).astype(np.int64) for s in "ab"]
                a, b = (Tokens(i, r[f"{s}_begin"] + np.cumsum(n[i])) for s, i, n in zip("ab", ids, lengths))
                fragment, closed = fragment_of(r["range"], a, b, writer)
                rows.append(_row(r["key"], r["range"], fragment))
                rows += [(r["key"], *[None] * 6, *c) for c in closed]
            yield from _level(rows).to_batches()

    return ranges.mapInArrow(made, LEVEL)


def _compose(table: pa.Table) -> pa.Table:
    """Up to ``FAN`` neighbours of one document become one fragment."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    whole, out = None, []
    for r in rows:
        own = Fragment(*((_array(r[f"{s}_a"]), _array(r[f"{s}_b"])) for s in ("left", "right")), r["first"])
        whole, closed = (own, []) if whole is None else whole + own
        out += [(r["key"], *[None] * 6, *c) for c in closed]
    return _level([_row(rows[0]["key"], rows[0]["at"] // FAN, whole), *out])


def reduced(ranges: DataFrame, shared) -> DataFrame:
    """``key, groups_sha256`` of long documents, from their ranges (staged)."""
    level = staged(_leaves(ranges.repartition("key", "range"), shared))
    texts = level.where("text IS NOT NULL").select("key", "range", "part", "text")
    most = ranges.agg(F.max("range")).first()[0] or 0
    while True:
        open_parts = level.where("at IS NOT NULL")
        if most == 0:
            break
        above = open_parts.withColumn("up", F.floor(F.col("at") / FAN)).groupBy("key", "up").applyInArrow(lambda t: _compose(t.drop_columns("up")), LEVEL)
        level = staged(above)
        texts = texts.unionByName(level.where("text IS NOT NULL").select("key", "range", "part", "text"))
        most //= FAN

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document begins and ends with a cut: what is left open is its first group."""
        for batch in batches:
            rows = [(r["key"], r["first"], 0, group_text(_array(r["left_a"]), _array(r["left_b"]))) for r in batch.to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "range", "part", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, held, done = None, None, b"", []
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if key != now:
                    if now is not None:
                        running.update(held[:-1])
                        done.append((now, running.hexdigest()))
                    now, running, held = key, hashlib.sha256(), b""
                running.update(held)
                held = text
        if now is not None:
            running.update(held[:-1])
            done.append((now, running.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["key", "groups_sha256"])

    first = open_parts.mapInArrow(begun, "key bigint, range int, part int, text binary")
    ordered = texts.unionByName(first).repartition("key").sortWithinPartitions("key", "range", "part").select("key", "text")
    return ordered.mapInArrow(hashed, "key bigint, groups_sha256 string")


def _rare_sums(found: DataFrame, rare: DataFrame) -> DataFrame:
    """``key, more_best, more_sum`` of links whose pair was not broadcast. Such a pair
    has few links, so no key of the join is frequent."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, pairs, links in zip(*(batch.column(c).to_pylist() for c in ("key", "rare_pairs", "rare_links"))):
                pairs = _array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), key)), pa.array(pairs), pa.array(_array(links))], ["key", "pair", "times"])

    listed = found.where("rare_pairs IS NOT NULL").select("key", "rare_pairs", "rare_links").mapInArrow(spread, "key bigint, pair bigint, times bigint")
    return listed.join(rare, "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )


def align(docs: DataFrame, path_a: str, path_b: str, pairs_limit: int = PAIRS, long: int = LONG) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    tools = Pair(path_a, path_b)
    lengths = tools.length_a, tools.length_b
    blocks = staged(encoded(docs, path_a, path_b))
    # A row of blocks holds many documents.
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4"):
        pairs = staged(with_best(staged(pair_counts(blocks)), len(lengths[1])))
        *table, least = frequent(pairs, pairs_limit)
        shared = spark.sparkContext.broadcast((tuple(table), lengths))
        found = staged(look_up(blocks, shared, long))
    rows = found.where("n_a IS NOT NULL").select(
        "key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
    if least:
        more = _rare_sums(found, pairs.where(F.col("n") <= least))
        rows = rows.join(more, "key", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
        }).drop("more_best", "more_sum")
    ranges = found.where("range IS NOT NULL").select("key", "range", "a_ids", "a_begin", "b_ids", "b_begin")
    hashes = reduced(ranges, shared)
    short = rows.where("groups_sha256 IS NOT NULL")
    long_rows = rows.where("groups_sha256 IS NULL").drop("groups_sha256").join(hashes, "key").select(rows.columns)
    return short.unionByName(long_rows).drop("key")
