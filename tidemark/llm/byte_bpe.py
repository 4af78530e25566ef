"""Byte-level byte-pair encoding by a lazily determinised transducer.

The merges of a rank file fix, for any two tokens, whether the one may follow the
other: it may if merging the bytes of both gives just these two. A sequence of
tokens is the encoding of its bytes exactly if each neighbouring pair is allowed.
That is a nondeterministic transducer whose state is the last token and the bytes
read of the next one. ``Transducer`` determinises it as it reads: a state is the
set of readings still possible, each with the tokens it has not yet emitted, and
what all of them share is emitted, so output lags by a few bytes of lookahead.
The table of states is bounded: once it is full, a piece that leaves it is read
to its end without new states. The tables of allowed pairs and of encoded pieces
are bounded too; all three change speed only.

Decoding streams: ``Utf8Machine`` is a state machine over bytes and, remembered
per state, over tokens. It knows after any token how many bytes belong to an
unfinished character.

A null text encodes like an empty one, to no ids; null ids decode to no bytes;
ids outside the vocabulary fail. Texts of any length are read once from left to
right. Other columns pass through; one named like the new column is replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import bounded_batches, clean_text, tool

PIECES = 300_000
PIECE_CHARS = 64
STATES = 20_000
PAIRS = 300_000
#: Ids that the streaming decoder is fed at once.
FEED = 1 << 14
ROOT = 0


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and rank."""
    return tool("byte_bpe", ("ranks", path), lambda: _read_ranks(path))


def _read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """``encode(piece)`` gives the ids of one piece of text, as bytes."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES, pairs: int = PAIRS):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.max_states, self.max_pairs = states, pairs
        #: Length of the longest token by its first three bytes.
        self.longest: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > self.longest.get(token[:3], 2):
                self.longest[token[:3]] = len(token)
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, number in ranks.items():
            node = ROOT
            for byte in token:
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = after
            self.token_at[node] = number
        leaf: dict[int, int] = {}
        self.children = [held or leaf for held in self.children]
        self.pairs: dict[int, dict[int, bool]] = {}
        self.known_pairs = 0
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: Tokens with a part that is merged by a higher rank than a larger part, so that ranks don't say what came first.
        self.disorderly: set[int] = set()
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: dict[int, tuple[tuple[int, ...], int]] = {}
        self.ends: list[tuple[int, ...]] = []
        self._number((((), -1, ROOT),))

    def merged(self, data: bytes, parts: int = 1) -> list[int]:
        """The merges carried out one by one, lowest rank first, from the left, until no
        more than ``parts`` are left."""
        least, parts = parts, [data[i:i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that are merged to this one last; a single byte twice. None if
        its bytes merge to others. Worked out once for each token."""
        if token not in self.halves:
            data, orderly = self.bytes_of[token], True
            before = after = token
            if len(data) > 1:
                *_, before, after = self.merged(data, parts=2) if self.merged(data) == [token] else (-1, -1)
                for part in (before, after):
                    if part >= 0:
                        self._halves(part)
                        orderly = orderly and part not in self.disorderly and (part < token or len(self.bytes_of[part]) == 1)
            self.halves[token] = (before, after) if before >= 0 else None
            if not orderly:
                self.disorderly.add(token)
        return self.halves[token]

    def _keep_apart(self, last: int, token: int) -> bool:
        """Whether merging the bytes of both gives just these two, by undoing the merges of
        both from the latest: none that crosses the border may come before the one undone.
        A merge is earlier than another by rank, and by place if these are equal."""
        ranks, bytes_of = self.ranks, self.bytes_of
        limit = 1 << 60
        while True:
            if ranks.get(bytes_of[last] + bytes_of[token], limit) < limit:
                return False
            left, right = self._halves(last)[1], self._halves(token)[0]
            if left == last and right == token:
                return True
            if right == token or left != last and last > token:
                limit, last = last, left
            else:
                limit, token = token + 1, right

    def _may_follow(self, last: int, token: int) -> bool:
        """Worked out once while it is remembered. ``last`` -1: at the start."""
        known = self.pairs.get(last, {}).get(token)
        if known is None:
            if self.known_pairs >= self.max_pairs:
                self.pairs.clear()
                self.known_pairs = 0
            known = self._halves(token) is not None
            if known and last >= 0:
                known = self._halves(last) is not None
                if known and (last in self.disorderly or token in self.disorderly):
                    known = self.merged(self.bytes_of[last] + self.bytes_of[token]) == [last, token]
                elif known:
                    known = self._keep_apart(last, token)
            self.pairs.setdefault(last, {})[token] = known
            self.known_pairs += 1
        return known

    def _number(self, readings: tuple) -> int:
        state = self.states.get(readings)
        if state is None:
            state = self.states[readings] = len(self.sets)
            self.sets.append(readings)
            self.ends.append(next((pending for pending, _, node in readings if node == ROOT), ()))
        return state

    def _read(self, readings, byte: int) -> list[tuple]:
        """The readings after one more byte: each goes on in its token, and ends it
        where the token is complete and may follow the last one."""
        children, token_at = self.children, self.token_at
        found = []
        for pending, last, node in readings:
            node = children[node].get(byte)
            if node is None:
                continue
            found.append((pending, last, node))
            token = token_at[node]
            if token >= 0:
                if self._may_follow(last, token):
                    found.append(((*pending, token), token, ROOT))
        return found

    def _step(self, state: int, byte: int) -> tuple[tuple[int, ...], int] | None:
        """Determinise one step: tokens that are certain after this byte, and the
        next state. None if the table of states has no room for it."""
        if len(self.sets) >= self.max_states:
            return None
        found = self._read(self.sets[state], byte)
        shared = found[-1][0]
        for pending, _, _ in found:
            while pending[:len(shared)] != shared:
                shared = shared[:-1]
        cut = len(shared)
        readings = tuple((p[cut:], last, node) for p, last, node in found) if cut else tuple(found)
        result = self.steps[state << 8 | byte] = (shared, self._number(readings))
        return result

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        ids: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            step = steps.get(state << 8 | byte) or self._step(state, byte)
            if step is None:
                return self._undetermined(ids, piece)
            if step[0]:
                ids.extend(step[0])
            state = step[1]
        return (*ids, *self.ends[state])

    def _undetermined(self, ids: list[int], piece: bytes) -> tuple[int, ...]:
        """Read on behind tokens that are certain, without new states: the longest token
        that may follow, and from where none may, back to a shorter one. Each place has
        one encoding of what stands before it, so none is come to twice."""
        rank_of, longest_of, pairs, bytes_of, none = self.ranks.get, self.longest.get, self.pairs, self.bytes_of, {}
        at, size = sum([len(bytes_of[t]) for t in ids]), len(piece)
        last, end = ids[-1] if ids else -1, size
        while at < size:
            after, most = pairs.get(last, none), at + longest_of(piece[at:at + 3], 2)
            if end > most:
                end = most
            while end > at:
                token = rank_of(piece[at:end])
                if token is not None:
                    allowed = after.get(token)
                    if allowed is None:
                        allowed = self._may_follow(last, token)
                    if allowed:
                        break
                end -= 1
            else:
                end = at - 1
                at -= len(bytes_of[ids.pop()])
                last = ids[-1] if ids else -1
                continue
            ids.append(token)
            last, at, end = token, end, size
        return tuple(ids)


class _Pieces(dict):
    """Ids of a piece of text, worked out once while it is remembered. Two
    generations: when the young one is full it becomes the old one, and what is
    still used moves over."""

    def __init__(self, encode, limit: int = PIECES):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str):
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece.encode("utf-8"))
            if len(piece) > PIECE_CHARS:
                return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


#: Characters for which the usual pattern can be said in classes that the standard module knows, at half the cost.
PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ɏ]")
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


#: What stands for a letter, a number and any other character that the two Unicode versions class differently.
STAND_INS = ("\u01bb", "\u0660", "\ue000")


@lru_cache(maxsize=1)
def _stand_ins() -> dict[int, str]:
    """The public library splits by the Unicode version that it was built with, which
    may be another than this module's. Characters that only one of both takes for
    letters or numbers, each with one of the class that the library gives it."""
    young = "".join(c for c in map(chr, chain(range(0x250, 0xD800), range(0xE000, 0x110000))) if category(c) == "Cn")
    ranks = {bytes([i]): i for i in range(256)}
    theirs, ours = [], []
    for kind in (r"\p{L}", r"\p{N}"):
        found = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(young)
        theirs.append(set(bytes(found).decode("utf-8")))
        ours.append(set(regex.findall(kind, young)))
    letter, number, other = STAND_INS
    odd = (theirs[0] ^ ours[0]) | (theirs[1] ^ ours[1])
    return {ord(c): letter if c in theirs[0] else number if c in theirs[1] else other for c in odd}


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    """What cuts a text into pieces."""
    compiled = regex.compile(pattern)
    full, stand_ins = compiled.findall, _stand_ins()
    odd = re.compile("[\U00010000-\U0010ffff" + "".join(chr(c) for c in sorted(stand_ins) if c < 0x10000) + "]").search

    def exact(text: str) -> list[str]:
        if not odd(text):
            return full(text)
        return [text[m.start():m.end()] for m in compiled.finditer(text.translate(stand_ins))]

    classes = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}0-9]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")
    if "\\p" in classes or not set(re.findall(r"\\(.)", classes)) <= {"s", "S"}:
        return exact
    plain = re.compile(classes).findall
    return lambda text: exact(text) if PLAIN.search(text) else plain(text)


def _encoder(path: str, pattern: str):
    def make():
        encode = Transducer(load_ranks(path)).encode
        # Ids are held as the bytes of 32-bit integers, which are joined at once.
        return _splitter(pattern), _Pieces(lambda piece: array("i", encode(piece)).tobytes())

    return tool("byte_bpe", ("encoder", path, pattern), make)


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    pieces_of, ids_of = _encoder(path, pattern)
    return np.frombuffer(b"".join(map(ids_of.__getitem__, pieces_of(text))), dtype=np.int32)


def encode_column(text: str | Column, path: str, pattern: str) -> Column:
    """An array of ids. ``path``: a rank file that every executor can open."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        ids = [encode_text(t, path, pattern) for t in texts.to_pylist()]
        offsets = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        values = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return encode(clean_text(text))


class Utf8Machine:
    """State 0: between characters. Any other state: the allowed ranges of the
    bytes that the character still needs."""

    #: What may follow a first byte; fixed by the definition of UTF-8.
    FIRST = (
        (0x00, 0x7F, ()), (0xC2, 0xDF, ((0x80, 0xBF),)), (0xE0, 0xE0, ((0xA0, 0xBF), (0x80, 0xBF))),
        (0xE1, 0xEC, ((0x80, 0xBF),) * 2), (0xED, 0xED, ((0x80, 0x9F), (0x80, 0xBF))),
        (0xEE, 0xEF, ((0x80, 0xBF),) * 2), (0xF0, 0xF0, ((0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF))),
        (0xF1, 0xF3, ((0x80, 0xBF),) * 3), (0xF4, 0xF4, ((0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF))),
    )
    BROKEN = -1

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.joined = tokens, pa.array(tokens, pa.binary())
        self.needs: list[tuple] = [()]
        self.numbers = {(): 0}
        self.known: dict[tuple[int, int], int] = {}
        self.whole = np.array([self.over_bytes(0, t) == 0 for t in tokens], dtype=bool)

    def over_bytes(self, state: int, data: bytes) -> int:
        for byte in data:
            if state == self.BROKEN:
                break
            need = self.needs[state]
            if need:
                rest = need[1:] if need[0][0] <= byte <= need[0][1] else None
            else:
                rest = next((r for lo, hi, r in self.FIRST if lo <= byte <= hi), None)
            if rest is None:
                return self.BROKEN
            if rest not in self.numbers:
                self.numbers[rest] = len(self.needs)
                self.needs.append(rest)
            state = self.numbers[rest]
        return state

    def over_token(self, state: int, token: int) -> int:
        after = self.known.get((state, token))
        if after is None:
            after = self.known[state, token] = self.over_bytes(state, self.tokens[token])
        return after

    def run(self, state: int, ids: np.ndarray) -> int:
        """The state after more ids. Ids that are whole characters don't leave state 0,
        so only the stretches between them are stepped through."""
        parts = np.flatnonzero(~self.whole[ids])
        at = 0
        while state != self.BROKEN:
            if state == 0:
                after = np.searchsorted(parts, at)
                at = int(parts[after]) if after < len(parts) else len(ids)
            if at == len(ids):
                break
            state = self.over_token(state, int(ids[at]))
            at += 1
        return state

    def bytes_of(self, ids: np.ndarray) -> bytes:
        taken = self.joined.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:taken.offset + len(taken) + 1]
        return taken.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if len(ids) else b""


class StreamDecoder:
    """Feeds of ids to text: only whole characters come out; bytes that can't be
    text come out as U+FFFD, unfinished ones do so at ``finish``. ``feed_bytes`` and
    ``rest`` give the bytes as they are. ``state`` is 0 while all ids so far are whole
    characters."""

    def __init__(self, machine: Utf8Machine):
        self.machine, self.held, self.state = machine, b"", 0

    def feed_bytes(self, ids) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        self.state = self.machine.run(self.state, ids)
        data = self.held + self.machine.bytes_of(ids)
        cut = len(data)
        if self.state:
            for back in range(1, min(4, len(data)) + 1):
                if data[-back] & 0xC0 != 0x80:
                    if self.machine.over_bytes(0, data[-back:]) > 0:
                        cut = len(data) - back
                    break
        self.held = data[cut:]
        return data[:cut]

    def feed(self, ids) -> str:
        return self.feed_bytes(ids).decode("utf-8", "replace")

    def rest(self) -> bytes:
        rest, self.held = self.held, b""
        return rest

    def finish(self) -> str:
        return self.rest().decode("utf-8", "replace")


def machine_of(path: str) -> Utf8Machine:
    return tool("byte_bpe", ("machine", path), lambda: _machine(path))


def _machine(path: str) -> Utf8Machine:
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, number in ranks.items():
        tokens[number] = token
    return Utf8Machine(tokens)


def decode_column(ids: str | Column, path: str) -> Column:
    """A struct: ``bytes`` of the ids, and ``text``, whether they are whole characters."""

    @F.arrow_udf(T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("text", T.BooleanType())]))
    def decode(lists: pa.Array) -> pa.Array:
        machine = machine_of(path)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        out, good, at = [], [], 0
        for end in ends.tolist():
            decoder = StreamDecoder(machine)
            parts = [decoder.feed_bytes(flat[k:min(k + FEED, end)]) for k in range(at, end, FEED)]
            out.append(b"".join([*parts, decoder.rest()]))
            good.append(decoder.state == 0)
            at = end
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(good, pa.bool_())], ["bytes", "text"])

    return decode(ids)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """The documents with an array of ids each."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, encode_column(text, path, pattern))


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The documents with a struct ``bytes, text`` each."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, decode_column(ids, path))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, whole_text`` of each document."""
    ids = encode(docs.select("doc_id", "text"), path, pattern).drop("text")
    return decode(ids, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded.bytes"), 256).alias("decoded_sha256"),
        F.col("decoded.text").alias("whole_text"),
    )
