"""Token ids in files that can be read in part.

A shard is one file: independent zstandard frames of ``FRAME_IDS`` ids as
little-endian unsigned 32-bit integers, then a skippable frame with the seek
table: for each frame its compressed size, its plain size and the CRC-32 of the
plain bytes, and a footer with the number of frames. To read some documents, a
reader takes the table and decompresses only the frames that hold their ids.
Frames don't stop at documents, so a document of any length is written and read
in bounded memory.

Shards hold documents in ascending ``doc_id``; rows with the same ``doc_id`` stand
side by side by a hash of their text, a null ``doc_id`` comes first. A null text
is empty and has the end id only. An empty table writes no shard. Ids are those of
the tokenizer file as given: where a text quotes an added token such as
``<|endoftext|>``, it has that token's id.

Files are written under a name of the attempt and then moved to their own name,
so that a repeated task replaces a file by an equal one. The folder must be one
that every executor reaches through ``pyarrow.fs``, by URI or shared path.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import bounded_batches, clean_text, tool

FRAME_IDS = 1 << 14
LEVEL = 3
#: Fixed values of the public seekable format: skippable frame, footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
CHECKSUMS = 0x80

CHUNKS = 300_000
CHUNK_CHARS = 64
#: Characters that str.split takes for white space and the tokenizer doesn't.
ODD = re.compile("[\x1c-\x1f]")
#: Chunks that are encoded in one text; in a longer one each costs the library more.
TOGETHER = 200
#: Chunks that the usual tokenizer takes for at most three words: signs, letters, signs. No apostrophe, which may begin a contraction.
SIGNS = "[!-&(-/:-@\\[-`{-~]"
PLAIN = re.compile(f"({SIGNS}*+)([A-Za-z]*+)({SIGNS}*+)")


class ShardWriter:
    """Appends ids; ``close`` writes the seek table."""

    def __init__(self, sink):
        self.sink, self.frames, self.held, self.count = sink, [], [], 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= FRAME_IDS:
            rest = np.concatenate(self.held)
            cut = len(rest) - len(rest) % FRAME_IDS
            for i in range(0, cut, FRAME_IDS):
                self._frame(rest[i:i + FRAME_IDS])
            self.held, self.count = [rest[cut:]], len(rest) - cut

    def _frame(self, ids: np.ndarray) -> None:
        plain = ids.astype("<u4").tobytes()
        packed = self.packer.compress(plain)
        self.sink.write(packed)
        self.frames.append((len(packed), len(plain), zlib.crc32(plain)))

    def close(self) -> None:
        if self.count:
            self._frame(np.concatenate(self.held))
        table = b"".join(ENTRY.pack(*f) for f in self.frames) + FOOTER.pack(len(self.frames), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class ShardReader:
    """Ids by position; holds one frame at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        frames, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table")
        table = frames * ENTRY.size + FOOTER.size
        source.seek(size - table - 8)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE, table):
            raise ValueError("broken seek table")
        self.entries = np.frombuffer(source.read(frames * ENTRY.size), dtype="<u4").reshape(-1, 3)
        self.places = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()
        self.frame, self.ids, self.frames_read = -1, np.zeros(0, "<u4"), 0

    def _load(self, frame: int) -> np.ndarray:
        if frame != self.frame:
            self.source.seek(int(self.places[frame]))
            plain = self.unpacker.decompress(self.source.read(int(self.entries[frame, 0])), max_output_size=int(self.entries[frame, 1]))
            if zlib.crc32(plain) != int(self.entries[frame, 2]):
                raise ValueError(f"frame {frame} is damaged")
            self.frame, self.ids = frame, np.frombuffer(plain, dtype="<u4")
            self.frames_read += 1
        return self.ids

    def parts(self, start: int, count: int):
        """The ids from ``start`` on, frame by frame."""
        while count > 0:
            frame, at = divmod(start, FRAME_IDS)
            ids = self._load(frame)[at:at + count]
            yield ids
            start, count = start + len(ids), count - len(ids)


class _Chunks(dict):
    """Ids of chunks of text between white space, as bytes, in two generations."""

    def __init__(self, limit: int = CHUNKS):
        super().__init__()
        self.limit, self.old = limit, {}

    def learn(self, chunks: set[str], encode) -> list[str]:
        """Make all these chunks known; gives those to forget again. Only what a
        batch needs itself may exceed the limit."""
        new = chunks.difference(self)
        if len(self) + len(new) > self.limit:
            self.old = dict(self)
            self.clear()
            new = chunks
        old = self.old
        self.update((c, old[c]) for c in new if c in old)
        fresh = [c for c in new if c not in old]
        if fresh:
            self.update(zip(fresh, encode(fresh)))
        return [c for c in fresh if len(c) > CHUNK_CHARS]


def _tokenizer(path: str, added: bool):
    return tool("token_files", (path, added), lambda: _made_tokenizer(path, added))


def _made_tokenizer(path: str, added: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = not added
    zero = made.encode("0", add_special_tokens=False).ids
    contents = [t.content for t in made.get_added_tokens_decoder().values()] if added else []
    # Their case may not matter to the tokenizer. The marks that they begin with are quickly looked for.
    quoted = re.compile("|".join(map(re.escape, contents)), re.I)
    marks = {re.match(r"[!-@\[-`{-~]*", c)[0] for c in contents}

    def whole(text: str) -> bool:
        return bool(ODD.search(text)) or any(m in text for m in marks) and bool(quoted.search(text))

    def by_words(chunk: str) -> bytes:
        """Ids of a plain chunk, word by word by the library's model."""
        return array("I", [t.id for word in PLAIN.fullmatch(chunk).groups() if word for t in made.model.tokenize(word.lower())]).tobytes()

    signs = "".join(re.findall(SIGNS, "".join(map(chr, range(33, 127)))))
    shown = [a + "The" + b for a in ("", *signs) for b in ("", *signs)]
    shown += [signs, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    plain = all(
        array("I", e.ids).tobytes() == by_words(c) for c, e in zip(shown, made.encode_batch_fast(shown, add_special_tokens=False))
    )
    return made, zero[0] if len(zero) == 1 else None, whole, by_words if plain else None, _Chunks()


def encode_texts(texts: list[str], path: str, added: bool = False) -> list[np.ndarray]:
    """Ids of each text by the tokenizers library. ``added``: tokens added to the
    vocabulary are recognised in the text, as the library does unless told not to;
    texts that may hold one are encoded whole. Otherwise they are text like any other.

    The library drops white space and never merges across it, so equal chunks between white space have equal ids and are
    encoded once while they are remembered. New chunks of ASCII letters and signs are given to the library's
    model word by word, if the tokenizer is seen to split them so when it is loaded; others are encoded
    ``TOGETHER`` in one text, with the digit 0, a token by itself, between them."""
    tokenizer, zero, whole, by_words, chunks = _tokenizer(path, added)

    def by_library(values: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(values, add_special_tokens=False)]

    def of_chunks(values: list[str]) -> list[bytes]:
        found = {v: by_words(v) for v in values if PLAIN.fullmatch(v)} if by_words else {}
        apart = [v for v in values if v not in found and (zero is None or "0" in v)]
        found.update(zip(apart, by_library(apart)))
        rest = [v for v in values if v not in found]
        joined = [rest[i:i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        for own, data in zip(joined, by_library([" 0 ".join(own) for own in joined])):
            cuts = 4 * np.flatnonzero(np.frombuffer(data, dtype="<u4") == zero)
            starts, ends = [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)]
            found.update((v, data[a:b]) for v, a, b in zip(own, starts, ends, strict=True))
        return [found[v] for v in values]

    out = []
    for at in range(0, len(texts), 256):
        batch = texts[at:at + 256]
        split = [None if whole(t) else (t.lower() if t.isascii() else t).split() for t in batch]
        forget = chunks.learn(set(chain.from_iterable(s for s in split if s)), of_chunks)
        for text, own in zip(batch, split):
            data = by_library([text])[0] if own is None else b"".join(map(chunks.__getitem__, own))
            out.append(np.frombuffer(data, dtype="<u4"))
        for chunk in forget:
            del chunks[chunk]
    return out


def _open(folder: str):
    """The file system and path of a folder, given by URI or by path."""
    place = folder if re.match(r"[a-z0-9+]+:", folder) else os.path.abspath(folder)
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", place))


INDEX = "shard bigint, doc_id bigint, place bigint, at bigint, n_tokens bigint"


def write(docs: DataFrame, folder: str, path: str, end_id: int = 1) -> DataFrame:
    """Write shards; gives their index, one row per document: ``shard, doc_id,
    place`` (in the shard), ``at`` (ids before it in the shard), ``n_tokens`` (with
    the end id). The files are written when the index is read, so stage it once."""
    bounded_batches(docs.sparkSession, 500)
    where, base = _open(folder)
    where.create_dir(base, recursive=True)

    def shard(batches):
        number = TaskContext.get().partitionId()
        where, base = _open(folder)
        name, writer, place, at = f"{base}/part-{number:06d}.ids", None, 0, 0
        own = f"{base}/.{uuid.uuid4().hex}"
        sink = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = where.open_output_stream(own)
                writer = ShardWriter(sink)
            counts = []
            for ids in encode_texts(batch.column("text").to_pylist(), path, added=True):
                writer.append(np.append(ids, np.uint32(end_id)))
                counts.append(len(ids) + 1)
            n = len(counts)
            ends = np.cumsum(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number, dtype=np.int64)), batch.column("doc_id"),
                pa.array(np.arange(place, place + n, dtype=np.int64)),
                pa.array(at + ends - np.array(counts, dtype=np.int64)), pa.array(np.array(counts, dtype=np.int64)),
            ], ["shard", "doc_id", "place", "at", "n_tokens"])
            place, at = place + n, at + int(ends[-1])
        if writer is not None:
            writer.close()
            sink.close()
            where.move(own, name)

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_text().alias("text"))
    ordered = plain.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(shard, INDEX)


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before. One total per shard is summed
    up in a window; their number is that of the shards, not of the documents."""
    from pyspark.sql import Window

    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return index.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("at")).drop("before")


def read(index: DataFrame, folder: str, what, fields: str):
    """Apply ``what(parts)`` to the ids of each indexed document. ``parts`` yields
    arrays of ids; the result is a tuple of the columns ``fields``. Index rows in
    order of shard and place decompress each frame once."""
    names = [f.split()[0] for f in fields.split(",")]

    def documents(batches):
        where, base = _open(folder)
        open_shard, reader, source = None, None, None
        for batch in batches:
            rows = batch.to_pydict()
            found = []
            for shard, at, count in zip(rows["shard"], rows["at"], rows["n_tokens"]):
                if shard != open_shard:
                    if source is not None:
                        source.close()
                    source = where.open_input_file(f"{base}/part-{shard:06d}.ids")
                    open_shard, reader = shard, ShardReader(source)
                found.append(what(reader.parts(at, count)))
            columns = [pa.array([f[i] for f in found]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), *columns], ["doc_id", "start", "n_tokens", *names])
        if source is not None:
            source.close()

    return index.select("shard", "doc_id", "at", "start", "n_tokens").mapInArrow(documents, f"doc_id bigint, start bigint, n_tokens bigint, {fields}")


def crc_of(parts) -> tuple[int]:
    crc = 0
    for ids in parts:
        crc = zlib.crc32(ids.tobytes(), crc)
    return (crc,)


def ids_of(parts) -> tuple[list[int]]:
    return (list(chain.from_iterable(p.tolist() for p in parts)),)


def write_and_check(spark: SparkSession, docs: DataFrame, folder: str, path: str, end_id: int = 1) -> DataFrame:
    """Write all documents, read all files back: ``doc_id, start, n_tokens, ids_crc32``."""
    from tidemark.session import staged

    index = staged(write(docs, folder, path, end_id))
    return read(with_starts(index), folder, crc_of, "ids_crc32 bigint")
