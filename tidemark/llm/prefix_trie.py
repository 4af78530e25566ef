"""Prefix trie of conversations by a splitter skeleton.

A conversation is the path of its turns from the root, a node the distinct
sequence of the first turns of one or more of them. A turn is written as 20 bytes:
half of the SHA-256 of role and text, and the length of the text. A path is these
bytes one after another, so that paths in byte order walk the trie.

Paths are cut into shards by splitters, pairs of a path and a conversation id that
a sample gives. A shard is sorted and walked with one stack of open nodes. A node
whose members lie in two shards has a splitter between them, so it is the
beginning of a splitter: the trie of the splitters, the skeleton, holds every such
node. It is broadcast. All other nodes are finished in their shard; for those of
the skeleton the shards give partial sums, which are added up, and sums over
subtrees follow from the skeleton's order. A group of equal paths is cut by the
ids, so a third of all conversations may be one.

``PREFIX`` and ``FAMILY``: conversation c is rebuilt from the first
crc32(c) % ``PREFIX`` turns of the conversation c - c % ``FAMILY`` and its own turns
after as many (the remainder as SQL has it, with the sign of c).

Turns are in order of ``turn``, null first; those of one turn by their bytes as
above. A null role or text is empty. Repeated rows are turns like any other. Rows
without ``conv_id`` belong to no conversation and are left out. A conversation left
without turns is a member of the root. An empty table has no node. Texts of any
length count 20 bytes; a conversation's turns are one row of such bytes. Other
columns may have any name.

The ids that end at a node are hashed in ascending order. A hash can't be made
from parts, so a skeleton node's ids pass one task, in pieces of up to
``PIECE`` bytes that the shards have joined, one piece at a time.
"""

from __future__ import annotations

import bisect
import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import clean_text
from tidemark.session import staged

PREFIX = 9
FAMILY = 5
UNIT = 20
#: Conversations of a shard, about, and of the sample for each splitter.
SHARD_ROWS = 500_000
SAMPLED = 20
#: Bytes of all splitters at most; longer ones are cut, which moves the borders of shards and nothing else.
SPLITTER_BYTES = 16 << 20
#: Bytes of joined ids at most in one row.
PIECE = 1 << 20

NODE = "depth int, parent bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"
WALKED = f"skeleton int, parent_skeleton int, {NODE}, piece bigint"


def turn_unit() -> Column:
    """40 hex digits: half of the hash of role and text, and the bytes of the text."""
    role, text = clean_text("role").cast("binary"), clean_text("text").cast("binary")
    tagged = F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role, text)
    return F.concat(F.substring(F.sha2(tagged, 256), 1, 32), F.lpad(F.lower(F.hex(F.octet_length(text))), 8, "0"))


def rebuilt(turns: DataFrame, prefix: int = PREFIX, family: int = FAMILY) -> DataFrame:
    """``conv_id``, ``path``. One shuffle: a family's conversations meet in it."""
    of = F.col("conv_id")
    units = turns.where("conv_id IS NOT NULL").select(
        of.cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), turn_unit().alias("unit")).alias("t")
    ).withColumn("family", of - of % family)
    own = units.repartition("family").groupBy("family", "conv_id").agg(
        F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t.unit), "")).alias("own")
    )
    held = F.crc32(of.cast("string").cast("binary")) % prefix * UNIT
    first = F.max(F.when(of == F.col("family"), F.substring("own", 1, (prefix - 1) * UNIT))).over(Window.partitionBy("family"))
    begin = F.coalesce(F.expr("substring(first, 1, int(held))"), F.unhex(F.lit("")))
    return own.withColumns({"first": first, "held": held}).select(
        "conv_id", F.concat(begin, F.expr("substring(own, int(held) + 1)")).alias("path")
    )


class Skeleton:
    """The splitters and the trie of their paths, nodes numbered in preorder."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.depth, self.parent, self.last, self.size = [0], [-1], [0], [0]
        self.children: dict[tuple[int, bytes], int] = {}
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path) - UNIT + 1, UNIT):
                key = (node, path[at:at + UNIT])
                if key not in self.children:
                    self.children[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.parent.append(node)
                    self.last.append(len(self.last))
                    self.size.append(int.from_bytes(path[at + UNIT - 4:at + UNIT], "big"))
                node = self.children[key]
        for node in range(len(self.depth) - 1, 0, -1):
            self.last[self.parent[node]] = max(self.last[self.parent[node]], self.last[node])


def splitters_of(paths: DataFrame, shards: int, rows: int) -> list[tuple[bytes, int]]:
    """Up to ``shards`` - 1 borders, of a sample by the hash of the id. The sample's
    bytes are bounded by its number of rows and the cut of each path."""
    if shards < 2 or not rows:
        return []
    cut = max(UNIT, SPLITTER_BYTES // shards // UNIT * UNIT)
    share = min(1.0, shards * SAMPLED / rows)
    place = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = sorted(
        (bytes(r[0]), r[1]) for r in paths.where(place < share).select(F.substring("path", 1, cut), "conv_id").collect()
    )
    return sorted({sample[i * len(sample) // shards] for i in range(1, shards)}) if sample else []


class _Open:
    """A node on the stack of the walk."""

    __slots__ = ("skeleton", "size", "first", "members", "children", "leaves", "saved", "hash", "ids", "rows")

    def __init__(self, skeleton: int | None, size: int):
        self.skeleton, self.size = skeleton, size
        self.first, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.hash, self.ids, self.rows = None, None, []


class Walk:
    """One shard in order of path and id. Finished rows wait only for the id of
    their parent, and are taken from ``out``."""

    def __init__(self, children: dict[tuple[int, bytes], int]):
        self.children = children
        self.stack: list[_Open] = []
        self.path, self.out, self.pieces = b"", [], 0

    def add(self, path: bytes, conv_id: int) -> None:
        stack = self.stack
        if not stack:
            stack.append(_Open(0, 0))
        if path != self.path or len(stack) == 1:
            old, at = self.path, 0
            end = min(len(old), len(path))
            while at < end and old[at:at + UNIT] == path[at:at + UNIT]:
                at += UNIT
            while len(stack) > at // UNIT + 1:
                self._close()
            for at in range(at, len(path), UNIT):
                unit, above = path[at:at + UNIT], stack[-1].skeleton
                mark = self.children.get((above, unit)) if above is not None else None
                stack.append(_Open(mark, int.from_bytes(unit[-4:], "big")))
            self.path = path
        node = stack[-1]
        node.members += 1
        if node.first is None or conv_id < node.first:
            node.first = conv_id
        text = str(conv_id).encode()
        if node.skeleton is None:
            if node.hash is None:
                node.hash = hashlib.sha256(text)
            else:
                node.hash.update(b"," + text)
        else:
            if node.ids is None:
                node.ids = bytearray(text)
            elif len(node.ids) + len(text) < PIECE:
                node.ids += b"," + text
            else:
                self._piece(node.skeleton, bytes(node.ids))
                node.ids = bytearray(text)

    def _piece(self, skeleton: int, ids: bytes) -> None:
        self.out.append((skeleton, None, None, None, None, None, None, None, None, ids.decode(), self.pieces))
        self.pieces += 1

    def _close(self) -> None:
        node = self.stack.pop()
        depth, above = len(self.stack), self.stack[-1] if self.stack else None
        if above is not None:
            above.members += node.members
            above.first = node.first if above.first is None else min(above.first, node.first)
        if node.skeleton is not None:
            if node.ids is not None:
                self._piece(node.skeleton, bytes(node.ids))
            self.out.append((node.skeleton, None, None, None, node.first, node.members, node.children, node.leaves, node.saved, None, None))
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.members - 1) * node.size
        self.out.extend((None, None, d, node.first, *r) for d, *r in node.rows)
        ends = (node.hash or hashlib.sha256()).hexdigest()
        own = (node.first, node.members, node.children, leaves, saved, ends, None)
        if above.skeleton is None:
            above.rows.append((depth, *own))
        else:
            self.out.append((None, above.skeleton, depth, None, *own))
        above.children += 1
        above.leaves += leaves
        above.saved += saved

    def finish(self) -> None:
        while self.stack:
            self._close()


def _walked(paths: DataFrame, skeleton: Skeleton, shards: int) -> DataFrame:
    """Rows of ``WALKED``: finished nodes; partial sums of skeleton nodes; pieces of their ids."""
    context = paths.sparkSession.sparkContext
    plain = context.broadcast(skeleton.splitters)
    trie = context.broadcast(skeleton.children)

    @F.arrow_udf("int")
    def shard(path: pa.Array, conv_id: pa.Array) -> pa.Array:
        borders = plain.value
        return pa.array([bisect.bisect_right(borders, p) for p in zip(path.to_pylist(), conv_id.to_pylist())], pa.int32())

    names = [f.split()[0] for f in WALKED.split(", ")]
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.split()[1]] for f in WALKED.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for batch in batches:
            for number, path, conv_id in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id"))):
                if number != now:
                    if state is not None:
                        state.finish()
                        yield packed(state.out)
                    state, now = Walk(trie.value), number
                    # Pieces of a node are in order of their shards, and in a shard of their making.
                    state.pieces = number << 32
                state.add(path, conv_id)
                if len(state.out) >= 10_000:
                    yield packed(state.out)
                    state.out = []
        if state is not None:
            state.finish()
            yield packed(state.out)

    dealt = paths.withColumn("shard", shard("path", "conv_id")).repartitionById(shards, F.col("shard"))
    return dealt.sortWithinPartitions("shard", "path", "conv_id").select("shard", "path", "conv_id").mapInArrow(walk, WALKED)


def _ends(pieces: DataFrame) -> DataFrame:
    """``skeleton, ends_sha256``: pieces of ids in order through one running hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed, found = None, None, []
        for batch in batches:
            for node, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist()):
                if node != now:
                    if now is not None:
                        found.append((now, hashed.hexdigest()))
                    now, hashed = node, hashlib.sha256()
                else:
                    hashed.update(b",")
                hashed.update(ids.encode())
        if now is not None:
            found.append((now, hashed.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())], ["skeleton", "ends_sha256"]
        )

    ordered = pieces.select("skeleton", "piece", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "piece")
    return ordered.mapInArrow(run, "skeleton int, ends_sha256 string")


def _skeleton_nodes(walked: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The nodes of the skeleton. Partial sums are added up by node; a subtree is a
    range of preorder numbers, so its sums are differences of running sums. The
    skeleton has ``SPLITTER_BYTES`` / ``UNIT`` nodes at most."""
    spark = walked.sparkSession
    shape = spark.createDataFrame(pa.table({
        "skeleton": pa.array(range(len(skeleton.depth)), pa.int32()), "depth": pa.array(skeleton.depth, pa.int32()),
        "above": pa.array(skeleton.parent, pa.int32()), "last": pa.array(skeleton.last, pa.int32()),
        "size": pa.array(skeleton.size, pa.int64()), "inner": pa.array(np.bincount(np.array(skeleton.parent[1:], dtype=np.int64), minlength=len(skeleton.depth)), pa.int64()),
    }))
    sums = walked.where("skeleton IS NOT NULL AND n_convs IS NOT NULL").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    children = F.col("n_children") + F.col("inner")
    whole = staged(shape.join(sums, "skeleton").select(
        "skeleton", "depth", "above", "last", "conv_id", "n_convs", children.alias("n_children"),
        F.when(children == 0, 1).otherwise(F.col("n_leaves")).alias("leaves"),
        (F.col("saved_tokens") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("size")).otherwise(0)).alias("saved"),
    ))
    upto = Window.orderBy("skeleton")
    running = whole.select("skeleton", F.sum("leaves").over(upto).alias("sum_leaves"), F.sum("saved").over(upto).alias("sum_saved"))
    to = running.select(F.col("skeleton").alias("last"), F.col("sum_leaves").alias("to_leaves"), F.col("sum_saved").alias("to_saved"))
    ends = _ends(walked.where("piece IS NOT NULL"))
    parents = whole.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("parent"))
    return (
        whole.join(running, "skeleton").join(to, "last").join(ends, "skeleton", "left").join(parents, "above", "left")
        .select(
            "skeleton", "depth", "parent", "conv_id", "n_convs", "n_children",
            (F.col("to_leaves") - F.col("sum_leaves") + F.col("leaves")).alias("n_leaves"),
            (F.col("to_saved") - F.col("sum_saved") + F.col("saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def nodes_of(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of ``conv_id, path`` (staged): ``conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = paths.sparkSession
    rows = paths.count()
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_ROWS))
    skeleton = Skeleton(splitters_of(paths, shards, rows))
    walked = staged(_walked(paths, skeleton, len(skeleton.splitters) + 1))
    top = staged(_skeleton_nodes(walked, skeleton))
    own = walked.where("skeleton IS NULL")
    shared = top.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("top"))
    below = own.join(shared, "parent_skeleton", "left").select(
        "conv_id", "depth", F.coalesce("parent", "top").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.col("ends").alias("ends_sha256"),
    )
    above = top.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return below.unionByName(above).withColumn("depth", F.col("depth").cast("bigint"))


def trie(turns: DataFrame, prefix: int = PREFIX, family: int = FAMILY, shards: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of ``conv_id, turn, role, text``."""
    return nodes_of(staged(rebuilt(turns, prefix, family)), shards)
