"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

A grouped prefix join. Shingles are ordered by how common they are, rarest first.
Two sets that link share a shingle among the first n - ceil(0.75 n) + 1 of each,
their prefixes. Documents with equal sets form a class; classes with equal prefix
and size form a group. Groups that share a prefix shingle stand in one list, and
pairs of a list pass filters of size and of bitmaps before members are verified by
their whole sets. Two rounds keep the pairs few without losing a link:

1. Each group meets the first and the next smaller group of its lists, and each
   member the first of its group. Verified links give components.
2. Where a list holds several components, pairs across components that pass the
   filters are verified: first one of any two components, the most promising, then,
   with the components that gives, all. The smaller of two sets that link has a
   shingle in common with the other among its first n - ceil(6n / 7) + 1. Pairs within a component are connected already, so copies of
   copies are never multiplied out.

How common a shingle is comes from one count per bucket of hashes over all
documents. That is one order for all, so it decides speed and never a result.
Long lists are cut into blocks, and pairs of blocks go to different tasks.

Words are runs of anything but ASCII white space, A-Z lower-cased. A text with
fewer than five words has one shingle, all of it. A null or empty text, or one
without words, has an empty set and links with nothing. Shingles are compared by
64-bit hashes, sets by 128-bit hashes. A component is named by its smallest
``doc_id``; a null ``doc_id`` names none. Repeated rows are members of one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.llm import bloom
from tidemark.llm.common import all_columns, bounded_batches, clean_text, free_name, let_go
from tidemark.llm.components import components
from tidemark.session import staged

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
BUCKET_BITS = 18
BITMAP_BITS = 1024
#: Groups of a list that are compared in one task at most, twice.
BLOCK = 2048
#: Shingles of a bucket, beyond eight times the mean, from which on its rows are dealt out, and over how many tasks.
HOT = 10_000
SPREAD = 64
#: Sets and pairs that a task remembers so as not to send them twice.
REMEMBERED = 200_000
#: Odd multipliers, one for each place of a word in a shingle.
PLACES = tuple(np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 | 1) for k in range(WORDS))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text: ascending 64-bit hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    mixed = hashed[:n] * PLACES[0]
    for k in range(1, WORDS):
        mixed ^= mixed >> np.uint64(29)
        mixed = (mixed + hashed[k:k + n]) * PLACES[k]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, in the order that holds for all sets."""
    n = len(hashes)
    size = n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1
    return hashes[np.lexsort((hashes, common[bucket_of(hashes)]))[:size]] if n else hashes


def early(n: int) -> int:
    """How many shingles of the prefix of a set of n may be the first that it shares with
    a set as large or larger: the two share no more than what follows in either, and sets
    of n and m that link share NUMERATOR / (NUMERATOR + DENOMINATOR) of n + m at least."""
    return n - -(-2 * NUMERATOR * n // (NUMERATOR + DENOMINATOR)) + 1


def bitmap(hashes: np.ndarray, bits: int = BITMAP_BITS) -> bytes:
    """Parity of the shingles that fall on each bit: a set and another differ in at
    least as many shingles as their bitmaps do in bits."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_bits(n: int) -> int:
    """Bits of the wide bitmap of a set of n: four each at least, a power of two."""
    return max(BITMAP_BITS, 1 << (4 * n - 1).bit_length())


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ. The longer one is folded to the shorter:
    a bit counts the shingles whose place agrees in the lower bits."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, size)) ^ np.bitwise_xor.reduce(y.reshape(-1, size))).sum())


def linked(common: np.ndarray, n_a, n_b) -> np.ndarray:
    """Whether sets of these sizes link with so many shingles in common."""
    return DENOMINATOR * common >= NUMERATOR * (n_a + n_b - common)


SKETCH = "doc_id bigint, n int, key binary, bitmap binary, wide binary, counts binary"


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: size and key of its set and its bitmaps. And one row
    per task with ``counts``: shingles of its documents in each bucket, one MB."""

    def describe(batches):
        let_go("ngram_join")
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            for hashes in found:
                np.add.at(total, bucket_of(hashes), 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(h) for h in found], pa.int32()),
                pa.array([_key(h) for h in found], pa.binary()),
                pa.array([bitmap(h) if len(h) else None for h in found], pa.binary()),
                pa.array([bitmap(h, wide_bits(len(h))) if len(h) else None for h in found], pa.binary()),
                pa.nulls(len(found), pa.binary()),
            ], ["doc_id", "n", "key", "bitmap", "wide", "counts"])
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())), pa.array([total.tobytes()], pa.binary())],
            ["doc_id", "n", "key", "bitmap", "wide", "counts"],
        )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_text().alias("text")).mapInArrow(describe, SKETCH)


def bucket_counts(sketched: DataFrame) -> np.ndarray:
    """Shingles of all documents in each bucket; two MB whatever the input."""

    def add(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for held in batch.column("counts").to_pylist():
                total += np.frombuffer(held, np.uint32)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    rows = sketched.where("counts IS NOT NULL").select("counts").coalesce(8).mapInArrow(add, "counts binary").collect()
    return np.sum([np.frombuffer(r.counts, np.int64) for r in rows] or [np.zeros(1 << BUCKET_BITS, np.int64)], axis=0)


def _key(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _group_of(hashes: np.ndarray, own: np.ndarray) -> int:
    """Of a prefix and size. Groups that share a number by chance only meet more often."""
    return xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(hashes)) - (1 << 63)


def lists_of(docs: DataFrame, common) -> DataFrame:
    """``token, gid, late, key``: prefix shingles that two groups or more share, ``key``
    null, and whether they come after the ``early`` ones of the set; and the group of
    each set, ``token`` null.

    The one large shuffle of the join: 17 bytes for each prefix shingle. Rows come
    to a task in order of shingle and group, so it needs to hold only the last one to
    drop those that no other group has. Shingles of a bucket with far more than its share
    are dealt out over ``SPREAD`` tasks and are not dropped."""
    hot = 8 * int(common.value.mean()) + HOT

    def post(batches):
        let_go("ngram_join")
        seen: set[bytes] = set()
        for batch in batches:
            keys, groups, tokens, sizes, lates = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingles(text)
                key = _key(hashes)
                if key is None or key in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                own = prefix(hashes, common.value)
                keys.append(key)
                groups.append(_group_of(hashes, own))
                tokens.append(own)
                sizes.append(len(own))
                lates.append(np.arange(len(own)) >= early(len(hashes)))
            if not keys:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(keys), pa.int64()), pa.array(groups, pa.int64()), pa.array(np.array(groups, np.int64).astype(np.int8)), pa.nulls(len(keys), pa.bool_()), pa.array(keys, pa.binary())],
                ["token", "gid", "spread", "late", "key"],
            )
            flat, owners, late = np.concatenate(tokens), np.repeat(np.array(groups, np.int64), sizes), np.concatenate(lates)
            spread = np.where(common.value[bucket_of(flat)] > hot, 1 + (owners & (SPREAD - 1)), 0).astype(np.int8)
            for at in range(0, len(flat), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[cut].view(np.int64)), pa.array(owners[cut]), pa.array(spread[cut]), pa.array(late[cut]), pa.nulls(len(flat[cut]), pa.binary())],
                    ["token", "gid", "spread", "late", "key"],
                )

    def shared(batches):
        """Copies in different tasks gave equal rows, which stand together; one is left."""
        token, sent = None, False  # the last row so far, and whether it is out
        before = None  # the last group and key
        names = ["token", "gid", "late", "key"]
        for batch in batches:
            grouped = pa.compute.is_null(batch.column("token"))
            if grouped.true_count:
                held = batch.filter(grouped)
                own = list(zip(held.column("gid").to_pylist(), held.column("key").to_pylist()))
                yield held.filter(pa.array([x != y for x, y in zip(own, [before, *own])])).select(names)
                before = own[-1]
                batch = batch.filter(pa.compute.invert(grouped))
            if not batch.num_rows:
                continue
            tokens, groups, spread, late = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "gid", "spread", "late"))
            if token is not None:
                tokens, groups, spread, late = np.append(token, tokens), np.append(group, groups), np.append(dealt, spread), np.append(after, late)
            first = np.append(True, (tokens[1:] != tokens[:-1]) | (groups[1:] != groups[:-1]))
            tokens, groups, spread, late = tokens[first], groups[first], spread[first], late[first]
            if token is not None and len(tokens) == 1:
                continue  # no other row than the last one
            same = tokens[1:] == tokens[:-1]
            keep = np.append(same, False) | np.append(False, same) | (spread > 0)
            last = bool(keep[-1])
            if token is not None and sent:
                keep[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep]), pa.array(groups[keep]), pa.array(late[keep], pa.bool_()), pa.nulls(int(keep.sum()), pa.binary())], names)
            token, group, dealt, after, sent = tokens[-1:], groups[-1:], spread[-1:], late[-1:], last

    posted = docs.select(clean_text().alias("text")).mapInArrow(post, "token bigint, gid bigint, spread tinyint, late boolean, key binary")
    # Nulls would all go to one task, so rows of groups are dealt by the group.
    dealt_by = F.coalesce("token", "gid")
    stood = posted.repartition(dealt_by, "spread").sortWithinPartitions("token", "gid", "late", "key")
    return stood.mapInArrow(shared, "token bigint, gid bigint, late boolean, key binary")


def _cut(rows: DataFrame, by: str) -> DataFrame:
    """Add ``block`` and ``blocks`` to the rows of each token by a hash of a column."""
    # Staged: few lists are that long, and once that is known the rows needn't be shuffled to meet them.
    held = staged(rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    cut = rows.join(held, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return cut.withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks").cast("bigint")).cast("int"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def first_pairs(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Round 1: ``a, b`` keys of classes."""
    leaders = classes.groupBy("gid").agg(F.min("key").alias("leader"), F.min("n").alias("n"))
    sized = _cut(lists, "gid").join(leaders, "gid")
    near = Window.partitionBy("token", "block").orderBy("n", "leader")
    stood = sized.select(
        "n", F.col("leader").alias("own"),
        F.lag(F.struct("n", "leader")).over(near).alias("before"),
        F.first(F.struct("n", "leader")).over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("start"),
    )
    pairs = stood.select("n", "own", F.explode(F.array("before", "start")).alias("o")).where(
        F.col("o").isNotNull() & (F.col("o.leader") != F.col("own")) & (DENOMINATOR * F.col("o.n") >= NUMERATOR * F.col("n"))
    ).select(*_ordered("own", "o.leader"))
    inside = classes.join(leaders, "gid").where("key <> leader").select(*_ordered("key", "leader"))
    return pairs.unionByName(inside).distinct()


def passing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that the wide bitmaps don't rule out."""

    @F.arrow_udf(T.BooleanType())
    def may(wide_a: pa.Array, wide_b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        n, m = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (n_a, n_b))
        apart = np.array([differing(a, b) for a, b in zip(wide_a.to_pylist(), wide_b.to_pylist())], np.int64)
        return pa.array(linked((n + m - apart) // 2, n, m))

    side = {s: classes.select(F.col("key").alias(s), F.col("wide").alias(f"wide_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab"}
    joined = pairs.join(side["a"], "a").join(side["b"], "b")
    return joined.where(may("wide_a", "wide_b", "n_a", "n_b")).select("a", "b")


def placed(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``gid, key, n, bitmap, root`` of each class."""
    return classes.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select(
        "gid", "key", "n", "bitmap", F.coalesce("root", "key").alias("root")
    )


def mixed(lists: DataFrame, own: DataFrame) -> DataFrame:
    """``token, gid, late, blocks``: the lists that hold several components, in blocks. A
    list that holds one now always will, so the next step looks at these only.

    Two sets that link have an early shingle of the smaller one in common, so late rows
    stay only with an early one that is no larger and not too small."""
    root = F.xxhash64("root")
    held = own.groupBy("gid").agg(F.min("n").alias("n"), F.min(root).alias("lo"), F.max(root).alias("hi"), F.count(F.lit(1)).alias("m"))
    sized = lists.select("token", "gid", "late").join(held, "gid")
    of_early = F.when(~F.col("late"), F.col("n"))
    several = sized.groupBy("token").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks"),
        F.min(of_early).alias("least"), F.max(of_early).alias("most"),
    ).where("lo <> hi AND least IS NOT NULL").select("token", "blocks", "least", "most")
    near = (F.col("n") >= F.col("least")) & (DENOMINATOR * F.col("most") >= NUMERATOR * F.col("n"))
    rows = sized.select("token", "gid", "late", "n").join(several, "token").where(~F.col("late") | near)
    return staged(rows.select("token", "gid", "late", "blocks"))


def across(lists: DataFrame, own: DataFrame, once: bool) -> DataFrame:
    """Round 2: pairs of a list in different components that the filters don't rule
    out. ``once``: of any two components a task gives the most promising pair of those
    that it holds at a time, and later ones only if they promise more.

    ``lists`` as from ``mixed``, ``own`` as from ``placed``."""
    cut = lists.join(own, "gid").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks").cast("bigint")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "late", "key", "root", "bitmap"
    )

    def compare(batches):
        seen: dict[bytes, float] = {}

        def pairs_of(rows: pa.Table):
            """Rows of whole groups in order: each meets the one that stands d rows on, for all d."""
            size = rows.num_rows
            token, i, j, block, n, late = (rows.column(c).to_numpy().astype(np.int64) for c in ("token", "i", "j", "block", "n", "late"))
            key, root, maps = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint64).reshape(size, -1) for c in ("key", "root", "bitmap"))
            starts = np.append(True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            begin = np.flatnonzero(starts)
            end = np.append(begin[1:], size)[np.cumsum(starts) - 1]
            x = np.arange(size)
            for d in range(1, size):
                x = x[(x + d < end[x])]
                if not len(x):
                    return
                y = x + d
                near = DENOMINATOR * n[x] >= NUMERATOR * n[y]  # rows of a group come by size
                x = x[near]
                y = x + d
                meet = (root[x] != root[y]).any(axis=1) & (late[x] == 0) & ((i[x] == j[x]) | (block[x] != block[y]))
                a, b = x[meet], y[meet]
                for at in range(0, len(a), 1 << 14):
                    p, q = a[at:at + (1 << 14)], b[at:at + (1 << 14)]
                    most = (n[p] + n[q] - np.bitwise_count(maps[p] ^ maps[q]).sum(axis=1).astype(np.int64)) // 2
                    good = np.flatnonzero(linked(most, n[p], n[q]))
                    promise = most[good] / (n[p[good]] + n[q[good]] - most[good])
                    for one, two, hope in zip(p[good].tolist(), q[good].tolist(), promise.tolist()):
                        pair = b"".join(sorted((key[one].tobytes(), key[two].tobytes())))
                        yield b"".join(sorted((root[one].tobytes(), root[two].tobytes()))) if once else pair, pair, hope if once else 0.0

        def sent(rows: pa.Table):
            best: dict[bytes, tuple[float, bytes]] = {}
            for known, pair, hope in pairs_of(rows):
                if hope > best.get(known, (seen.get(known, -1.0),))[0]:
                    best[known] = (hope, pair)
            if len(seen) + len(best) > REMEMBERED:
                seen.clear()
            seen.update((known, hope) for known, (hope, _) in best.items())
            out = [pair for _, pair in best.values()]
            return pa.RecordBatch.from_arrays([pa.array([p[:16] for p in out], pa.binary()), pa.array([p[16:] for p in out], pa.binary())], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 8192:
                continue
            rows = pa.Table.from_batches(held)
            last = np.array([rows.column(c).to_numpy() for c in ("token", "i", "j")])
            own = int(np.flatnonzero((last != last[:, -1:]).any(axis=0)).max(initial=-1)) + 1  # where the last group begins
            if own:
                yield sent(rows.slice(0, own))
                held = rows.slice(own).to_batches()
        if held:
            yield sent(pa.Table.from_batches(held))

    order = ["token", "i", "j", "n", "key"]
    return met.repartition("token", "i", "j").sortWithinPartitions(*order).mapInArrow(compare, "a binary, b binary").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, hashes`` of the wanted classes and maybe a few others, read again from
    one document each. ``wanted``: ``doc_id``. A bounded Bloom filter keeps the
    other texts away from Python and from the shuffle; it has no nulls, so all
    texts without a ``doc_id`` are read."""
    blocks = bloom.blocks_for(wanted.count())
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_text().alias("text"))
    near = bloom.mark(plain, "doc_id", bloom.build(wanted, "doc_id", blocks), blocks, "hit").where("hit OR doc_id IS NULL").select("text")

    def read(batches):
        seen: set[bytes] = set()
        for batch in batches:
            found = {}
            for text in batch.column("text").to_pylist():
                hashes = shingles(text)
                key = _key(hashes)
                if key is not None and key not in seen:
                    found[key] = hashes.tobytes()
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["key", "hashes"])

    return near.mapInArrow(read, "key binary, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose whole sets link."""
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = staged(sets_of(docs, staged(classes.join(ends, "key", "left_semi").select("doc_id"))))

    @F.arrow_udf(T.BooleanType())
    def link(sets_a: pa.Array, sets_b: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(sets_a, sets_b):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            out.append(bool(linked(int((both[1:] == both[:-1]).sum()), len(x), len(y))))
        return pa.array(out)

    side = {s: sets.select(F.col("key").alias(s), F.col("hashes").alias(f"set_{s}")) for s in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").where(link("set_a", "set_b")).select("a", "b")


def members(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark, 500)
    described = staged(sketches(docs))
    common = spark.sparkContext.broadcast(bucket_counts(described))
    described = described.where("counts IS NULL").select("doc_id", "n", "key", "bitmap", "wide")
    posted = staged(lists_of(docs, common))
    lists = posted.where("key IS NULL").select("token", "gid", "late")
    classes = staged(
        described.where("key IS NOT NULL").groupBy("key").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("wide").alias("wide")
        ).join(posted.where("key IS NOT NULL").select("key", "gid"), "key")
    )
    one = staged(verified(staged(passing(staged(first_pairs(lists, classes)), classes)), docs, classes))
    roots = components(one)
    groups = classes.groupBy("gid").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("gid").alias("token"), "gid", F.lit(False).alias("late"))
    left = lists.unionByName(groups)
    # First one pair of any two components, which joins most of those that belong together, then all that are left.
    for once in (True, False):
        own = placed(classes, roots)
        left = mixed(left, own)
        found = staged(verified(staged(passing(staged(across(left, own, once)), classes)), docs, classes))
        if not found.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    nodes = roots
    named = classes.select("key", "doc_id").join(nodes.select(F.col("node").alias("key"), "root"), "key")
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    of_class = classes.select("key", "doc_id").join(named.join(least, "root").select("key", "least"), "key", "left").select(
        "key", F.coalesce("least", "doc_id").alias("component_id")
    )
    of_class = staged(of_class)
    with_set = described.where("key IS NOT NULL").select("doc_id", "n", "key").join(of_class, "key")
    empty = described.where("key IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return with_set.select("doc_id", "n", "component_id").unionByName(empty).select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that name their component, with all their columns. Documents
    without a ``doc_id`` stay, as do all rows that repeat one that stays."""
    going = staged(members(docs).where("doc_id <> component_id").select("doc_id").distinct())
    blocks = bloom.blocks_for(going.count())
    hit, own = free_name(docs, "hit"), all_columns(docs)
    marked = bloom.mark(docs, "doc_id", bloom.build(going, "doc_id", blocks), blocks, hit)
    stay = marked.where(F.col(hit)).join(going, "doc_id", "left_anti").select(*own)
    return marked.where(~F.col(hit)).select(*own).union(stay)
