"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products.

Equal vectors of a label form one class with a weight. Classes go to the cell of
their nearest centroid, their home, and as guests to every cell c with
``score(home) - score(c) <= |x - y| / 2 * |home - c|``, where ``|x - y|`` is the
largest distance of two vectors that link. For such x and y with homes a and b,
``(xa - xb) + (yb - ya) = (x - y)(a - b)``, so one of the two is within the bound:
any two vectors that link meet in the home of one of them. Guests of a cell don't
compare among themselves: homes are cut into blocks by a hash, guests into blocks
of their own, and a group is one block of homes with one more block, so it is
bounded. Within it cosines are one matrix product in double precision, of homes
with all. Groups return the links of each class as a number and a star of what
they connect, never all pairs.

Vectors compare only within a label that is not null, and only if equally long.
Null and zero vectors, those with null or non-finite components, and rows with a
null ``vec_id`` link with nothing. Of a component the smallest ``vec_id`` is kept.
Repeated rows are vectors of their own. Ties between centroids go to the first.
An empty table gives no rows. Centroids are fitted on a sample of ``SAMPLE`` classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import bounded_batches
from tidemark.llm.components import components
from tidemark.session import staged

SAMPLE = 20_000
#: Classes that a cell of one label is meant to hold, and blocks that it is cut into.
CELL_ROWS = 512
MAX_CELLS = 4096
BLOCK = 1024
#: Blocks of homes that make a block of guests.
GUEST_BLOCKS = 4
#: Numbers that the sample for the centroids may hold, whatever the length of its vectors.
SAMPLE_VALUES = 1 << 23
ITERATIONS = 12
THRESHOLD = 0.93


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    whole = vectors.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, cells: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Centroids of length 1. They start at evenly spaced rows; an empty cell keeps its centroid."""
    centers = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(iterations):
        home = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centers[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centers


def _usable() -> Column:
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole & some, F.lit(False))


def classes_of(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, embedding, class`` of the vectors that can link. Floats stay
    floats until a product is computed, which halves what is shuffled."""
    kind = "float" if vectors.select("embedding").schema[0].dataType == T.ArrayType(T.FloatType()) else "double"
    plain = vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    key = F.unhex(F.md5(F.concat_ws("|", F.col("label").cast("string"), F.col("embedding").cast("string"))))
    return plain.where(_usable()).withColumn("class", key)


def fit_cells(classes: DataFrame, cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centroids for each vector length, from at most ``sample`` classes and
    ``SAMPLE_VALUES`` numbers by hash."""
    counts = classes.groupBy(F.size("embedding").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")
    ).orderBy(F.desc("n")).limit(16).collect()
    found = {}
    for row in counts:
        cells = max(1, min(MAX_CELLS, row.n // (cell_rows * max(1, row.labels))))
        most = max(1, min(sample, SAMPLE_VALUES // row.d))
        share = min(1.0, 1.5 * most / row.n)
        place = F.pmod(F.xxhash64("class"), F.lit(1 << 30)) / float(1 << 30)
        picked = classes.where((F.size("embedding") == row.d) & (place <= share)).select("class", "embedding")
        rows = picked.limit(2 * most).toArrow().sort_by("class").slice(0, most)
        found[row.d] = spherical_kmeans(unit(matrix(rows.column("embedding"))), cells) if len(rows) else np.zeros((0, row.d))
    return found


def assign(classes: DataFrame, centers: dict[int, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """Add the home cell and the cells where the class is a guest. Lengths beyond
    the sixteen most frequent ones have one cell, 0."""
    kind = classes.select("embedding").schema[0].dataType.simpleString()
    out = f"class binary, label string, weight bigint, embedding {kind}, home int, guests array<int>"
    half = 0.5 * float(np.sqrt(max(0.0, 2 - 2 * threshold) + 1e-12))

    def cells(batches):
        for batch in batches:
            homes, guests = np.zeros(batch.num_rows, np.int32), [[]] * batch.num_rows
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                if len(centers.get(int(d), ())) < 2:
                    continue
                at = np.flatnonzero(lengths == d)
                flat = batch.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                score = unit(flat.reshape(-1, d)) @ centers[int(d)].T
                home = score.argmax(axis=1)
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * centers[int(d)][home] @ centers[int(d)].T) + 1e-12)
                near = score.max(axis=1, keepdims=True) - score <= half * apart + 1e-9
                near[np.arange(len(at)), home] = False
                homes[at] = home
                for i, row in zip(at.tolist(), near):
                    guests[i] = np.flatnonzero(row).astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("class", "label", "weight", "embedding")), pa.array(homes), pa.array(guests, pa.list_(pa.int32()))],
                ["class", "label", "weight", "embedding", "home", "guests"],
            )

    return classes.select("class", F.col("label").cast("string"), "weight", "embedding").mapInArrow(cells, out)


def _blocks(assigned: DataFrame, block: int) -> DataFrame:
    """A row for each group that a class takes part in: ``label, d, cell, i, j``. Group
    ``i, j`` has the homes of block i (``rows``) and, if j is another number, what
    meets them there: a later block of homes, or guests. The first block of guests
    is in the groups ``i, i``."""
    sized = assigned.withColumn("d", F.size("embedding"))
    places = sized.select("label", "d", F.col("home").alias("cell"), F.lit(1).alias("home"), F.lit(0).alias("guest")).unionByName(
        sized.select("label", "d", F.explode("guests").alias("cell"), F.lit(0).alias("home"), F.lit(1).alias("guest"))
    )
    held = places.groupBy("label", "d", "cell").agg(
        F.ceil(F.sum("home") / block).cast("int").alias("homes"),
        F.greatest(F.lit(1), F.ceil(F.sum("guest") / (GUEST_BLOCKS * block))).cast("int").alias("visits"),
    ).where("homes > 0")

    def number(blocks: str) -> Column:
        return F.pmod(F.xxhash64("class"), F.col(blocks).cast("bigint")).cast("int")

    each = F.sequence(F.lit(0), F.col("homes") - 1)
    later = F.when(F.col("visits") > 1, F.sequence(F.col("homes") + 1, F.col("homes") + F.col("visits") - 1)).otherwise(F.array().cast("array<int>"))
    home = sized.withColumn("cell", F.col("home")).join(held, ["label", "d", "cell"]).withColumn("block", number("homes")).withColumn(
        "other", F.explode(F.concat(each, later))
    ).select(
        "label", "d", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "weight", "embedding",
        "home", "guests", F.lit(True).alias("is_home"), (F.col("block") <= F.col("other")).alias("rows"),
    )
    guest = sized.withColumn("cell", F.explode("guests")).join(held, ["label", "d", "cell"]).withColumn("block", number("visits")).withColumn(
        "i", F.explode(each)
    ).select(
        "label", "d", "cell", "i", F.when(F.col("block") == 0, F.col("i")).otherwise(F.col("homes") + F.col("block")).alias("j"), "class", "weight", "embedding",
        "home", F.lit(None).cast("array<int>").alias("guests"), F.lit(False).alias("is_home"), F.lit(False).alias("rows"),
    )
    return home.unionByName(guest)


def connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest of ``n`` indices that each one can reach by the pairs ``a, b``."""
    roots = np.arange(n)
    while len(a):
        least = np.minimum(roots[a], roots[b])
        np.minimum.at(roots, roots[a], least)
        np.minimum.at(roots, roots[b], least)
        while (roots[roots] != roots).any():
            roots = roots[roots]
        open_ = roots[a] != roots[b]
        a, b = a[open_], b[open_]
    return roots


def links_of(assigned: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``class, linked, n``: weight of other classes linked (``linked`` null), and
    a star of the classes that a group connects (``n`` null)."""

    def compare(table: pa.Table) -> pa.Table:
        x = unit(matrix(table.column("embedding")))
        is_home, own = table.column("is_home").to_numpy(), table.column("rows").to_numpy()
        home, weight = table.column("home").to_numpy(), table.column("weight").to_numpy()
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        rows, cols = np.flatnonzero(own), np.arange(len(x)) if same else np.flatnonzero(~own)
        r, c = np.nonzero(x[rows] @ x[cols].T >= threshold)
        r, c = rows[r], cols[c]
        once = ~own[c] | (r < c)
        r, c = r[once], c[once]
        # A home and a guest meet again in the guest's home if the home is a guest there: each counts its own side.
        lists = table.column("guests").combine_chunks()
        held = np.repeat(np.arange(len(x)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        span = int(home.max(initial=0)) + 1
        cells = lists.flatten().to_numpy(zero_copy_only=False)
        guest_of = (held * span + cells)[cells < span]
        both = is_home[c] | ~np.isin(r * span + home[c], guest_of)
        n = np.bincount(r, weight[c], len(x)) + np.bincount(c[both], weight[r[both]], len(x))
        roots = connect(len(x), r, c)
        ends = np.flatnonzero(n > 0)
        stars = np.flatnonzero(roots != np.arange(len(roots)))
        keys = table.column("class").combine_chunks()
        return pa.table({
            "class": pa.concat_arrays([keys.take(pa.array(ends)), keys.take(pa.array(stars))]),
            "linked": pa.concat_arrays([pa.nulls(len(ends), pa.binary()), keys.take(pa.array(roots[stars]))]),
            "n": pa.concat_arrays([pa.array(n[ends].astype(np.int64)), pa.nulls(len(stars), pa.int64())]),
        })

    return _blocks(assigned, block).groupBy("label", "d", "cell", "i", "j").applyInArrow(compare, "class binary, linked binary, n bigint")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    bounded_batches(vectors.sparkSession)
    members = staged(classes_of(vectors))
    classes = staged(
        members.groupBy("class").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    )
    assigned = staged(assign(classes, fit_cells(classes, cell_rows), threshold))
    found = staged(links_of(assigned, threshold, block))
    counts = found.where("linked IS NULL").groupBy("class").agg(F.sum("n").alias("n"))
    roots = staged(components(found.where("linked IS NOT NULL").select(F.col("class").alias("a"), F.col("linked").alias("b"))))
    grouped = roots.select(F.col("node").alias("class"), "root").join(classes.select("class", "least"), "class")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = classes.select("class", "weight", "least").join(counts, "class", "left").join(
        grouped.select("class", "root").join(least, "root").select("class", "component_id"), "class", "left"
    ).select(
        "class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    linked = members.select("vec_id", "class").join(of_class, "class").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~_usable()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
