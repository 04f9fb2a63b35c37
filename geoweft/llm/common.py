"""What several operators of this subpackage share: tables that cut lineage, union-find, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.shared import drop, table

#: What splits words in most contracts: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A worker that unites nodes hands on what it found, and starts anew, when it holds more nodes than this.
HELD = 500_000


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def let_go() -> None:
    """Hands the memory that a task has done with back to the machine, since its worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lower_ascii(text: str | Column) -> Column:
    """A-Z to a-z and nothing else; lower() also changes letters beyond ASCII."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Forest:
    """Union-find over hashable items; the smallest item of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up, root = self.up, x
        while (parent := up.get(root, root)) != root:
            root = parent
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a, b) -> bool:
        """False if both were in one tree already."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True

    def stars(self) -> Iterator[tuple]:
        """(item, root) for each item that isn't a root."""
        for x in list(self.up):
            if (root := self.find(x)) != x:
                yield x, root

    def edges(self) -> Iterator[pa.RecordBatch]:
        """The same in batches u, v."""
        pairs = list(self.stars())
        for k in range(0, len(pairs), 100_000):
            yield edge_batch(pairs[k : k + 100_000])


def _local_stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.up) > HELD:
            yield from forest.edges()
            forest = Forest()
    yield from forest.edges()
    let_go()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (two long columns): root is the smallest node it is linked with.

    Each partition first shrinks its edges to stars with a union-find of its own. Then large-star and small-star
    rounds alternate until nothing changes; a round's minima are pre-aggregated before their shuffle, and its joins
    are plain equi-joins, whose skewed partitions Spark splits. Nothing is collected but a count and a checksum of
    each round, and of the rounds' tables only the last one stays. Edges with a null or with equal ends are ignored; no edges give no rows.
    """
    a, b = edges.columns[:2]
    clean = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = table(clean.mapInArrow(_local_stars, "u long, v long").distinct())
    before = None
    while True:
        n, check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, check) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        before = (n, check)
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select("v", F.least("u", "m").alias("m")).distinct().toDF("u", "v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select("v", "m").union(least.select("u", "m")).distinct().toDF("u", "v")
        now, old = table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), now
        drop(old)


def spans(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of sorted batches, many whole keys at a time, and where each key's rows begin and the last ones end."""
    held: list[pa.RecordBatch] = []

    def split(part: pa.Table, last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held
        changed = np.zeros(max(0, part.num_rows - 1), bool)
        for key in keys:
            a = part.column(key).combine_chunks()
            changed |= pc.fill_null(pc.not_equal(a[1:], a[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(a[1:]).to_numpy(zero_copy_only=False) != pc.is_null(a[:-1]).to_numpy(zero_copy_only=False))
        cuts = np.r_[0, np.flatnonzero(changed) + 1, part.num_rows]
        end = len(cuts) - 1 if last else len(cuts) - 2
        if end:
            yield part.slice(0, int(cuts[end])), cuts[: end + 1]
        held = [] if last else part.slice(int(cuts[-2])).to_batches()

    rows = 0
    for batch in batches:
        held.append(batch)
        rows = sum(b.num_rows for b in held)
        # a long run is looked through again only when it has doubled
        if batch.num_rows and rows >= 2 * (rows - batch.num_rows) or len(held) > 64:
            yield from split(pa.Table.from_batches(held), False)
    if held and sum(b.num_rows for b in held):
        yield from split(pa.Table.from_batches(held), True)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """The rows of each key, which stand together in sorted batches, as one table; keys with fewer than least rows are left out."""
    for part, cuts in spans(batches, keys):
        sizes = np.diff(cuts)
        for k in np.flatnonzero(sizes >= least):
            yield part.slice(int(cuts[k]), int(sizes[k]))


def edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """Rows u, v of two longs."""
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], ["u", "v"])
