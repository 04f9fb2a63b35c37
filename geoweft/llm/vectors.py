"""Embedding near-dedup: passes of sorted random projections, as many as a label's size asks for, joined by union-find, then exact links within components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.llm.common import HELD, Forest, connected_components, runs
from geoweft.shared import table

#: Neighbours compared in a pass, bits of its key, and the part of links at the threshold that all passes together may miss.
WINDOW, BITS, MISS = 1024, 32, 0.002
#: A pass's order is cut into blocks of so many windows, each of which sees one window of the next block too.
WINDOWS = 4
#: So many vectors are compared at once.
SLICE = 512
#: So many vectors of a component are compared with so many others in one piece of work.
BLOCK = 1024


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, in double precision and of length 1."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def effort(n: int, threshold: float, window: int, miss: float) -> int:
    """Passes for a label of n vectors.

    Two vectors of the threshold's cosine have a sign in common with probability q. If they share the first log2(n / window), about window vectors do, so
    they stand within a window of each other in the pass's order and are compared.
    """
    q = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    met = q ** max(0.0, math.log2(n / window))
    return 1 if met >= 1 else math.ceil(math.log(miss) / math.log1p(-met))


def unite(forest: Forest, nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites nodes[a] with nodes[b], pair by pair; pairs that are in one tree already, most in a large group, are dropped many at a time."""
    while len(a):
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.array([forest.find(x) for x in nodes[used].tolist()], np.int64)[at]
        apart = root[: len(a)] != root[len(a) :]
        a, b = a[apart], b[apart]
        first = np.unique(a, return_index=True)[1]
        for u, v in zip(nodes[a[first]].tolist(), nodes[b[first]].tolist(), strict=True):
            forest.union(u, v)


def _keys(threshold: float, window: int, miss: float, seed: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 2048):
                    own = part.slice(at, 2048)
                    x = matrix(own.column("vector"))
                    sizes, which = np.unique(own.column("n").to_numpy(), return_inverse=True)
                    passes = np.array([effort(n, threshold, window, miss) for n in sizes.tolist()])[which]
                    for p in range(passes.max()):
                        if (p, dim) not in planes:
                            planes[p, dim] = np.random.default_rng([seed, dim, p]).standard_normal((dim, BITS))
                        in_pass = passes > p
                        key = (x[in_pass] @ planes[p, dim] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                        rows = own.filter(pa.array(in_pass))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p, np.int32)), rows.column("label"), rows.column("dim"), pa.array(key), rows.column("node")], ["pass", "label", "dim", "key", "node"])

    return make


def _neighbours(threshold: float, window: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for block in runs(batches, ["block"], least=2):
            if len(forest.up) > HELD:
                yield from forest.edges()
                forest = Forest()
            nodes, dims, tail = block.column("node").to_numpy(), block.column("dim").to_numpy(), block.column("tail").to_numpy(zero_copy_only=False)
            codes = [block.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("pass", "label", "dim")]
            group = np.r_[0, np.cumsum(np.logical_or.reduce([c[1:] != c[:-1] for c in codes]))]
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = matrix(block.column("vector").take(pa.array(own)))
                for k in range(0, int((~tail[own]).sum()), SLICE):
                    end = min(len(own), k + SLICE + window)
                    near = x[k : k + SLICE] @ x[k:end].T >= threshold
                    near &= group[own[k : k + SLICE], None] == group[own[k:end]]
                    a, b = np.nonzero(near)
                    a, b = own[k + a], own[k + b]
                    inside = (b > a) & (b - a <= window)
                    unite(forest, nodes, a[inside], b[inside])
        yield from forest.edges()

    return make


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their number from 0 in order. They are dealt to tasks by range and written; each range is numbered by itself and starts where those before it end."""
    ranges = table(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range
    starts = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("start"))
    at = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranges.withColumn("at", at).join(starts, "range").withColumn("number", F.col("start") + F.col("at")).drop("range", "at", "start")


def _counts(threshold: float):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, links = [], []
        for cell in runs(batches, ["root", "i", "j"], least=2):
            x, copies, node, salt = matrix(cell.column("vector")), cell.column("copies").to_numpy(), cell.column("node").to_numpy(), cell.column("salt").to_numpy()
            i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
            a, b = np.flatnonzero(salt == i), np.flatnonzero(salt == j)
            for k in range(0, len(a), BLOCK):
                own = a[k : k + BLOCK]
                near = x[own] @ x[b].T >= threshold
                if i == j:
                    near[np.arange(len(own)), np.searchsorted(b, own)] = False
                nodes.append(node[own])
                links.append(near @ copies[b])
                if i != j:
                    nodes.append(node[b])
                    links.append(copies[own] @ near)
            if len(nodes) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links))], ["node", "links"])
                nodes, links = [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links))], ["node", "links"])

    return make


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", threshold: float = 0.93, window: int = WINDOW, miss: float = MISS, seed: int = 42) -> DataFrame:
    """One row per row of vectors: its id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal, and their cosine in double precision is threshold or more. Equal vectors
    of one label are one node with a number of copies from the start. The nodes of a label are put in order by the signs of random hyperplanes, in as many
    passes as effort() finds for their number, and each is compared with the window after it; the one order of all passes is cut into blocks of
    equal size that overlap by a window, so a hot label spreads over tasks and no pair is lost at a border. For vectors spread evenly over the
    hyperplanes, at most about miss of the links at the threshold stay unfound, fewer above it, none in labels of window nodes or less. What is found is
    united. Within each component all pairs are then compared exactly, in blocks, so n_links counts every link there, however many.
    n_links is the number of other rows linked directly; component_id the smallest id that links reach, its own included; kept tells
    whether that is its own. A vector that isn't usable, or whose label is null, links with nothing. Repeated rows count as copies, each on its own.
    Null ids are never the smallest. Other columns are neither read nor returned; an empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    fit = F.col("label").isNotNull() & usable(F.col("vector"))
    good = rows.where(fit).withColumn("node", F.xxhash64("label", "vector"))
    nodes = table(good.groupBy("node", "label", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("first")).withColumn("dim", F.size("vector")))
    counted = nodes.join(nodes.groupBy("label", "dim").agg(F.count("*").alias("n")), ["label", "dim"]).where("n > 1").select("label", "dim", "n", "node", "vector")
    order = ["pass", "label", "dim", "key", "node"]
    placed = numbered(counted.mapInArrow(_keys(threshold, window, miss, seed), "pass int, label string, dim int, key long, node long"), order)
    size = WINDOWS * window
    block = F.floor(F.col("number") / size)
    # a block's first window is the tail of the block before it
    twice = F.array(F.struct(block.alias("block"), F.lit(False).alias("tail")), F.struct((block - 1).alias("block"), F.lit(True).alias("tail")))
    cut = placed.withColumn("b", F.explode(F.when(F.col("number") % size < window, twice).otherwise(F.slice(twice, 1, 1)))).select(*order, "number", "b.block", "b.tail")
    met = cut.join(nodes.select("node", "vector"), "node").select("block", "number", "tail", *order, "vector")
    close = met.repartition("block").sortWithinPartitions("block", "number").mapInArrow(_neighbours(threshold, window), "u long, v long")
    roots = table(connected_components(close))
    sized = roots.join(roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("k")), "root")
    members = nodes.join(sized, "node").select("root", "node", "copies", "vector", "k", F.pmod(F.xxhash64("node"), F.col("k")).alias("salt"))
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("root", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "node", "salt", "copies", "vector")
    linked = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(_counts(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies", "first").join(roots, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = known.join(least, "root").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    found = good.select("id", "node").join(facts, "node").select("id", "n_links", "component_id")
    alone = rows.where(~fit).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
