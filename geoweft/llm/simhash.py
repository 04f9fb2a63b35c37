"""SimHash near-dedup: fingerprints of word shingles, linked by BK-trees within shards that share blocks of bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from geoweft.llm.common import Forest, connected_components, let_go, runs
from geoweft.shared import table

#: So many shingles are turned into bits at once.
BLOCK = 1 << 15
#: Codes that a shard has at most on average, and of a larger one those that make a part.
SHARD, PART = 1024, 4096


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """64 bits as an unsigned number: a bit is 1 if set in over half of the shingles' hashes; 0 for a text without words."""
    # on bytes, lower() and split() know A-Z and the ASCII white space only, as the contract has it
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[k : k + BLOCK], last[k : k + BLOCK], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(shingle: int = 4, seed: int = 42):
    """A Column function of a text: its fingerprint as a signed long. Null counts as the empty text."""

    @arrow_udf(T.LongType())
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(x.as_py() or "", shingle, seed) for x in texts], np.uint64).view(np.int64))
        let_go()

    return make


class Tree:
    """A BK-tree over different codes, each known by its number: a node holds one code, and for every Hamming distance from it a child with the codes at that distance."""

    __slots__ = ("children", "codes", "members", "pivot")

    def __init__(self, codes: np.ndarray, members: np.ndarray | None = None) -> None:
        todo = [(self, np.arange(len(codes)) if members is None else members)]
        while todo:
            node, members = todo.pop()
            node.codes, node.members, node.pivot, rest = codes, members, members[0], members[1:]
            d = np.bitwise_count(codes[rest] ^ codes[node.pivot])
            node.children = {int(e): Tree.__new__(Tree) for e in np.unique(d)}
            todo += ((child, rest[d == e]) for e, child in node.children.items())


class Groups:
    """The group of each of n numbers, known by its smallest member."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def unite(self, first: int, others: np.ndarray) -> None:
        found = np.unique(np.append(self.of[others], self.of[first]))
        if len(found) > 1:
            self.of[np.isin(self.of, found[1:])] = found[0]

    def hand_over(self, codes: np.ndarray, forest: Forest) -> None:
        at = np.flatnonzero(self.of != np.arange(len(self.of)))
        for a, b in zip(codes[self.of[at]].tolist(), codes[at].tolist(), strict=True):
            forest.union(a, b)


def link(tree: Tree, radius: int, forest: Forest) -> None:
    """Unites all members of the tree that a chain of steps of at most radius bits connects.

    Members within the radius of a pivot are connected through it, so nothing below such an edge is looked at again for their own sake, and of two
    children only those are compared whose edges differ by the radius at most.
    """
    groups, todo = Groups(len(tree.codes)), [tree]
    while todo:
        t = todo.pop()
        for e, child in t.children.items():
            if e <= radius:
                groups.unite(t.pivot, child.members)
            else:
                todo.append(child)
        for (e, a), (f, b) in combinations(sorted(t.children.items(), key=lambda x: x[0]), 2):
            if f - e <= radius < f:
                search(a, b.members, radius, groups)
    groups.hand_over(tree.codes, forest)


def search(tree: Tree, queries: np.ndarray, radius: int, groups: Groups) -> None:
    """Unites queries with the members of the tree within the radius, following only edges within the radius of the query's distance to the pivot."""
    todo = [(tree, queries)]
    while todo:
        t, q = todo.pop()
        d = np.bitwise_count(t.codes[q] ^ t.codes[t.pivot]).astype(np.int8)
        close = d <= radius
        if close.any():
            groups.unite(t.pivot, q[close])
        for e, child in t.children.items():
            near = np.abs(d - e) <= radius
            if e <= radius:
                # such queries and all below this edge are connected through the pivot
                near &= ~close
            if near.any():
                todo.append((child, q[near]))


def _linked(radius: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for shard in runs(batches, ["blocks", "key", "i", "j"], least=2):
            codes, salt = shard.column("fp").to_numpy().view(np.uint64), shard.column("salt").to_numpy()
            i, j = shard.column("i")[0].as_py(), shard.column("j")[0].as_py()
            own, forest = np.flatnonzero(salt == i), Forest()
            if i == j:
                link(Tree(codes), radius, forest)
            elif 0 < len(own) < len(codes):
                groups = Groups(len(codes))
                search(Tree(codes, own), np.flatnonzero(salt == j), radius, groups)
                groups.hand_over(codes, forest)
            pairs += forest.stars()
            if len(pairs) > 100_000:
                yield _edges(pairs)
                pairs = []
        if pairs:
            yield _edges(pairs)

    return make


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(pairs, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["u", "v"])


def block_count(n: int, radius: int, bits: int) -> int:
    """Into how many blocks the bits of n codes are cut, so that a shard, known by all but radius blocks, has about SHARD codes at most."""
    m = radius + 1
    while m < bits // 4 and n > SHARD << bits * (m - radius) // m:
        m += 1
    return m


def links(codes: DataFrame, radius: int = 4, bits: int = 64) -> DataFrame:
    """Edges (u, v) between the different codes in column fp (long) that connect exactly what steps of at most radius bits connect.

    The bits fall into m blocks, at least radius + 1. Codes within the radius differ in radius blocks at most, so they agree in m - radius others: each choice of so
    many blocks, with their bits, is a shard, and every shard is a BK-tree in which its own codes are searched. A shard of more than PART codes is dealt
    into parts; the tree of one part meets the codes of another in a task of its own. The trees are built where a shard's rows meet, not broadcast: they
    hold every code, so no size bound for a broadcast could be given.
    """
    m = block_count(codes.count(), radius, bits)
    cuts = [round(k * bits / m) for k in range(m + 1)]
    block = [F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << cuts[k + 1] - cuts[k]) - 1)) for k in range(m)]

    def key(chosen: tuple[int, ...]) -> Column:
        out = block[chosen[0]]
        for k in chosen[1:]:
            out = F.shiftleft(out, cuts[k + 1] - cuts[k]) + block[k]
        return out

    shards = F.array(*(F.struct(F.lit(k).alias("blocks"), key(c).alias("key")) for k, c in enumerate(combinations(range(m), m - radius))))
    rows = codes.select("fp", F.explode(shards).alias("s")).select("fp", "s.blocks", "s.key")
    hot = rows.groupBy("blocks", "key").agg(F.ceil(F.count("*") / PART).alias("parts")).where("parts > 1")
    parted = rows.join(hot, ["blocks", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("parts")))
    cells = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("blocks", "key", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "fp", "salt")
    return cells.repartition("blocks", "key", "i", "j").sortWithinPartitions("blocks", "key", "i", "j", "fp").mapInArrow(_linked(radius), "u long, v long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of documents: its id, fingerprint (16 hex digits), component_id (the smallest id that links reach, its own included).

    Equal fingerprints are one code from the start, so copies, however many, make no pairs. A null or empty text has fingerprint zero, which
    links like any other. Repeated rows stay, and share a component. A null id is never the smallest; a component of null ids alone has a null one.
    Other columns are neither read nor returned; an empty table gives an empty one.
    """
    rows = table(documents.select(F.col(id_col).alias("id"), fingerprints(shingle, seed)(F.col(text_col)).alias("fp")))
    codes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    codes = table(codes)
    roots = connected_components(links(codes, radius))
    named = codes.join(roots, codes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select(F.col("fp").alias("code"), "component_id")
    out = rows.join(classes, rows.fp == classes.code)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of documents, all columns, that aren't near copies of a row with a smaller id; rows that repeat an id share its fate, rows with a null id stay."""
    gone = near_duplicates(documents, id_col, **options).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone"))
    gone = table(gone.distinct())
    return documents.join(gone, documents[id_col] == gone["_gone"], "left_anti")
