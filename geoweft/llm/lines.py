"""Line dedup: fuzzy lines by MinHash over character shingles, banded, verified exactly, united, one line kept of each component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from geoweft.llm.common import HELD, Forest, connected_components, let_go, runs, spans
from geoweft.shared import drop, table

#: Characters of a shingle, bands and rows of a band: a pair of similarity 0.8 shares a band with probability 0.99, one of 0.9 with 0.9999.
SHINGLE, BANDS, ROWS = 8, 9, 4
BINS = BANDS * ROWS
#: Bits of the filters through which the texts of candidates and the documents that lose lines are found; 8 MB are all that is broadcast, at any size of input.
FILTER_BITS = 1 << 26
#: So many characters are hashed at once: few enough for a processor's cache.
BLOCK = 1 << 15
#: About so many bytes of sets of shingles that a task remembers, in a worker of bounded memory; larger buckets than this aren't pruned pair by pair.
SETS, PAIRED = 10 << 20, 64
#: As many code points fit the bytes of a number.
CODES = 256
EMPTY = np.uint32(0xFFFFFFFF)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]
#: For each bin the order in which an empty one looks for a bin to borrow from.
_BORROW = np.stack([np.random.default_rng([7, k]).permutation(BINS) for k in range(BINS)])


def key(line: str) -> int:
    """64 bits that stand for the line; surrounding white space doesn't count."""
    return xxhash.xxh3_64_intdigest(line.strip().encode("utf-8", "surrogatepass"), 42)


def parts(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines of a text that aren't blank; lines end at line feeds only."""
    return [(k, x) for k, x in enumerate(text.split("\n")) if x.strip()] if text else []


def shingles(line: str) -> frozenset[str]:
    line = line.strip()
    return frozenset(line[k : k + SHINGLE] for k in range(max(1, len(line) - SHINGLE + 1)))


def bands(lines: list[str]) -> np.ndarray:
    """A row of BANDS hashes for each line: one hash of each shingle falls into a bin, the least of each bin is the signature, and ROWS of them make a band."""
    lines = [x.strip().ljust(SHINGLE, "\0") for x in lines]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = c[:-1] * _M[0]
    h += c[1:]
    for k in (1, 2):
        rest = h[2 * k :]
        h = h[: -2 * k] * _M[k]
        h += rest
    starts = np.ones(len(c), bool)
    starts[np.cumsum(lengths)[:, None] - np.arange(1, SHINGLE)] = False
    h = h[starts[: len(h)]]
    h ^= h >> np.uint64(33)
    h *= _M[3]
    h ^= h >> np.uint64(33)
    at = h >> np.uint64(32)
    at *= np.uint64(BINS)
    at >>= np.uint64(32)
    at = at.view(np.int64)
    at += np.repeat(np.arange(0, len(lines) * BINS, BINS), lengths - SHINGLE + 1)
    signature = np.full(len(lines) * BINS, EMPTY, np.uint32)
    np.minimum.at(signature, at, h.astype(np.uint32))
    signature = signature.reshape(-1, BINS)
    empty = signature == EMPTY
    filled = signature.copy()
    for k in range(BINS):
        row, col = np.nonzero(filled == EMPTY)
        if not len(row):
            break
        source = _BORROW[col, k]
        filled[row, col] = np.where(empty[row, source], EMPTY, signature[row, source] + np.uint32(k + 1))
    out = np.arange(BANDS, dtype=np.uint64)[None, :] * _M[0] + _M[1]
    for r in range(ROWS):
        out = (out ^ filled[:, r::ROWS]) * _M[3]
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _signed(rows: list[int]) -> pa.Array:
    return pa.array(np.array(rows, np.uint64).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        flat = bands([x for _, _, x in held])
        return pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in held], batch.column(0).type), pa.array([n for _, n, _ in held], pa.int32()), _signed([key(x) for _, _, x in held]), pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), BANDS).cast(pa.list_(pa.int64()))], ["id", "line", "h", "bands"])

    held: list[tuple[int, int, str]] = []
    size = 0
    for batch in batches:
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for n, x in parts(text.as_py()):
                held.append((d, n, x))
                size += len(x)
                if size >= BLOCK or len(held) >= 4096:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()
    let_go()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by band: those whose band has another row."""
    tail: pa.RecordBatch | None = None
    told = False
    for batch in batches:
        if not batch.num_rows:
            continue
        both = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        band = both.column(0).to_numpy()
        same = band[1:] == band[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        if told:
            keep[0] = False
        told = bool(keep[-1])
        tail = both.slice(both.num_rows - 1)
        yield both.filter(pa.array(keep))


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows band, h, bands, sorted by band: those with another row in their bucket that they share no smaller band with.

    A pair of lines is compared in the bucket of the smallest band that both have, once however many they share. bands are a line's bands, sorted.
    """
    for part, cuts in spans(batches, ["band"]):
        every, bands, keep = part.column("band").to_numpy()[cuts[:-1]].tolist(), part.column("bands").to_pylist(), np.zeros(part.num_rows, bool)
        for band, start, end in zip(every, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if end - start == 2:
                keep[start:end] = min({*bands[start]}.intersection(bands[start + 1])) == band
            elif end - start > 2:
                smaller = [frozenset(b for b in x if b < band) for x in bands[start:end]]
                if not frozenset.intersection(*smaller):
                    keep[start:end] = len(smaller) > PAIRED or [any(a.isdisjoint(b) for j, b in enumerate(smaller) if j != k) for k, a in enumerate(smaller)]
        yield from part.filter(pa.array(keep)).combine_chunks().to_batches()


def _bits(hashes: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits in words of 64: that of every hash in the column h of hashes is set."""
    # as unsigned numbers modulo a power of two
    words = hashes.selectExpr(f"shiftright(h & {FILTER_BITS - 1}L, 6) AS word", "shiftleft(1L, cast(h & 63L AS int)) AS bit")
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits


def _found(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % np.uint64(FILTER_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _texts(bits: np.ndarray, spark):
    shared = spark.sparkContext.broadcast(bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = {}
            for text in batch.column(0):
                lines = parts(text.as_py())
                if lines:
                    h = np.array([key(x) for _, x in lines], np.uint64)
                    for k in np.flatnonzero(_found(known, h)).tolist():
                        found[int(h[k])] = lines[k][1]
            yield pa.RecordBatch.from_arrays([_signed(list(found)), pa.array(list(found.values()), pa.string())], ["h", "line"])
            del found
        let_go()

    return make


class Shingled:
    """The sets of shingles of one bucket's lines, exactly: sorted arrays of numbers whose bytes are a shingle's characters, or sets of strings where the bucket has more than CODES code points."""

    def __init__(self, lines: list[str]) -> None:
        self.lines, self.known, self.held = [x.strip() for x in lines], {}, 0
        self.signs: dict[int, int] | None = None
        self.packed = all(map(str.isascii, lines)) or max(map(max, filter(None, self.lines)), default="") < chr(CODES)
        if not self.packed and len(codes := set().union(*self.lines)) <= CODES:
            self.packed, self.signs = True, {ord(x): k for k, x in enumerate(sorted(codes))}

    def __getitem__(self, k: int) -> np.ndarray | frozenset[str]:
        if k not in self.known:
            if self.held >= SETS:
                self.known, self.held = {}, 0
            self.known[k] = self._of(self.lines[k])
            self.held += len(self.known[k]) * (8 if self.packed else 100)
        return self.known[k]

    def _of(self, line: str) -> np.ndarray | frozenset[str]:
        if not self.packed:
            return shingles(line)
        if len(line) < SHINGLE:  # one shingle, that no other line of the bucket has
            return np.empty(0, np.uint64)
        raw = (line.translate(self.signs) if self.signs else line).encode("latin-1")
        a = np.ndarray(len(raw) - SHINGLE + 1, np.uint64, raw, strides=(1,)).copy()
        a.sort()
        keep = np.empty(len(a), bool)
        keep[0] = True
        np.not_equal(a[1:], a[:-1], out=keep[1:])
        return a if keep.all() else a[keep]

    def similar(self, k: int, j: int, least: float) -> bool:
        """Whether the Jaccard similarity of two different lines is least or more."""
        a, b = self[k], self[j]
        if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
            return False
        if self.packed:
            both = np.concatenate((a, b))
            both.sort()
            both = int(np.count_nonzero(both[1:] == both[:-1]))
        else:
            both = len(a & b)
        return both >= least * (len(a) + len(b) - both)


def _verified(similarity: float):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for bucket in runs(batches, ["band"], least=2):
            if len(forest.up) > HELD:
                yield from forest.edges()
                forest = Forest()
            band = bucket.column("band")[0].as_py()
            rows = bucket.column("h").to_pylist()
            sets = Shingled(bucket.column("line").to_pylist())
            smaller = [frozenset(b for b in x if b < band) for x in bucket.column("bands").to_pylist()]

            def linked(k: int, j: int) -> bool:
                return smaller[k].isdisjoint(smaller[j]) and sets.similar(k, j, similarity) and (forest.union(rows[k], rows[j]) or True)

            classes: list[list[int]] = []
            for k, h in enumerate(rows):
                joined, others = [k], []
                for c in classes:
                    # one similar member is enough, and those already united with this line need no test
                    if forest.find(rows[c[0]]) == forest.find(h) or any(linked(k, j) for j in c):
                        joined = c + joined
                    else:
                        others.append(c)
                classes = [joined, *others]
        yield from forest.edges()
        let_go()

    return make


def line_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row per line that isn't blank: the document's id, line (its number from 0), class_id and class_line (id and line of the first line of its component), kept.

    Lines, without surrounding white space, link when the Jaccard similarity of their sets of SHINGLE-character shingles is similarity or
    more; a shorter line is one shingle. Equal lines are one node from the start. Lines that share a band are compared exactly until they are united;
    links make components, and of each the line that stands first by id and number is kept. Lines are known by 64-bit hashes.
    Null and empty texts have no lines. Ids are of any type that has an order; null ids come first. Rows that repeat an id are one document: equal places share their fate.
    Other columns are neither read nor returned; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = table(docs.mapInArrow(_signatures, f"id {docs.schema['id'].dataType.simpleString()}, line int, h long, bands array<long>"))
    nodes = table(lines.groupBy("h").agg(F.min(F.struct("id", "line")).alias("first"), F.any_value("bands").alias("bands")))
    banded = nodes.select(F.explode("bands").alias("band"), "h").repartition("band").sortWithinPartitions("band")
    candidates = table(banded.mapInArrow(_shared, "band long, h long"))
    listed = candidates.groupBy("h").agg(F.array_sort(F.collect_list("band")).alias("bands")).select(F.explode("bands").alias("band"), "h", "bands")
    needed = table(listed.repartition("band").sortWithinPartitions("band", "h").mapInArrow(_uncovered, "band long, h long, bands array<long>"))
    drop(candidates)
    texts = docs.select("text").mapInArrow(_texts(_bits(needed), spark), "h long, line string").groupBy("h").agg(F.any_value("line").alias("line"))
    texts = texts.withColumnRenamed("h", "known")
    buckets = needed.join(texts, F.col("h") == F.col("known")).select("band", "h", "bands", "line").repartition("band").sortWithinPartitions("band", "h")
    roots = connected_components(buckets.mapInArrow(_verified(similarity), "u long, v long"))
    drop(needed)
    named = nodes.select("h", "first").join(roots, F.col("h") == F.col("node"), "left").select("h", "first", F.coalesce("root", "h").alias("root"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    classes = named.join(best, "root").select(F.col("h").alias("member"), "best")
    place = F.struct("id", "line")
    return lines.select("id", "line", "h").join(classes, F.col("h") == F.col("member")).select(F.col("id").alias(id_col), "line", F.col("best.id").alias("class_id"), F.col("best.line").alias("class_line"), place.eqNullSafe(F.col("best")).alias("kept"))


@arrow_udf(T.StringType())
def _without(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts without the lines of these numbers; all lines stay where there are none."""
    for texts, gone in rows:
        parts = []
        for at in range(0, len(texts), 256):  # a worker never holds all of a batch twice
            out = []
            for text, numbers in zip(texts.slice(at, 256).to_pylist(), gone.slice(at, 256).to_pylist(), strict=True):
                if numbers:
                    numbers = {*numbers}
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in numbers)
                out.append(text)
            parts.append(pa.array(out, pa.string()))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    let_go()


def _may_hold(bits: np.ndarray, spark):
    shared = spark.sparkContext.broadcast(bits)

    @arrow_udf(T.BooleanType())
    def may(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for h in hashes:
            yield pa.array(_found(shared.value, h.to_numpy().view(np.uint64)))

    return may


def without_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """All rows and columns of documents, with the lines gone that line_classes doesn't keep; a text may become empty, but no row goes.

    Only documents that lose lines meet their line numbers in a shuffle (and those that a filter of FILTER_BITS takes for such); the others pass as they are.
    """
    lost = line_classes(documents, id_col, text_col, similarity).where(~F.col("kept")).groupBy(F.col(id_col).alias("_id")).agg(F.collect_set("line").alias("_lines"))
    lost = table(lost)
    may = _may_hold(_bits(lost.select(F.xxhash64("_id").alias("h"))), documents.sparkSession)
    kept = documents.where(~may(F.xxhash64(id_col)))
    # one plan at every size: never a broadcast of what grows with the documents
    joined = documents.where(may(F.xxhash64(id_col))).join(lost.hint("merge"), documents[id_col].eqNullSafe(lost["_id"]), "left")
    return kept.union(joined.select(*(_without(documents[text_col], lost["_lines"]).alias(c) if c == text_col else documents[c] for c in documents.columns)))
