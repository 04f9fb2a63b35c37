"""Best-fit packing: minimum bin slack over the histogram of lengths, then numbered slots for every piece."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from geoweft.llm.common import let_go
from geoweft.llm.tokens import BATCH_BYTES, load, signs, simple, slices
from geoweft.shared import table

#: About so many bytes of parts of text with their ids are remembered in a task, in two halves: when the newer is full, the older goes, without the parts that came again since.
REMEMBERED = 96 << 20
#: Marks that make one piece after a word, whatever their number. None of them begins a short form or a special string.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Pieces are numbered in chunks of about this many.
CHUNK = 20_000
#: Writes so many ids as little-endian bytes.
FEW = [struct.Struct(f"<{n}I").pack for n in range(12)]
#: The id that ends every document.
END = 0


class Pattern(NamedTuple):
    """A combination of lengths, the longest first, each with its number, and how many bins are filled so."""

    lengths: tuple[tuple[int, int], ...]
    bins: int


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest available length, and with it the fullest feasible combination of the others: subset sums as bits of one number.

    Lengths are added from the longest down, each as often as it is there, by doubling; the sums before each length lead back from the best sum.
    """
    longest = max(counts)
    room, take = capacity - longest, {longest: 1}
    sums, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length] - (length == longest), room // length), 1
        steps.append((length, sums))
        while left > 0:
            n = min(k, left)
            sums |= sums << length * n & mask
            left, k = left - n, 2 * k
        if sums >> room:
            break
    best = sums.bit_length() - 1
    for length, before in reversed(steps):
        while not before >> best & 1:
            best -= length
            take[length] = take.get(length, 0) + 1
    return take


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fills bin after bin with the fullest combination and removes it; a combination fills as many bins at once as its lengths allow.

    The work depends on the numbers of different lengths and combinations, which the capacity bounds, not on the number of pieces.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    out = []
    while counts:
        take = fullest(counts, capacity)
        bins = min(counts[k] // n for k, n in take.items())
        out.append(Pattern(tuple(sorted(take.items(), reverse=True)), bins))
        for k, n in take.items():
            counts[k] -= n * bins
            if not counts[k]:
                del counts[k]
    return out


class Slots:
    """Where the piece of a length and a number within that length goes: arrays of ranges of numbers, sorted by length and first number."""

    def __init__(self, patterns: list[Pattern]) -> None:
        rows, used, sequence = [], {}, 0
        for p in patterns:
            offset = 0
            for length, n in p.lengths:
                rows.append((length, used.get(length, 0), n, sequence, offset))
                used[length] = used.get(length, 0) + n * p.bins
                offset += n * length
            sequence += p.bins
        a = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key, self.first, self.each, self.sequence, self.offset = a[:, 0] << 48 | a[:, 1], a[:, 1], a[:, 2], a[:, 3], a[:, 4]

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 48 | number, "right") - 1
        within = number - self.first[at]
        return self.sequence[at] + within // self.each[at], self.offset[at] + within % self.each[at] * length


def plain(text: str) -> str:
    """A text with the same tokens and more equal parts: in lower case, with spaces for line feeds.

    The tokenizer itself lowers case and drops white space. Special strings are found before it does, so a text that may hold one stays as it is, and so does
    one with characters beyond Latin-1, where composing and lower case depend on more than one character.
    """
    if "<|" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower().replace("\n", " ")


class Encoder:
    """Token ids of whole texts as little-endian bytes, exactly as one call of the tokenizer gives them.

    The word tokenizer drops white space, so no token crosses a space: a text is the sum of its parts between spaces, and equal parts are encoded once. A word of plain letters is one
    piece, which the model takes without the rest of the library, and the marks after it are another. All else, letters beyond Latin-1 too, goes through the library as it is.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.room = load(path), None
        self.pieces = self.tokenizer.model.tokenize
        self.forget()

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return FEW[len(ids)](*ids) if len(ids) < len(FEW) else struct.pack(f"<{len(ids)}I", *ids)

    def forget(self) -> None:
        self.known, self.before, self.tails, self.held = Known(self._ids), {}, {}, 0

    def _turn(self) -> None:
        """When what is known fills half of the memory, what was known before it and hasn't come again goes."""
        if self.held > (self.room or REMEMBERED) // 2:
            self.known, self.before, self.tails, self.held = Known(self._ids), self.known, {}, 0

    def _ids(self, x: str) -> bytes:
        """Of a part that isn't known."""
        self.held += 5 * len(x) + 150
        found = self.before.get(x)
        if found is None:
            if simple(x):
                return self._bytes([t.id for t in self.pieces(signs(x.lower()))])
            # a word before marks is often known without them, and the marks are a piece of their own
            word = x.rstrip(MARKS)
            if len(word) == len(x) or not simple(word):
                return self._bytes(self.tokenizer.encode(x, add_special_tokens=False).ids)
            marks = x[len(word) :]
            if (tail := self.tails.get(marks)) is None:
                self.held += 5 * len(marks) + 150
                tail = self.tails[marks] = self._bytes(self.tokenizer.encode(marks, add_special_tokens=False).ids)
            found = self.known.get(word)
            if found is None:
                found = self.before.get(word)
            if found is None:
                found = self._bytes([t.id for t in self.pieces(signs(word.lower()))])
            found += tail
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            parts, out = plain(text).split(" "), []
            for k in range(0, len(parts), BATCH_BYTES):  # a long text can't outgrow the memory either
                self._turn()
                out.append(b"".join(map(self.known.__getitem__, parts[k : k + BATCH_BYTES])))
            yield out[0] if len(out) == 1 else b"".join(out)


class Known(dict):
    """Parts of texts with their ids; those that aren't there are asked for when they come."""

    def __init__(self, ask) -> None:
        self.ask = ask

    def __missing__(self, x: str) -> bytes:
        found = self[x] = self.ask(x)
        return found


@functools.cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path)


PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def pieces(path: str, capacity: int, remembered: int | None = None):
    """A Column function of a text: its pieces of at most capacity ids, the end's id counted. Null counts as the empty text. remembered: for REMEMBERED, where memory is short."""

    @arrow_udf(PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        end, e = np.array([END], "<u4").tobytes(), encoder(path)
        e.room = remembered
        for texts in batches:
            ends, piece, start, length, crc = [0], [], [], [], []
            for rows in slices(texts):
                for ids in e.encode(rows):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                    ends.append(len(piece))
            fields = pa.StructArray.from_arrays([pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["piece", "start", "length", "ids_crc32"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields).cast(to_arrow_type(PIECES))
        e.forget()
        let_go()

    return cut


def placed(spark, slots: Slots):
    """A Column function of length and number: struct of sequence_id and offset. The slots are broadcast; the capacity bounds their number."""
    shared = spark.sparkContext.broadcast(slots)

    @arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for length, number in batches:
            yield pa.StructArray.from_arrays(list(map(pa.array, shared.value.place(length.to_numpy(), number.to_numpy()))), ["sequence_id", "offset"])

    return place


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, remembered: int | None = None) -> DataFrame:
    """One row per piece: the document's id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    A document's ids are its text's tokens and then id 0; a null or empty text has that id alone. Only documents of more than capacity ids are cut.
    The driver sees the number of pieces of each length, capacity rows at most, and plans the bins from it; every piece then gets a number
    among those of its length (in chunks, so that a hot length spreads over tasks) and takes the slot of that number. Sequences are full from
    offset 0 without gaps. Rows that repeat an id are documents of their own. Other columns are neither read nor returned; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    cut = pieces(tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity, remembered)
    rows = table(documents.select(F.col(id_col).alias("id"), F.explode(cut(F.col(text_col))).alias("p")).select("id", "p.*"))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = placed(spark, Slots(minimum_bin_slack(counts, capacity)))
    chunks = -(-sum(counts.values()) // CHUNK) or 1
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(chunks)))
    sizes = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("id", "piece", "ids_crc32")) - 1
    numbered = dealt.withColumn("number", number.cast("long")).join(starts, ["length", "chunk"])
    return numbered.withColumn("at", place(F.col("length"), F.col("number") + F.col("before"))).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
