"""Token counts: batches of texts are encoded inside Arrow functions, and only lengths come back."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from geoweft.llm.common import let_go

#: A batch for the tokenizer ends at about so many bytes of UTF-8; a longer text is split at safe boundaries.
BATCH_BYTES = 1 << 18
#: About so many bytes of parts of text, with what they encode to, are remembered in a task; then it forgets them all. More saves little: rare parts come once.
REMEMBERED = 8 << 20
#: Rows of an Arrow batch that become Python strings at a time.
ROWS = 128
#: A space before anything but white space (and what older tables of Unicode take for it) begins a piece. In most texts every space is such a one.
SAFE, OTHER = re.compile(r" (?=[^\s\u180e\u200b\ufeff])"), re.compile(r" (?:[\s\u180e\u200b\ufeff]|\Z)")


#: The byte-level tokenizers' signs for bytes that can't be printed; all other bytes stand for themselves.
SIGNS = {byte: chr(256 + k) for k, byte in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
SPACE = SIGNS[32]
STOPS = (",", ".")


def size(text: str) -> int:
    """Bytes of UTF-8."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def signs(text: str) -> str:
    """A text's bytes as the tokenizers' models know them."""
    return text if text.isascii() else text.encode().decode("latin-1").translate(SIGNS)


def simple(word: str) -> bool:
    """Whether a word is letters of Latin-1 alone: one piece for the tokenizers' patterns, whatever stands around it, and nothing that composing would change."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0100")


def load(path: str):
    """The tokenizers library's tokenizer of a .json file, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, null as empty, ROWS at a time: a worker never holds all of a batch twice."""
    for k in range(0, len(texts), ROWS):
        yield ["" if x is None else x for x in texts.slice(k, ROWS).to_pylist()]


def _chunks(parts: list[str]) -> Iterator[list[str]]:
    """Lists of parts with about BATCH_BYTES bytes each: balanced by size, not by number."""
    out, n = [], 0
    for x in parts:
        out.append(x)
        n += size(x)
        if n >= BATCH_BYTES:
            yield out
            out, n = [], 0
    if out:
        yield out


class PieceCounter:
    """Counts of tokens of whole texts, exactly as one call of the tokenizer gives them.

    The byte-level tokenizer's pattern lets a space before anything but white space begin a piece, whatever stands before it: white space leaves its last
    character to what follows. So a text is the sum of its parts, cut before such spaces; equal parts are encoded once, and a long text is
    encoded part by part. A word of plain letters is one piece, which the model takes without the rest of the library, and a stop after it is another, of one
    token. Special strings hold no space, so they are never cut.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.first, self.rest, self.held = load(path), {}, {}, 0
        self.pieces = self.tokenizer.model.tokenize

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for part in _chunks(texts) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def forget(self) -> None:
        self.first, self.rest, self.held = {}, {}, 0

    def _learn(self, known: dict, parts: set[str], prefix: str) -> None:
        new, others = parts.difference(known), []
        space, pieces = SPACE if prefix else "", self.pieces
        for x in new:
            word = x[:-1] if x[-1:] in STOPS else x
            if simple(word):
                known[x] = len(pieces(space + signs(word))) + (word is not x)
            else:
                others.append(x)
        known.update(zip(others, self.encode([prefix + x for x in others]), strict=True))
        self.held += sum(map(len, new)) + 150 * len(new)

    def _add(self, todo: list[tuple[int, list[str]]], out: list[int]) -> None:
        """Sums the parts of each text of todo, and empties todo."""
        if self.held > REMEMBERED:
            self.forget()
        self._learn(self.first, {p[0] for _, p in todo}, "")
        self._learn(self.rest, set().union(*(p[1:] for _, p in todo)), " ")
        for k, p in todo:
            out[k] = self.first[p[0]] + sum(map(self.rest.__getitem__, p[1:]))
        todo.clear()

    def counts(self, texts: list[str]) -> list[int]:
        out, todo, n = [0] * len(texts), [], 0
        for k, x in enumerate(texts):
            todo.append((k, SAFE.split(x) if OTHER.search(x) else x.split(" ")))
            n += size(x)
            if n >= 2 * BATCH_BYTES:
                self._add(todo, out)
                n = 0
        if todo:
            self._add(todo, out)
        return out


@functools.cache
def counter(path: str) -> PieceCounter:
    """One for all tasks of a worker process."""
    return PieceCounter(path)


def lengths(path: str) -> Callable[..., Column]:
    """A Column function of a text: its number of tokens. Null counts as the empty text, which has none."""

    @arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(path)
        for texts in batches:
            yield pa.array([n for part in slices(texts) for n in c.counts(part)], pa.int64())
        c.forget()
        let_go()

    return count


def token_counts(documents: DataFrame, tokenizer: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Special strings in a text count as the special token, the library's default; nothing is added, cut or padded.
    A null or empty text has 0 bytes and 0 tokens. Repeated rows and ids stay as they are; other columns are neither
    read nor returned, so their names can't clash; an empty table gives an empty one. tokenizer is a file's path that every executor has.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), lengths(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
