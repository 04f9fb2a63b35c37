"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from geoweft.llm.common import let_go

#: N-grams of these lengths share this many buckets.
ORDERS, BUCKETS = (2, 3), 1 << 15
#: So many characters, divided by the number of languages, are scored at once.
CELLS = 1 << 20
#: The model is broadcast in matrices of a column for each language, at most so many; 8 MB each.
TOGETHER = 64
UNKNOWN = "und"
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def blocks(texts: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the texts, buckets) of the n-grams of the whole texts, in blocks of one length and about most characters.

    A text is taken in lower case between two spaces. A long one is spread over blocks that overlap, so each n-gram comes once.
    """
    parts: list[tuple[int, str, int]] = []
    n = 0
    for k, text in enumerate(texts):
        padded = f" {text.lower()} "
        for at in range(0, len(padded), most):
            part = padded[at : at + most + max(ORDERS) - 1]
            parts.append((k, part, min(most, len(padded) - at)))
            n += len(part)
            if n >= most:
                yield from _hashed(parts)
                parts, n = [], 0
    if parts:
        yield from _hashed(parts)


def _hashed(parts: list[tuple[int, str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    codes = np.frombuffer("".join(p for _, p, _ in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) for _, p, _ in parts])
    own = np.repeat(np.arange(len(parts)), lengths)
    within = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    starts = within < np.repeat([m for _, _, m in parts], lengths)
    left = np.repeat(lengths, lengths) - within
    docs = np.array([k for k, _, _ in parts])
    for order in ORDERS:
        at = np.flatnonzero(starts & (left >= order))
        h = np.full(len(at), order, np.uint32)
        for j in range(order):
            h = (h ^ codes[at + j]) * _MIX[j]
            h ^= h >> np.uint32(15)
        yield docs[own[at]], ((h * _MIX[0]) >> np.uint32(17)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    #: log probabilities by bucket and language, and log priors
    table: np.ndarray
    prior: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log joint probabilities by text and language."""
        total = np.zeros((len(texts), len(self.languages)))
        for doc, bucket in blocks(texts, max(4096, CELLS // max(1, len(self.languages)))):
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            total[doc[first]] += np.add.reduceat(self.table[bucket], first, axis=0, dtype=np.float64)
        return total + self.prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, and its share of the probabilities of all languages."""
        names, best, rest = self.likeliest(texts)
        return [x or UNKNOWN for x in names], [math.exp(-r) if x else 0.0 for x, r in zip(names, rest, strict=True)]

    def likeliest(self, texts: list[str | None]) -> tuple[list[str | None], list[float], list[float]]:
        """The likeliest of these languages (null for a text without any letter), its log joint probability, and how much larger the logarithm of all their sum is."""
        known = [k for k, x in enumerate(texts) if x is not None and has_letter(x)] if self.languages else []
        names, best, rest = [None] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        for k, s in zip(known, self.scores([texts[k] for k in known]), strict=True):
            at = int(s.argmax())
            names[k], best[k], rest[k] = self.languages[at], float(s[at]), float(np.log(np.exp(s - s[at]).sum()))
        return names, best, rest

    def parts(self) -> list[Model]:
        """The same model as one of at most TOGETHER languages after another."""
        n = len(self.languages)
        return [Model(self.languages[k : k + TOGETHER], np.ascontiguousarray(self.table[:, k : k + TOGETHER]), self.prior[k : k + TOGETHER]) for k in range(0, max(1, n), TOGETHER)]


def held_out(id_col: str) -> Column:
    """Whether the CRC-32 of the id as text is a multiple of 5; a null id counts as the empty text, whose CRC-32 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [x for x, y in zip(texts, langs, strict=True) if y == lang and has_letter(x)]
            at = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for _, bucket in blocks(own, CELLS // 4):
                at += np.bincount(bucket, minlength=BUCKETS)
    for lang, at in totals.items():
        used = np.flatnonzero(at)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(at[used])], ["lang", "bucket", "n"])


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 4000, smoothing: float = 0.5) -> Model:
    """A model of the documents that aren't held out and have a text and a language.

    rows_per_language bounds the sample of n-grams: a language with more rows gives about that many, chosen by a hash of the id; their whole texts count.
    Priors are the shares of all rows that have a letter.
    What reaches the driver at once has a row for each of TOGETHER languages and bucket at most, whatever the size of documents; what stays there is
    a column of numbers for each language. Without any such document the model knows no language and predicts "und".
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out("id"))
    # \p{L} is what has_letter() finds
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"\p{L}")).alias("docs")).collect()
    found.sort(key=lambda r: r["lang"])
    languages = [r["lang"] for r in found]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    table = np.zeros((BUCKETS, len(languages)), np.float32)
    for k in range(0, len(languages), TOGETHER):
        share = F.lit(0.0)
        for r in found[k : k + TOGETHER]:
            share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, rows_per_language / r["n"]))).otherwise(share)
        sample = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 20)) < share * (1 << 20)))
        number = F.array_position(F.array(*map(F.lit, languages[k : k + TOGETHER])), F.col("lang")) - 1
        counted = sample.select("text", "lang").mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).select(number.cast("int").alias("at"), F.col("bucket").cast("int").alias("bucket"), "n").toArrow()
        counts = np.zeros((BUCKETS, len(found[k : k + TOGETHER])))
        counts[counted.column("bucket").to_numpy(), counted.column("at").to_numpy()] = counted.column("n").to_numpy()
        smooth = counts + smoothing
        table[:, k : k + TOGETHER] = np.log(smooth / smooth.sum(axis=0))
    docs = np.array([r["docs"] for r in found], float)
    return Model(languages, table, np.log((docs + 1) / (docs + 1).sum()))


def predictor(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A Column function of a text: struct of lang_pred and score. The model is broadcast in parts of TOGETHER languages, each of which gives its likeliest one."""

    def one(part: Model):
        shared = spark.sparkContext.broadcast(part)

        @arrow_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("best", T.DoubleType()), T.StructField("rest", T.DoubleType())]))
        def likeliest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                out: tuple[list, list, list] = ([], [], [])
                for k in range(0, len(texts), 256):  # a worker never holds all of a batch twice
                    for held, new in zip(out, shared.value.likeliest(texts.slice(k, 256).to_pylist()), strict=True):
                        held += new
                yield pa.StructArray.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())], ["name", "best", "rest"])
            let_go()

        return likeliest

    udfs = [one(p) for p in model.parts()]

    def joined(found: Column) -> Column:
        # parts stand in the order of their languages, and only a larger one replaces an earlier
        top = F.aggregate(found, F.get(found, F.lit(0)), lambda a, x: F.when(x["best"] > a["best"], x).otherwise(a))
        others = F.aggregate(found, F.lit(0.0), lambda s, x: s + F.exp(x["best"] - top["best"]) * F.exp(x["rest"]))
        return F.struct(F.coalesce(top["name"], F.lit(UNKNOWN)).alias("lang_pred"), F.when(top["name"].isNull(), 0.0).otherwise(1 / others).alias("score"))

    def predict(text: Column) -> Column:
        return F.get(F.transform(F.array(F.array(*(u(text) for u in udfs))), joined), F.lit(0))

    return predict


def predict_languages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 4000) -> DataFrame:
    """One row per row of documents: its id, held_out, lang_pred, score (the posterior probability, 0 for "und").

    Only the text enters a prediction. A null text, or one without a letter, gives "und". Repeated rows and ids stay; other columns are
    neither read nor returned; an empty table gives an empty one. Ties go to the first language in code point order.
    """
    predict = predictor(documents.sparkSession, fit(documents, id_col, text_col, lang_col, rows_per_language))
    return documents.select(F.col(id_col), held_out(id_col).alias("held_out"), predict(F.col(text_col)).alias("_p")).select(id_col, "held_out", "_p.lang_pred", "_p.score")


def known_language(documents: DataFrame, min_score: float = 0.5, **columns: str) -> DataFrame:
    """The rows of documents, all columns, whose text has a language by predict_languages with a score of min_score at least."""
    predict = predictor(documents.sparkSession, fit(documents, **columns))
    p = predict(F.col(columns.get("text_col", "text")))
    return documents.where((p["lang_pred"] != UNKNOWN) & (p["score"] >= min_score))
