"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.llm.common import WORD
from geoweft.shared import stored_bytes, table

#: A source is dealt into chunks of about so many documents, each of which is sampled by itself.
CHUNK = 1024


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null: one mark is put for each word with what surrounds it."""
    return F.when(text.rlike(WORD), F.length(F.regexp_replace(text, rf"[\x20\x09-\x0D]*{WORD}[\x20\x09-\x0D]*", "w"))).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """source, source_size, n, target, from sizes (source, size): one row per source, null included.

    Sources by code point, null last, weigh as in weights, repeating. They share the sum of all sizes; a source never gets more than most
    times its size, and what it leaves goes to the others by weight, until none is above. In order of size over weight the sources at
    their maximum come first, so running sums find them all at once: with k of them, the others get their weight times what is left over
    the weights left, and k is the first number for which the next source isn't above. The windows here see a row for each source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weights_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = sources.withColumn("weight", weight).withColumn("level", left / weights_left)
    free = F.min(F.when(most * F.col("source_size") >= F.col("level") * F.col("weight"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(whole)
    fair = level.withColumn("fair", F.coalesce(free["level"], F.lit(0.0)))
    return fair.select("source", "source_size", "n", F.round(F.least(F.col("fair") * F.col("weight"), most * F.col("source_size")), 6).alias("target"))


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))


def _chunk() -> Column:
    return F.pmod(F.conv(F.substring(F.col("key"), 1, 8), 16, 10).cast("long"), F.ceil(F.col("n") / CHUNK))


def _dealt(rows: DataFrame, targets: DataFrame, seed: int, order: tuple[str, ...]) -> DataFrame:
    """Equal rows as one with their number m, and for its chunk: earlier, the words of the rows before it in order, and share, those that the extra repetition takes."""
    groups = rows.groupBy("source", *order).agg(F.count("*").alias("m"))
    joined = groups.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_size", "n", "target", "ratio")
    dealt = joined.withColumn("key", _key(seed)).withColumn("chunk", _chunk())
    own, words = Window.partitionBy("source", "chunk"), F.col("m") * F.col("size")
    earlier = F.coalesce(F.sum(words).over(own.orderBy("key", *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.select("*", earlier.alias("earlier"), F.floor((F.col("ratio") - F.floor("ratio")) * F.sum(words).over(own) + 0.5).alias("share"))


def _targets(rows: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return table(source_targets(rows.select("source", "size"), weights, most).withColumn("ratio", ratio))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """One row per row of documents: its id, size, source_size, target and taken, the words that the mix takes of it.

    With r = target / source_size, every document is taken floor(r) whole times. The rest of the target is met by one more repetition of
    documents in the order of a seeded hash, the last of them in part, within chunks of about CHUNK documents of a source: a hot source
    spreads over many tasks and each chunk meets its share to the word. So taken never exceeds most * size. Reruns agree; rows that repeat
    an id count each on its own, and equal ones stand for one another, however many. A null text has size 0, null is a source of its own, an
    empty table gives an empty one. Other columns are not read.
    """
    rows = table(documents.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    dealt = _dealt(rows, _targets(rows, weights, most), seed, ("id", "size"))
    # equal rows are numbered from 0, in two steps so that no array is long
    last, zero = F.col("m") - 1, F.lit(0).cast("long")
    step = 1 << 16
    many = dealt.withColumn("part", F.explode(F.sequence(zero, F.floor(last / step)))).withColumn("at", F.explode(F.sequence(F.col("part") * step, F.least(last, F.col("part") * step + step - 1))))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("share") - F.col("earlier") - F.col("at") * F.col("size")))
    return many.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.floor("ratio") * F.col("size") + extra).cast("long").alias("taken"))


def _beside(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """A table that is broadcast if its files are small; else Spark joins it by its keys."""
    return F.broadcast(df) if stored_bytes(df) <= most else df


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """The mix itself, with the columns of documents: a row for each whole repetition, and one with the first words of the text for a part.

    It takes what mix() says. Texts are not shuffled: a chunk's decision is one row, the place in its order up to which documents get their extra
    repetition and the words left for the document there, and every document is held against the row of its chunk. These rows, one for
    about CHUNK documents, are broadcast up to 16 MB of files; beyond that texts go to their chunk's row by a join. Rows that repeat id, source and text at
    such a place share its words evenly, rounded to whole ones. Documents without words are in no mix.
    """
    own = {"id": F.col(id_col), "source": F.col(source_col).cast("string"), "size": word_count(F.col(text_col)), "h": F.xxhash64(text_col)}
    rows = table(documents.select(*(c.alias(name) for name, c in own.items())))
    targets = _targets(rows, weights, most)
    here = _dealt(rows, targets, seed, ("id", "size", "h")).where((F.col("earlier") < F.col("share")) & (F.col("share") <= F.col("earlier") + F.col("m") * F.col("size")))
    cuts = table(here.select("source", "chunk", F.struct("key", "id", "size", "h").alias("cut"), F.floor((F.col("share") - F.col("earlier")) / F.col("m") + 0.5).alias("first")))
    docs = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), own["id"].alias("id"), own["source"].alias("source"))
    known = docs.alias("d").join(_beside(targets).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("row", "id", "d.source", "n", "ratio", _key(seed).alias("key")).withColumn("chunk", _chunk())
    held = known.alias("d").join(_beside(cuts).alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.chunk") == F.col("c.chunk")), "left").select("row", "id", "key", "ratio", "cut", "first")
    text = F.col("row")[text_col]
    # sizes are counted again only for documents with the key of a cut
    place = F.struct("key", "id", word_count(text).alias("size"), F.xxhash64(text).alias("h"))
    before = F.when(F.col("cut").isNull(), False).when(F.col("key") != F.col("cut.key"), F.col("key") < F.col("cut.key")).otherwise(place < F.col("cut"))
    at = F.when(F.col("cut").isNull() | (F.col("key") != F.col("cut.key")), False).otherwise(place == F.col("cut"))
    extra = F.when(before, F.lit(-1)).when(at, F.when(F.col("first") >= F.col("cut.size"), -1).otherwise(F.col("first"))).otherwise(0)
    judged = held.where(text.rlike(WORD)).select("row", F.floor("ratio").cast("int").alias("whole"), extra.cast("int").alias("extra"))
    copies = F.concat(F.array_repeat(F.lit(-1), F.col("whole")), F.when(F.col("extra") != 0, F.array("extra")).otherwise(F.array().cast("array<int>")))
    spread = judged.select("row", F.explode(copies).alias("first"))
    # the words of a part are joined by single spaces
    cut = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("first")), " ")
    return spread.select(*(F.when(F.col("first") > 0, cut).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in documents.columns))


#: The same in DuckDB's SQL.
ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, SUM(size)::DOUBLE AS source_size, COUNT(*) AS n FROM docs GROUP BY source),
weighed AS (
  SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM sources),
filled(round, source, source_size, n, weight, target, capped) AS (
  SELECT 0, source, source_size, n, weight, weight / (SUM(weight) OVER ()) * (SUM(source_size) OVER ()), FALSE FROM weighed
  UNION ALL
  SELECT round + 1, source, source_size, n, weight,
    CASE WHEN capped OR target > 3 * source_size THEN 3 * source_size
         ELSE weight / (SUM(CASE WHEN capped OR target > 3 * source_size THEN 0 ELSE weight END) OVER ())
              * ((SUM(source_size) OVER ()) - (SUM(CASE WHEN capped OR target > 3 * source_size THEN 3 * source_size ELSE 0 END) OVER ())) END,
    capped OR target > 3 * source_size
  FROM filled WHERE round < (SELECT COUNT(*) FROM sources)),
targets AS (
  SELECT source, source_size, n, ROUND(target, 6) AS target, CASE WHEN source_size > 0 THEN ROUND(target, 6) / source_size ELSE 0 END AS ratio
  FROM filled WHERE round = (SELECT COUNT(*) FROM sources)),
keyed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.ratio, md5(concat_ws('|', '42', d.doc_id::VARCHAR)) AS key, CEIL(t.n / 1024.0)::BIGINT AS chunks
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
dealt AS (SELECT *, ('0x' || key[1:8])::BIGINT % chunks AS chunk FROM keyed),
shares AS (
  SELECT *, COALESCE(SUM(size) OVER (PARTITION BY source, chunk ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
    FLOOR((ratio - FLOOR(ratio)) * (SUM(size) OVER (PARTITION BY source, chunk)) + 0.5) AS share FROM dealt)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (FLOOR(ratio) * size + GREATEST(0, LEAST(size, share - earlier)))::BIGINT AS taken FROM shares
"""
