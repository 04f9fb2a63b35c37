"""The geometric tables that the driver's relational tables stand for, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, x, y, z and normals nx, ny, nz from the first six components of each embedding."""
    e = F.col("embedding")
    n = [e[k].cast("double") for k in (3, 4, 5)]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *(e[k].cast("double").alias(c) for k, c in enumerate("xyz")), *((x / length).alias(f"n{c}") for x, c in zip(n, "xyz", strict=True)))


POINTS = """p AS (SELECT id, label, x, y, z, a / l AS nx, b / l AS ny, c / l AS nz FROM (
  SELECT *, sqrt(a * a + b * b + c * c) AS l FROM (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
  embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings)))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, centre cx, cy, cz, half extent h and axis-aligned bounds of each part."""
    p = read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).cast("double").alias("cx"), (F.col("p_partkey") % 89).cast("double").alias("cy"), (F.col("p_retailprice") / 100).alias("cz"), (F.col("p_size") / 20.0).alias("h"))
    return rows.select("*", *((F.col(f"c{c}") + (F.col("h") if s == "max" else -F.col("h"))).alias(f"{c}{s}") for c in "xyz" for s in ("min", "max")))


BOXES = """b AS (SELECT *, cx - h AS xmin, cx + h AS xmax, cy - h AS ymin, cy + h AS ymax, cz - h AS zmin, cz + h AS zmax FROM (
  SELECT p_partkey AS id, (p_partkey % 97)::DOUBLE AS cx, (p_partkey % 89)::DOUBLE AS cy, p_retailprice / 100 AS cz, p_size / 20.0::DOUBLE AS h FROM part))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of a grid over each supplier: low, high and mesh."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("element"), (F.col("l_quantity") / 10).alias("low"), (F.col("l_quantity") / 10 + F.col("l_tax") * 10 + 0.5).alias("high"), (F.col("l_quantity") / 10 + F.col("l_discount") * 10).alias("mesh"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("d"))


CELLS = """c AS (SELECT l_suppkey AS element, l_quantity / 10 AS low, l_quantity / 10 + l_tax * 10 + 0.5::DOUBLE AS high, l_quantity / 10 + l_discount * 10 AS mesh, abs(l_discount - l_tax) AS d FROM lineitem)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, regions and suppliers as linked data."""
    from geoweft.operators.triples import to_triples

    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("subject"), F.lit("Nation").alias("type"), F.col("n_name").alias("label"), F.concat(F.lit("region/"), "n_regionkey").alias("part"))
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("subject"), F.lit("Region").alias("type"), F.col("r_name").alias("label"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("subject"), F.lit("Supplier").alias("type"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("label"), F.concat(F.lit("nation/"), "s_nationkey").alias("part"))
    return to_triples(n, {"type": "type", "label": "label", "part": "isPartOf"}).union(to_triples(r, {"type": "type", "label": "label"})).union(to_triples(s, {"type": "type", "label": "label", "part": "isPartOf"}))


TRIPLES = """t AS (
  SELECT 'nation/' || n_nationkey AS subject, 'type' AS predicate, 'Nation' AS object FROM nation UNION ALL SELECT 'nation/' || n_nationkey, 'label', n_name FROM nation
  UNION ALL SELECT 'nation/' || n_nationkey, 'isPartOf', 'region/' || n_regionkey FROM nation
  UNION ALL SELECT 'region/' || r_regionkey, 'type', 'Region' FROM region UNION ALL SELECT 'region/' || r_regionkey, 'label', r_name FROM region
  UNION ALL SELECT 'supplier/' || s_suppkey, 'type', 'Supplier' FROM supplier UNION ALL SELECT 'supplier/' || s_suppkey, 'label', s_name FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT 'supplier/' || s_suppkey, 'isPartOf', 'nation/' || s_nationkey FROM supplier)"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each line of an order, as a scan of the parts' places: id, x, y, z."""
    p, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    return read(spark, sf_dir, "lineitem").select(((o * 8 + F.col("l_linenumber")) * 100_000_000 + p * 1000 + s % 1000).alias("id"), (p % 97 + (o % 101) / 101.0).alias("x"), (p % 89 + (s % 103) / 103.0).alias("y"), (F.col("l_quantity") / 5 + F.col("l_tax")).alias("z"))


CLOUD = """cloud AS (SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, l_partkey % 97 + (l_orderkey % 101) / 101.0::DOUBLE AS x, l_partkey % 89 + (l_suppkey % 103) / 103.0::DOUBLE AS y, l_quantity / 5.0::DOUBLE + l_tax AS z FROM lineitem)"""
