"""Pictures derived from the driver's tables, in Spark and, by the same rules, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import idiv


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as an 8x8 picture whose colours follow its values; clear, half and opaque pixels all occur."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("picture_id"), F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int")))
    rows = rows.select("picture_id", (F.col("i") % 8).alias("x"), idiv(F.col("i"), 8).alias("y"), v.alias("v"))
    a = F.when(F.col("v") % 11 == 0, 0).when(F.col("v") % 3 == 0, 255).otherwise(F.col("v") * 5 % 256)
    return rows.select("picture_id", "x", "y", a.alias("a"), F.col("v").alias("r"), (F.col("v") * 3 % 256).alias("g"), (F.col("v") * 7 % 256).alias("b"))


PX = """e0 AS (SELECT vec_id AS picture_id, unnest(embedding) AS e, CAST(unnest(range(len(embedding))) AS INTEGER) AS i FROM embeddings),
v0 AS (SELECT picture_id, i, CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS INTEGER) AS v FROM e0),
px AS (SELECT picture_id, i % 8 AS x, i // 8 AS y, CASE WHEN v % 11 = 0 THEN 0 WHEN v % 3 = 0 THEN 255 ELSE v * 5 % 256 END AS a,
  v AS r, v * 3 % 256 AS g, v * 7 % 256 AS b FROM v0)"""


def side(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Even (0) or odd (1) pictures, numbered as pairs."""
    px = pixels(spark, d).filter(F.col("picture_id") % 2 == k)
    return px.withColumn("picture_id", F.expr("picture_id div 2"))


PAIR = (
    PX
    + """,
s0 AS (SELECT picture_id // 2 AS picture_id, x, y, a AS sa, r AS sr, g AS sg, b AS sb FROM px WHERE picture_id % 2 = 0),
d0 AS (SELECT picture_id // 2 AS picture_id, x, y, a AS da, r AS dr, g AS dg, b AS db FROM px WHERE picture_id % 2 = 1),
pr AS (SELECT * FROM s0 JOIN d0 USING (picture_id, x, y))"""
)


def animation(spark: SparkSession, d: str) -> DataFrame:
    """Frames (picture_id, frame_idx, delay_ms) from events: one animation a user, some delays zero."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("picture_id"), (F.row_number().over(w) - 1).alias("frame_idx"), (F.floor("value").cast("bigint") % 40).cast("int").alias("delay_ms"))


ANIM = """fr AS (SELECT user_id AS picture_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS frame_idx,
  CAST(CAST(floor(value) AS BIGINT) % 40 AS INTEGER) AS delay_ms FROM events)"""


def clip(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of animations: the pictures of one label are its frames."""
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    order = e.select(F.col("vec_id").alias("picture_id"), F.col("label").cast("bigint").alias("label"), (F.row_number().over(w) - 1).alias("frame_idx"))
    return pixels(spark, d).join(order, "picture_id").select(F.col("label").alias("picture_id"), "frame_idx", "x", "y", "a", "r", "g", "b")


CLIP = (
    PX
    + """,
o0 AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_idx FROM embeddings),
cl AS (SELECT label AS picture_id, frame_idx, x, y, a, r, g, b FROM px JOIN o0 ON vec_id = px.picture_id)"""
)


def film(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of animations of 32x32 frames: sixteen pictures of one label, in order, are a frame; places left over are empty."""
    e = table(spark, d, "embeddings")
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    order = e.select(F.col("vec_id").alias("picture_id"), F.col("label").cast("bigint").alias("label"), n.alias("n"))
    px = pixels(spark, d).join(order, "picture_id")
    x, y = F.col("n") % 4 * 8 + F.col("x"), idiv(F.col("n") % 16, 4) * 8 + F.col("y")
    return px.select(F.col("label").alias("picture_id"), idiv(F.col("n"), 16).alias("frame_idx"), x.alias("x"), y.alias("y"), "a", "r", "g", "b")


FILM = (
    PX
    + """,
f0 AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS n FROM embeddings),
f1 AS (SELECT label AS picture_id, n // 16 AS frame_idx, n % 4 * 8 + x AS x, n % 16 // 4 * 8 + y AS y, a, r, g, b FROM px JOIN f0 ON vec_id = px.picture_id),
f2 AS (SELECT picture_id, frame_idx, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT DISTINCT picture_id, frame_idx FROM f1), (SELECT unnest(range(32)) AS x), (SELECT unnest(range(32)) AS y)),
film AS (SELECT picture_id, frame_idx, x, y, coalesce(a, 0) AS a, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM f2 LEFT JOIN f1 USING (picture_id, frame_idx, x, y))"""
)


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """A sparse canvas from order lines: 64 columns, a row for each line number; colours are the largest of repeats."""
    l = table(spark, d, "lineitem")
    rows = l.groupBy(F.expr("l_orderkey div 64").alias("picture_id"), (F.col("l_orderkey") % 64).cast("int").alias("x"), (F.col("l_linenumber") - 1).cast("int").alias("y"))
    part, supp, much = F.max("l_partkey"), F.max("l_suppkey"), F.max("l_quantity")
    return rows.agg((part % 4 * 85).cast("int").alias("a"), (part % 256).cast("int").alias("r"), (supp % 256).cast("int").alias("g"), F.floor(much * 5).cast("int").alias("b"))


SPARSE = """ln AS (SELECT l_orderkey // 64 AS picture_id, CAST(l_orderkey % 64 AS INTEGER) AS x, CAST(l_linenumber - 1 AS INTEGER) AS y,
  CAST(max(l_partkey) % 4 * 85 AS INTEGER) AS a, CAST(max(l_partkey) % 256 AS INTEGER) AS r, CAST(max(l_suppkey) % 256 AS INTEGER) AS g,
  CAST(floor(max(l_quantity) * 5) AS INTEGER) AS b FROM lineitem GROUP BY 1, 2, 3)"""
