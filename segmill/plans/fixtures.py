"""Frames of images, annotations, masks, patches, metrics and logs, derived from the driver's tables.

The arithmetic is our own, and such that SQL can repeat it. Canvases are 160 x 160.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

SIZE = 160


def images(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".jpg")).alias("file_name"), F.lit(SIZE).alias("width"), F.lit(SIZE).alias("height"))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """image_id, ord (within the image), ann_id, box, area, source, flag, score and three numbers."""
    i = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    left = ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 53) % 60).cast("int")
    top = ((F.col("l_suppkey") * 71 + F.col("l_partkey") * 11) % 60).cast("int")
    i = i.select("*", F.row_number().over(w).alias("ord"), left.alias("l"), top.alias("t"))
    i = i.withColumns({
        "r": F.least(F.lit(SIZE), F.col("l") + 4 + (2 * F.col("l_quantity")).cast("int")),
        "b": F.least(F.lit(SIZE), F.col("t") + 4 + (F.col("l_partkey") % 97).cast("int")),
    })
    return i.select(
        F.col("l_orderkey").alias("image_id"), "ord", (F.col("l_orderkey") * 1000 + F.col("ord")).alias("ann_id"), "l", "t", "r", "b",
        ((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).alias("area"), F.when(F.col("l_linestatus") == "F", "baseline").otherwise("crop").alias("source"),
        F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("score"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linenumber").alias("line"),
    )


ANN = f"""a0 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INTEGER) AS ord,
    CAST((l_partkey * 37 + l_linenumber * 53) % 60 AS INTEGER) AS l, CAST((l_suppkey * 71 + l_partkey * 11) % 60 AS INTEGER) AS t FROM lineitem
), a1 AS (
  SELECT *, CAST(least({SIZE}, l + 4 + CAST(floor(2 * l_quantity) AS INTEGER)) AS INTEGER) AS r, CAST(least({SIZE}, t + 4 + CAST(l_partkey % 97 AS INTEGER)) AS INTEGER) AS b FROM a0
), ann AS (
  SELECT l_orderkey AS image_id, ord, l_orderkey * 1000 + ord AS ann_id, l, t, r, b, (r - l) * (b - t) AS area,
    CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'crop' END AS source, l_returnflag AS flag, l_extendedprice AS score, l_discount AS discount, l_tax AS tax, l_linenumber AS line FROM a1
)"""


def masks(spark: SparkSession, d: str) -> DataFrame:
    """mask_id, image_id, bits: 8 x 8 masks of the embeddings' signs, 25 to an image."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("mask_id"), F.floor(F.col("vec_id") / 25).alias("image_id"), F.transform("embedding", lambda v: (v > 0).cast("tinyint")).alias("bits"))


MASKS = "m AS (SELECT vec_id AS mask_id, vec_id // 25 AS image_id, list_transform(embedding, lambda v: CAST(v > 0 AS INTEGER)) AS bits FROM embeddings)"
#: A mask's pixels as rows.
PIXELS = MASKS + ", px AS (SELECT mask_id, image_id, unnest(bits) AS v, generate_subscripts(bits, 1) - 1 AS i FROM m), p AS (SELECT mask_id, image_id, v, i // 8 AS y, i % 8 AS x FROM px)"


def patches(spark: SparkSession, d: str) -> DataFrame:
    """image_id, y, x, feat: 5 x 5 grids of patch features."""
    e = table(spark, d, "embeddings")
    k = F.col("vec_id") % 25
    return e.select(F.floor(F.col("vec_id") / 25).alias("image_id"), F.floor(k / 5).cast("int").alias("y"), (k % 5).cast("int").alias("x"), F.transform("embedding", lambda v: v.cast("double")).alias("feat"))


PATCHES = "pt AS (SELECT vec_id // 25 AS image_id, CAST(vec_id % 25 // 5 AS INTEGER) AS y, CAST(vec_id % 5 AS INTEGER) AS x, CAST(embedding AS DOUBLE[]) AS feat FROM embeddings)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("iteration"), "value")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """run, line_no, line: an evaluation log of every supplier."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    v = [(F.col("s_suppkey") * k + F.col("s_nationkey") * 7) % 1000 for k in (3, 5, 7, 11, 13, 17)]
    values = F.concat_ws(",", *[F.concat(F.floor(x / 10), F.lit("."), x % 10) for x in v])
    at = F.lit("[07/01] d2.evaluation.testing INFO: copypaste: ")
    lines = F.array(F.lit("starting"), F.concat(at, F.lit("Task: bbox")), F.concat(at, F.lit("AP,AP50,AP75,APs,APm,APl")), F.concat(at, values), F.concat(at, F.lit("Task: segm")), F.lit("no block"))
    return s.select(F.concat(F.lit("run"), "s_suppkey").alias("run"), F.posexplode(lines).alias("line_no", "line"))
