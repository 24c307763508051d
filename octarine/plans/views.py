"""Point views over the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of each axis of the line-item cloud.
BITS = (8, 8, 8)
WIDTH = sum(BITS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each return flag; x, y, z are quantity, price and discount."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("frame"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each label; x, y, z are the first three components."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("bigint").alias("frame"), F.col("vec_id").alias("point_id"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event type; a scan of values in the order of the events."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("frame"), F.col("event_id").alias("point_id"), F.col("value").alias("y"))


LP = "lp as (select l_returnflag frame, l_quantity x, l_extendedprice y, l_discount z from lineitem)"
EP = "ep as (select cast(label as bigint) frame, vec_id point_id, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z from embeddings)"
VP = "vp as (select event_type frame, event_id point_id, value y from events)"
_SCALE = "case when max(abs({a})) = 0 then 1.0 else max(abs({a})) end s{a}"
STATS = "st as (select frame f, " + ", ".join(f"-min({a}) o{a}, " + _SCALE.format(a=a) for a in "xyz") + " from lp group by frame)"
Q = "q as (select frame, " + ", ".join(f"cast(trunc(({a} + o{a}) * (127.5 / s{a})) as bigint) q{a}" for a in "xyz") + " from lp join st on frame = f)"
PACKED = "c as (select distinct frame, qx + (qy << 8) + (qz << 16) code from q)"
_MORTON = " + ".join(f"(((q{a} >> {b}) & 1) << {3 * b + k})" for b in range(8) for k, a in enumerate("xyz"))
MORTON = f"m as (select distinct frame, {_MORTON} code from q)"
CODES = f"{LP}, {STATS}, {Q}, {PACKED}"
MCODES = f"{LP}, {STATS}, {Q}, {MORTON}"
#: Octree layers of 24-bit codes.
TOKENS = "t as (select frame, code, l layer, code >> cast(24 - 3 * l as int) parent, (code >> cast(21 - 3 * l as int)) & 7 child from m, range(8) r(l))"
BINARY = "b as (select frame, code, l layer, code >> cast(24 - l as int) parent, (code >> cast(23 - l as int)) & 1 child from m, range(24) r(l))"
