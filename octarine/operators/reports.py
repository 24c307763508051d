"""Roll-ups of rates and distortions by configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bits_per_point(headers: DataFrame) -> DataFrame:
    """headers with bpp_in and bpp_out: bits of flags and payload, or of the archive where there is one, for each point read and kept."""
    bits = F.coalesce(F.col("archive_bits"), F.col("flag_bits") + F.coalesce("payload_bits", F.lit(0)))
    return headers.withColumns({"bpp_in": F.try_divide(bits.cast("double"), F.col("inp_points")), "bpp_out": F.try_divide(bits.cast("double"), F.col("out_points"))})


def by_configuration(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(gid, avg, min, max): rows grouped by the named columns, joined by commas; a column that is missing counts as false."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("false")) if k in rows.columns else F.lit("false") for k in keys]
    return rows.groupBy(F.concat_ws(",", *parts).alias("gid")).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))


def roll_up(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """(metric, min, max, mean) of each named column over all rows."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("r")).select("r.*")
    return long.groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def five_numbers(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, lo, q1, mid, q3, hi) with interpolated quartiles."""
    got = rows.groupBy(*by).agg(F.percentile(value, [0.0, 0.25, 0.5, 0.75, 1.0]).alias("_p"))
    return got.select(*by, *[F.col("_p")[k].alias(n) for k, n in enumerate(("lo", "q1", "mid", "q3", "hi"))])


def segment_stats(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(value).alias("sum"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def farthest(rows: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """(by, key, value): the row of the largest value of each segment; ties: the least key."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(key)).alias("k")))
    return rows.groupBy(*by).agg(best.alias("_b")).select(*by, (-F.col("_b.k")).alias(key), F.col("_b.v").alias(value))


def rate_distortion(rows: DataFrame, precision: str, x: str = "bpp", y: str = "psnr") -> DataFrame:
    """The points of one curve: rows of the precision, their rate and distortion."""
    return rows.where(F.col("precision") == precision).select("codec", x, y)
