"""Ordered operators: windows over scan order, blocks of frames, and recurrences that need one task for each frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from octarine.functions.lineage import numbered
from octarine.operators import scans
from octarine.operators.scans import keypoints, simplify  # noqa: F401  as sequences.keypoints and .simplify


def _by(frame: str, order: str) -> W:
    return W.partitionBy(frame).orderBy(order)


def running_sums(points: DataFrame, value: str, frame: str = "frame", order: str = "point_id") -> DataFrame:
    """points with before (the sum of the earlier values) and upto (with the own)."""
    w = _by(frame, order)
    return points.withColumns({"before": F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast(points.schema[value].dataType)), "upto": F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))})


def scan_rings(points: DataFrame, value: str = "y", frame: str = "frame", order: str = "point_id") -> DataFrame:
    """points with ring: how often the value has turned from below 0 to 0 or above so far."""
    w = _by(frame, order)
    turned = ((F.lag(value).over(w) < 0) & (F.col(value) >= 0)).cast("bigint")
    return points.withColumn("_t", F.coalesce(turned, F.lit(0))).withColumn("ring", F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_t")


def rank_rings(rings: DataFrame, height: str = "z", frame: str = "frame", digits: int = 9) -> DataFrame:
    """(frame, ring, mean, rank): rings in the order of their mean height; ties: the lower ring.

    Heights are summed as whole numbers of units of 10^-digits, so that rows in another order give the same mean, and equal means are equal. A ring
    with heights that are too large for that, or not finite, has the mean of its doubles.
    """
    units = F.expr(f"try_cast(round({height} * 1e{digits}) as decimal(28, 0))")
    exact = (F.count(units) == F.count(F.col(height))) & (F.count(units) > 0)
    means = rings.groupBy(frame, "ring").agg(F.when(exact, F.try_divide(F.try_divide(F.sum(units).cast("double"), F.count(units)), F.lit(10.0**digits))).otherwise(F.avg(height)).alias("mean"))
    return means.withColumn("rank", F.row_number().over(W.partitionBy(frame).orderBy("mean", "ring")))


def neighbours(points: DataFrame, value: str, k: int, frame: str = "frame", order: str = "point_id") -> DataFrame:
    """points with around: the values k/2 places before to k/2 after, without the own, in a circle over the frame."""
    return scans.around(points, value, k, [frame], order)


def blocks(points: DataFrame, limit: int, values: Sequence[str], frame: str = "frame", order: str = "point_id") -> DataFrame:
    """points with block (limit rows each, from 0) and d<value>: the difference to the block's first row."""
    numbered = points.withColumn("block", F.floor((F.row_number().over(_by(frame, order)) - 1) / limit))
    first = W.partitionBy(frame, "block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return numbered.withColumns({f"d{v}": F.col(v) - F.first(v).over(first) for v in values})


def chunks(frames: DataFrame, limit: int, name: str = "name") -> DataFrame:
    """frames with chunk and slot: limit frames to a chunk in the order of their names, as one cloud with the slot as a fourth axis."""
    k = F.col("_k")
    return numbered(frames, [name], "_k").withColumns({"chunk": F.floor(k / limit), "slot": F.pmod(k, F.lit(limit))}).drop("_k")


def batches(points: DataFrame, value: str, size: int, frame: str = "frame", order: str = "point_id", pad: float = 0.0) -> DataFrame:
    """points with window: the last size values up to each, padded on the left."""
    w = _by(frame, order).rowsBetween(-(size - 1), 0)
    got = F.collect_list(value).over(w)
    return points.withColumn("window", F.concat(F.array_repeat(F.lit(pad), F.lit(size) - F.size(got)), got))


def deltas(points: DataFrame, value: str, frame: str = "frame", order: str = "point_id") -> DataFrame:
    """points with delta: the difference to the value before; null for the first."""
    return points.withColumn("delta", F.col(value) - F.lag(value).over(_by(frame, order)))


def next_marked(points: DataFrame, mark: str, value: str, frame: str = "frame", order: str = "point_id") -> DataFrame:
    """points with next_value: that of the next marked row after each.

    The order is gone through backwards, as a frame that grows keeps its last value, while one that shrinks is read anew for each row.
    """
    w = W.partitionBy(frame).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    return points.withColumn("next_value", F.last(F.when(F.col(mark), F.col(value)), ignorenulls=True).over(w))


def smooth(points: DataFrame, value: str, weight: float = 0.9, frame: str = "frame", order: str = "point_id") -> DataFrame:
    """points with smoothed: the running mean before the own value is taken in; the first is the value itself. Frames are gone through in blocks (see scans.decayed)."""
    return scans.decayed(points, [value], weight, 1 - weight, frame, order).withColumnRenamed(f"before_{value}", "smoothed")


def align(points: DataFrame, axes: Sequence[str] = ("x", "y", "z"), frame: str = "frame", keep: bool = False) -> DataFrame:
    """points with a<k>: the frame's principal axes, the widest first, about its mean; the signs make each axis' largest part positive. keep: with mean and basis, for unalign().

    Means and covariances are one aggregation; a row for each frame is solved in Python and joined back.
    """
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    sums = points.groupBy(frame).agg(*[F.avg(a).alias(f"m_{a}") for a in axes], *[F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in pairs])
    n = len(axes)
    schema = T.StructType([points.schema[frame], T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("basis", T.ArrayType(T.DoubleType()))])

    def solve(parts):
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                m = np.zeros((n, n))
                for a, b in pairs:
                    m[axes.index(a), axes.index(b)] = m[axes.index(b), axes.index(a)] = r[f"c_{a}{b}"]
                _, v = np.linalg.eigh(m)
                v = v[:, ::-1]
                v = v * np.sign(v[np.abs(v).argmax(0), range(n)])
                out.append((r[frame], [r[f"m_{a}"] for a in axes], v.T.ravel().tolist()))
            yield pd.DataFrame(out, columns=[frame, "mean", "basis"])

    met = points.join(sums.mapInPandas(solve, schema), frame)
    centred = [F.col(a) - F.col("mean")[i] for i, a in enumerate(axes)]
    out = {}
    for k in range(n):
        s = centred[0] * F.col("basis")[k * n]
        for i in range(1, n):
            s = s + centred[i] * F.col("basis")[k * n + i]
        out[f"a{k}"] = s
    return met.withColumns(out) if keep else met.withColumns(out).drop("mean", "basis")


def unalign(aligned: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """align()'s rows (a<k>, mean, basis) with the axes back from the principal ones."""
    n = len(axes)
    back = {a: sum((F.col(f"a{k}") * F.col("basis")[k * n + i] for k in range(n)), F.col("mean")[i]) for i, a in enumerate(axes)}
    return aligned.withColumns(back).drop("mean", "basis")


def augment(points: DataFrame, seed: int = 42, frame: str = "frame") -> DataFrame:
    """points rounded to a grid and turned about z, by a scale from 10 to 1000 and an angle that the frame's hash and the seed fix."""
    share = lambda k: F.pmod(F.xxhash64(F.col(frame), F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    scale, angle = 10 + 990 * share(0), 2 * math.pi * share(1)
    grid = points.withColumns({"_s": scale, "_a": angle}).withColumns({f"_{a}": F.round(F.col(a) * F.col("_s")) / F.col("_s") for a in ("x", "y", "z")})
    return grid.withColumns({"x": F.col("_x") * F.cos("_a") - F.col("_y") * F.sin("_a"), "y": F.col("_x") * F.sin("_a") + F.col("_y") * F.cos("_a"), "z": F.col("_z")}).drop("_s", "_a", "_x", "_y", "_z")
