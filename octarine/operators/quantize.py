"""Fixed-point quantization of the axes of each frame, and codes of one long per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octarine.functions import bits as B
from octarine.functions.lineage import placed, spread

AXES = ("x", "y", "z")


def frame_stats(points: DataFrame, axes: Sequence[str] = AXES, frame: str = "frame") -> DataFrame:
    """(frame, n, offset_<axis>, scale_<axis>): offset is -min, scale the largest absolute value, 1 in place of 0."""
    big = {a: F.max(F.abs(a)) for a in axes}
    aggs = [x for a in axes for x in ((-F.min(a)).alias(f"offset_{a}"), F.when(big[a] == 0, 1.0).otherwise(big[a]).alias(f"scale_{a}"))]
    return points.groupBy(frame).agg(F.count(F.lit(1)).alias("n"), *aggs)


def quantize(points: DataFrame, bits: Sequence[int], axes: Sequence[str] = AXES, frame: str = "frame", offset: Sequence[float] | None = None, scale: Sequence[float] | None = None) -> DataFrame:
    """points with q<axis>: (value + offset) * (lim / scale), cut to a whole number; lim is half the largest of its width.

    The statistics are one row for each frame; the planner broadcasts them if they turn out small. An offset or a scale that is given, a number for each axis, stands
    for that of all frames; with them a value whose code would not fit its bits is an error.
    """
    if offset is not None or scale is not None:
        return _fixed(points, bits, axes, frame, offset, scale)
    stats = frame_stats(points, axes, frame).drop("n")
    q = {f"q{a}": ((F.col(a) + F.col(f"offset_{a}")) * (F.lit(((1 << b) - 1) * 0.5) / F.col(f"scale_{a}"))).cast("bigint") for a, b in zip(axes, bits, strict=True)}
    return spread(points, stats, frame).withColumns(q)


def with_fixed(stats: DataFrame, axes: Sequence[str], offset: Sequence[float] | None, scale: Sequence[float] | None) -> DataFrame:
    """frame_stats() with the offset and the scale that are given in place of its own."""
    for name, given in (("offset", offset), ("scale", scale)):
        if given is not None:
            if len(given) != len(axes):
                raise ValueError(f"{len(axes)} axes need as many numbers in {name}")
            stats = stats.withColumns({f"{name}_{a}": F.lit(float(v)) for a, v in zip(axes, given, strict=True)})
    return stats


def _fixed(points: DataFrame, bits: Sequence[int], axes: Sequence[str], frame: str, offset: Sequence[float] | None, scale: Sequence[float] | None) -> DataFrame:
    if scale is not None and min(scale) <= 0:
        raise ValueError("a scale must be above 0")
    stats = with_fixed(frame_stats(points, axes, frame).drop("n"), axes, offset, scale)
    q = {}
    for a, b in zip(axes, bits, strict=True):
        v = F.floor((F.col(a) + F.col(f"offset_{a}")) * (F.lit(((1 << b) - 1) * 0.5) / F.col(f"scale_{a}")))
        q[f"q{a}"] = F.when((v < 0) | (v >= 1 << b), F.raise_error(F.lit(f"a value of {a} is outside of the given offset and scale")).cast("bigint")).otherwise(v.cast("bigint"))
    return spread(points, stats, frame).withColumns(q)


def encode(points: DataFrame, bits: Sequence[int], axes: Sequence[str] = AXES, frame: str = "frame", order: str | Sequence[int] = "packed", offset: Sequence[float] | None = None, scale: Sequence[float] | None = None) -> DataFrame:
    """quantize() with code; order: packed (axes side by side), morton, or a permutation of the packed bits."""
    if sum(bits) > 63:
        raise ValueError("codes of more than 63 bits do not fit a long")
    code = B.pack([F.col(f"q{a}") for a in axes], bits)
    if order == "morton":  # bits of each axis go straight to their places
        to = B.morton(bits)
        starts = [sum(bits[:k]) for k in range(len(bits))]
        code = B.total([F.shiftleft(B.bit(F.col(f"q{a}"), b), to[s + b]) for a, n, s in zip(axes, bits, starts, strict=True) for b in range(n)])
    elif order != "packed":
        code = B.permute(code, list(order))
    return quantize(points, bits, axes, frame, offset, scale).withColumn("code", code)


def decode(codes: DataFrame, bits: Sequence[int], axes: Sequence[str] = AXES, order: str | Sequence[int] = "packed") -> DataFrame:
    """codes with q<axis>."""
    code = F.col("code")
    if order != "packed":
        code = B.permute(code, B.inverse(B.morton(bits) if order == "morton" else list(order)))
    return codes.withColumn("_packed", code).withColumns({f"q{a}": q for a, q in zip(axes, B.unpack(F.col("_packed"), bits), strict=True)}).drop("_packed")


def realize(quantized: DataFrame, bits: Sequence[int], axes: Sequence[str] = AXES) -> DataFrame:
    """quantized (q<axis>, offset_<axis>, scale_<axis>) with r<axis>: the middle of the cell; an axis of no bits has a cell of 0."""
    out = {}
    for a, b in zip(axes, bits, strict=True):
        cell = F.col(f"scale_{a}") / F.lit(((1 << b) - 1) * 0.5) if b else F.lit(0.0)
        out[f"r{a}"] = F.col(f"q{a}") * cell - F.col(f"offset_{a}") + cell / 2
    return quantized.withColumns(out)


def min_max(points: DataFrame, axes: Sequence[str], frame: str = "frame") -> DataFrame:
    """points with n<axis>: (value - min) / (max - min) within the frame; null where all are equal."""
    aggs = [x for a in axes for x in (F.min(a).alias(f"_lo_{a}"), F.max(a).alias(f"_hi_{a}"))]
    met = points.join(points.groupBy(frame).agg(*aggs), frame)
    return met.withColumns({f"n{a}": F.try_divide(F.col(a) - F.col(f"_lo_{a}"), F.col(f"_hi_{a}") - F.col(f"_lo_{a}")) for a in axes}).drop(*[f"_{k}_{a}" for k in ("lo", "hi") for a in axes])


def bit_counts(codes: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bit, ones, n): how often each bit is set."""
    ones = F.array(*[F.sum(B.bit(F.col("code"), k)) for k in range(width)])
    got = codes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ones.alias("ones"))
    return got.select(*by, F.posexplode("ones").alias("bit", "ones"), "n")


def bit_order(counts: DataFrame, by: Sequence[str] = (), absolute: bool = False, reverse: bool = False) -> DataFrame:
    """(by, p, pattern): new bit j is old bit p[j], the rarer first; absolute: by the larger of set and unset. Ties: the lower bit.

    pattern has the bits that more than half the codes have.
    """
    weight = F.greatest(F.col("ones"), F.col("n") - F.col("ones")) if absolute else F.col("ones")
    key = F.struct((-weight if reverse else weight).alias("w"), F.col("bit").alias("b"))
    rows = counts.withColumn("_key", key).withColumn("_set", F.when(2 * F.col("ones") > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).otherwise(F.lit(0).cast("bigint")))
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list("_key")), lambda x: x["b"]).alias("p"), F.bit_or("_set").alias("pattern"))


#: Codes of a word of bit_planes().
WORD = 48


def bit_planes(codes: DataFrame, width: int, frame: str = "frame", code: str = "code") -> DataFrame:
    """(frame, word, plane, bits, n): the transposed bits of WORD codes at a time, in the order of the codes: plane 0 has their highest bits, the first code's in the highest of WORD places. n: codes of the word."""
    at = placed(codes.select(frame, F.col(code).alias("_c")), ["_c"], frame, "_k")
    planes = at.select(frame, F.floor(F.col("_k") / WORD).alias("word"), (F.col("_k") % WORD).alias("_at"), F.posexplode(F.array(*[B.bit(F.col("_c"), width - 1 - b) for b in range(width)])).alias("plane", "_v"))
    return planes.groupBy(frame, "word", F.col("plane").cast("bigint").alias("plane")).agg(F.sum(F.call_function("shiftleft", F.col("_v"), (F.lit(WORD - 1) - F.col("_at")).cast("int"))).alias("bits"), F.count(F.lit(1)).alias("n"))


def from_planes(planes: DataFrame, width: int, frame: str = "frame") -> DataFrame:
    """(frame, word, at, code) from bit_planes(): code at of each word."""
    each = planes.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    bit = F.call_function("shiftrightunsigned", F.col("bits"), (F.lit(WORD - 1) - F.col("at")).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    return each.groupBy(frame, "word", "at").agg(F.sum(F.call_function("shiftleft", bit, (F.lit(width - 1) - F.col("plane")).cast("int"))).alias("code"))
