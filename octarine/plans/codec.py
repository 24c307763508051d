"""Frames to headers and symbols, and back: the operators in the order that a user runs them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octarine.functions import bits as B
from octarine.functions import geometry as G
from octarine.functions.lineage import cut, spread
from octarine.operators import coding, entropy, ntree, quantize, sequences


@dataclass(frozen=True)
class Config:
    """What frames are coded by, and decoded.

    axes and their bits; dims of the layers, which name their coders (see coding.symbols); order of the bits (packed, morton, or a
    permutation); spherical: code u, v, d instead; sort_bits: each frame's bits by how rare they are; payload: lone codes as they are;
    chunk: so many frames coded as one, each with its place in chunk_bits of its own; archive: deflate the streams, whose size then counts.
    offset, scale: of all frames, a number for each axis, in place of each frame's own; sort_absolute: bits by the larger of set and unset; sort_reverse: the other way round.
    """

    axes: Sequence[str] = ("x", "y", "z")
    bits: Sequence[int] = (16, 16, 16)
    dims: Sequence[int] = (3,)
    order: str | Sequence[int] = "morton"
    spherical: bool = False
    sort_bits: bool = False
    payload: bool = False
    chunk: int = 1
    chunk_bits: int = 8
    archive: bool = False
    offset: Sequence[float] | None = None
    scale: Sequence[float] | None = None
    sort_absolute: bool = False
    sort_reverse: bool = False

    @property
    def width(self) -> int:
        return sum(self.bits) + (self.chunk_bits if self.chunk > 1 else 0)

    @property
    def bins(self) -> int:
        """Symbols that a node of the largest dimension can have."""
        return 1 << (1 << max(0, *self.dims))

    @property
    def depth(self) -> int:
        return len(ntree.plan_dims(self.dims, self.width))


def encode_frames(points: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(headers, symbols) of points (frame and the axes): those that are no numbers are dropped, equal codes are one.

    headers: a row for each frame, with what decoding needs and the sizes; symbols: occupancy by layer and node. What only streams can hold (payload, sort_bits,
    chunk, archive, coders other than occupancy) is an error here: compress() has it.
    """
    if cfg.payload or cfg.sort_bits or cfg.archive or cfg.chunk > 1 or min(ntree.plan_dims(cfg.dims, cfg.width)) <= 0:
        raise ValueError("tables of symbols have no payload, sorted bits, chunks, archive or counters: use compress()")
    kept = points.where(G.finite([F.col(a) for a in cfg.axes]))
    if cfg.spherical:
        u, v, d = G.spherical(*[F.col(a) for a in cfg.axes])
        kept = kept.select("frame", *[F.coalesce(c, F.lit(0.0)).alias(a) for a, c in zip(cfg.axes, (u, v, d), strict=True)])
    codes = quantize.encode(kept, cfg.bits, cfg.axes, order=cfg.order, offset=cfg.offset, scale=cfg.scale).select("frame", "code").distinct()
    symbols = ntree.symbols(codes, cfg.dims, cfg.width)
    stats = quantize.with_fixed(quantize.frame_stats(kept, cfg.axes), cfg.axes, cfg.offset, cfg.scale).withColumnRenamed("n", "inp_points")
    sizes = ntree.bit_cost(symbols).withColumnRenamed("bits", "flag_bits").join(codes.groupBy("frame").agg(F.count(F.lit(1)).alias("out_points")), "frame")
    heads = stats.join(sizes, "frame").withColumns({"payload_bits": F.lit(0).cast("bigint"), "archive_bits": F.lit(None).cast("bigint"), "dims": F.array(*map(F.lit, cfg.dims)), "bits_per_dim": F.array(*map(F.lit, cfg.bits))})
    return heads, symbols


def decode_frames(headers: DataFrame, symbols: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(frame, axes): the middles of the occupied cells."""
    codes = ntree.decode(symbols, cfg.dims, cfg.width)
    cells = quantize.decode(codes, cfg.bits, cfg.axes, cfg.order).join(headers, "frame")
    real = quantize.realize(cells, cfg.bits, cfg.axes).select("frame", *[F.col(f"r{a}").alias(a) for a in cfg.axes])
    if not cfg.spherical:
        return real
    back = G.cartesian(*[F.col(a) for a in cfg.axes])
    return real.select("frame", *[c.alias(a) for a, c in zip(cfg.axes, back, strict=True)])


def streams(symbols: DataFrame) -> DataFrame:
    """(frame, n, bits, stream) of occupancy symbols of up to five dimensions."""
    return entropy.streams(symbols.withColumn("width", F.call_function("shiftleft", F.lit(1), F.col("dim"))))


def reordered(codes: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Codes with their bits in the order of how rare they are, and each frame's permutation that brings them back."""
    order = quantize.bit_order(quantize.bit_counts(codes, width, ["frame"]), ["frame"])
    new = B.total([F.shiftleft(F.call_function("shiftrightunsigned", F.col("code"), F.get("p", F.lit(j)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")), j) for j in range(width)])
    return spread(codes, order, "frame").select("frame", new.alias("code")), order


def compress(points: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A row for each frame, or chunk of frames: what decoding needs, the streams and their sizes; points: frame and the axes.

    Points that are no numbers are dropped, equal codes are one. inp_points, out_points, flag_bits, payload_bits and archive_bits give the bits per point.
    """
    kept = points.where(G.finite([F.col(a) for a in cfg.axes])).select("frame", *cfg.axes)
    if cfg.spherical:
        back = G.spherical(*[F.col(a) for a in cfg.axes])
        kept = kept.select("frame", *[F.coalesce(c, F.lit(0.0)).alias(a) for a, c in zip(cfg.axes, back, strict=True)])
    names = None
    if cfg.chunk > 1:
        if cfg.chunk > 1 << cfg.chunk_bits:
            raise ValueError(f"{cfg.chunk} frames need more than {cfg.chunk_bits} bits")
        placed = sequences.chunks(kept.select("frame").distinct(), cfg.chunk, "frame")
        kept = spread(kept, placed, "frame").withColumn("frame", F.col("chunk")).drop("chunk")
        names = placed.groupBy(F.col("chunk").alias("frame")).agg(F.sort_array(F.collect_list(F.struct("slot", F.col("frame").alias("name")))).alias("frames"))
    codes = quantize.encode(kept, cfg.bits, cfg.axes, order=cfg.order, offset=cfg.offset, scale=cfg.scale)
    if cfg.chunk > 1:
        codes = codes.withColumn("code", F.col("code") + F.shiftleft(F.col("slot").cast("bigint"), sum(cfg.bits)))
    codes = cut(codes.select("frame", "code").distinct())
    stats = quantize.with_fixed(quantize.frame_stats(kept, cfg.axes), cfg.axes, cfg.offset, cfg.scale)
    heads = stats.withColumnRenamed("n", "inp_points").join(codes.groupBy("frame").agg(F.count(F.lit(1)).alias("out_points")), "frame")
    if cfg.sort_bits:
        order = cut(quantize.bit_order(quantize.bit_counts(codes, cfg.width, ["frame"]), ["frame"], cfg.sort_absolute, cfg.sort_reverse))
        codes, heads = coding.sorted_bits(codes, order, cfg.width), heads.join(order, "frame")
    written = coding.write(*coding.symbols(codes, cfg.dims, cfg.width, cfg.payload), archive=cfg.archive)
    heads = heads if names is None else heads.join(names, "frame")
    return heads.join(written, "frame").withColumn("archive_bits", 8 * F.octet_length("archive").cast("bigint"))


def expand(compressed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(frame, axes) from compress(): the middles of the occupied cells; of chunks the frames by their own names."""
    codes = coding.read(compressed, cfg.dims, cfg.width, cfg.payload)
    if cfg.sort_bits:
        codes = coding.unsorted_bits(codes, compressed, cfg.width)
    low = sum(cfg.bits)
    codes = codes.withColumn("slot", F.shiftright("code", low) if cfg.chunk > 1 else F.lit(0).cast("bigint")).withColumn("code", F.col("code").bitwiseAND(F.lit((1 << low) - 1)))
    keep = [f"{k}_{a}" for a in cfg.axes for k in ("offset", "scale")] + (["frames"] if cfg.chunk > 1 else [])
    cells = quantize.decode(codes, cfg.bits, cfg.axes, cfg.order).join(compressed.select("frame", *keep), "frame")
    named = F.element_at(F.filter("frames", lambda x: x["slot"] == F.col("slot")), 1)["name"] if cfg.chunk > 1 else F.col("frame")
    real = quantize.realize(cells, cfg.bits, cfg.axes).select(named.alias("frame"), *[F.col(f"r{a}").alias(a) for a in cfg.axes])
    if not cfg.spherical:
        return real
    back = G.cartesian(*[F.col(a) for a in cfg.axes])
    return real.select("frame", *[c.alias(a) for a, c in zip(cfg.axes, back, strict=True)])
