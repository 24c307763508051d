"""Bit streams that many tasks write and read: pieces are packed where they are, moved to their bit and joined in chunks of bytes.

A stream is a table (frame, chunk, content): chunk k holds the bytes from k times the chunk's size on, and all but the last of a frame are full. Together they are what
functions.ranges.pack() makes of the whole frame. No task holds more than a piece or a chunk, however long a frame is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octarine.functions import ranges as R
from octarine.functions.lineage import cut, placed, prefix

#: Bytes of a chunk, and symbols that one call packs.
CHUNK, PIECE = 1 << 16, 1 << 16
#: Bytes of the next chunk that a chunk is read with: a value of 64 bits can begin in a chunk's last bit.
HALO = 8


def write(symbols: DataFrame, order: tuple[str, ...] = ("layer", "parent"), symbol: str = "flag", width: str = "width", frame: str = "frame", chunk: int = CHUNK, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(stream, layers) of symbols, each the low bits of its value, width of them (0 to 64), in the frame's order.

    layers: (frame, layer, start, n, bits), where each layer begins in its frame's stream; symbols have a layer, the first of the order. Empty tables give empty ones.
    """
    rows = cut(placed(symbols.select(frame, *order, F.col(symbol).cast("bigint").alias("_value"), F.col(width).cast("int").alias("_width")), order, frame, "_k"))
    layers = rows.groupBy(frame, "layer").agg(F.count(F.lit(1)).alias("n"), F.sum("_width").alias("bits"))
    layers = prefix(layers.withColumn("_at", F.col("layer").cast("bigint")), "bits", "start", frame, "_at").drop("_at")
    pieces = rows.withColumn("_piece", F.floor(F.col("_k") / F.lit(piece))).groupBy(frame, "_piece")
    key = symbols.schema[frame]
    packed = cut(pieces.applyInPandas(_pack, T.StructType([T.StructField(key.name, key.dataType), T.StructField("_piece", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("content", T.BinaryType())])))
    starts = prefix(packed.select(frame, "_piece", "bits"), "bits", "_start", frame, "_piece").select(frame, "_piece", "_start")
    moved = T.StructType([T.StructField(key.name, key.dataType), T.StructField("chunk", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("content", T.BinaryType())])
    parts = packed.join(starts, [frame, "_piece"]).select(frame, "bits", "_start", "content").mapInPandas(lambda batches: _moved(batches, chunk), moved)
    joined = parts.groupBy(frame, "chunk").applyInPandas(_joined, T.StructType([moved[0], moved[1], moved[3]]))
    return joined, layers.select(frame, "layer", "start", "n", "bits")


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_k")
    widths = pdf["_width"].to_numpy(np.int64)
    return pd.DataFrame([(key[0], key[1], int(widths.sum()), R.pack(pdf["_value"].to_numpy(np.int64), widths))], columns=[pdf.columns[0], "_piece", "bits", "content"])


def _moved(batches: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    """Pieces from their own first bit to that of the stream, cut where chunks end."""
    for pdf in batches:
        rows = []
        for frame, bits, start, content in pdf.itertuples(index=False):
            if not bits:
                continue
            spare = np.zeros(start % 8, np.uint8)
            data = np.packbits(np.concatenate([spare, np.unpackbits(np.frombuffer(content, np.uint8))[:bits]])).tobytes()
            first, at = start // 8, 0
            while at < len(data):
                k, within = divmod(first + at, chunk)
                size = min(chunk - within, len(data) - at)
                rows.append((frame, k, within, data[at : at + size]))
                at += size
        yield pd.DataFrame(rows, columns=[pdf.columns[0], "chunk", "at", "content"])


def _joined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The parts of a chunk over each other: a byte that two pieces share has bits of both."""
    out = np.zeros(max(a + len(c) for a, c in zip(pdf["at"], pdf["content"], strict=True)), np.uint8)
    for at, content in zip(pdf["at"], pdf["content"], strict=True):
        out[at : at + len(content)] |= np.frombuffer(content, np.uint8)
    return pd.DataFrame([(key[0], key[1], out.tobytes())], columns=[pdf.columns[0], "chunk", "content"])


def gather(stream: DataFrame, wanted: DataFrame, start: str = "start", width: str = "width", name: str = "value", frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """wanted with name: the width bits (up to 64) of the stream of its frame from the bit start on; beyond its end it is an error.

    Each value is read beside the chunk that it begins in, with the first bytes of the next, so that values in any order are read by as many tasks as there are chunks.
    """
    heads = stream.select(frame, (F.col("chunk") - 1).alias("chunk"), F.substring("content", 1, HALO).alias("_next"))
    whole = stream.join(heads, [frame, "chunk"], "left").select(frame, F.col("chunk").alias("_chunk"), F.concat("content", F.coalesce("_next", F.lit(b""))).alias("_content"))
    rows = wanted.toDF(*wanted.columns).withColumn("_chunk", F.floor(F.col(start) / F.lit(8 * chunk)))
    fields = [*wanted.schema.fields, T.StructField(name, T.LongType())]

    def read(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return asked.drop(columns="_chunk").assign(**{name: np.zeros(0, np.int64)})
        data = np.frombuffer(held["_content"].iloc[0] if len(held) else b"", np.uint8)
        widths = asked[width].to_numpy(np.int64)
        at = asked[start].to_numpy(np.int64) - int(asked["_chunk"].iloc[0]) * 8 * chunk
        if (widths > 0).any() and (at + widths).max() > 8 * len(data):
            raise EOFError(f"{(at + widths).max()} bits of {8 * len(data)} in a chunk")
        return asked.drop(columns="_chunk").assign(**{name: bits_at(data, at, widths)})

    return rows.groupBy(frame, "_chunk").cogroup(whole.groupBy(frame, "_chunk")).applyInPandas(read, T.StructType(fields))


def bits_at(data: np.ndarray, at: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The bits of bytes from given places on, as numbers."""
    data = np.concatenate([data, np.zeros(9, np.uint8)])
    first = at >> 3
    high = np.zeros(len(at), np.uint64)
    for k in range(8):
        high = high << np.uint64(8) | data[np.minimum(first + k, len(data) - 1)].astype(np.uint64)
    shift = (at & 7).astype(np.uint64)
    last = data[np.minimum(first + 8, len(data) - 1)].astype(np.uint64)
    both = high << shift | last >> (np.uint64(8) - shift)
    out = np.where(widths > 0, both >> np.clip(64 - widths, 0, 63).astype(np.uint64), np.uint64(0))
    return out.astype(np.int64)


def whole(stream: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, stream): each frame's chunks as one value, for frames that fit one."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "content")))
    return stream.groupBy(frame).agg(parts.alias("_p")).select(frame, F.aggregate(F.col("_p.content"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("stream"))


def sizes(layers: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, n, bits) of write()'s layers."""
    return layers.groupBy(frame).agg(F.sum("n").alias("n"), F.sum("bits").alias("bits"))


def read_tree(stream: DataFrame, dims: list[int], width: int, frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """(frame, layer, parent, flag) of a stream of occupancy flags by layer and parent, dimensions of 1 to 6.

    Layer by layer: a layer's flags stand one after the other behind the layer above, so a node's place gives its bit; its children's places are a prefix sum of set bits.
    """
    from octarine.operators.ntree import plan_dims

    one, out = F.lit(1).cast("bigint"), None
    nodes = stream.select(frame).distinct().select(frame, F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("_layer_start"))
    plan = plan_dims(dims, width)
    if min(plan) <= 0:
        raise ValueError("a counter's width follows from the counts above: read such streams by frame")
    for layer, d in enumerate(plan):
        size = 1 << d
        asked = nodes.withColumns({"start": F.col("_layer_start") + F.col("k") * size, "width": F.lit(size)})
        got = cut(gather(stream, asked, name="flag", frame=frame, chunk=chunk))
        rows = got.select(frame, F.lit(layer).alias("layer"), "parent", "flag")
        out = rows if out is None else out.unionByName(rows)
        if layer + 1 == len(plan) or got.isEmpty():
            return out
        ends = got.groupBy(frame).agg((F.max("_layer_start") + F.count(F.lit(1)) * size).alias("_end"))
        counted = prefix(got.withColumn("_kids", F.bit_count("flag").cast("bigint")), "_kids", "_first", frame)
        at = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.call_function("shiftrightunsigned", F.col("flag"), c).bitwiseAND(one) == 1)
        kids = counted.select(frame, "_first", "parent", F.posexplode(at).alias("_j", "_c"))
        nodes = kids.join(ends, frame).select(frame, (F.col("_first") + F.col("_j")).alias("k"), (F.shiftleft("parent", d) + F.col("_c")).alias("parent"), F.col("_end").alias("_layer_start"))
