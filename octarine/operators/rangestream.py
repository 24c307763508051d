"""Range coding in chunks that many tasks write and read, each by many states at once.

A frame's symbols, over all layers, are cut into chunks; a chunk has several coder states, symbol k being the one of state k modulo their number, whose words are interleaved in
one stream. Array operations move all states a step. What a symbol costs follows from a range of 0 to 65,535 that its model gives it, which
may be another for each symbol. The number of states is such that they take a two-hundredth of the stream at most.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from octarine.functions.lineage import placed
from octarine.operators.entropy import frequencies

#: Bits of a model's ranges, symbols of a chunk, and the part of a stream that states may take.
BITS, CHUNK, SHARE = 16, 1 << 17, 1 / 200
LEAST = 1 << 31


def encode(low: np.ndarray, size: np.ndarray) -> bytes:
    """The symbols whose ranges begin at low and have so many places: a header, the last states, and the words that were put out."""
    n = len(low)
    bits = float(np.sum(BITS - np.log2(size))) if n else 0.0
    lanes = max(1, min(n, int(bits * SHARE / 64)))
    low, size = low.astype(np.uint64), size.astype(np.uint64)
    state, words = np.full(lanes, LEAST, np.uint64), []
    for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        f = size[at : at + lanes]
        own = state[: len(f)]
        full = own >= f << np.uint64(31 + 32 - BITS)
        if full.any():
            words.append(own[full][::-1].astype(np.uint32))
            own[full] >>= np.uint64(32)
        own[:] = (own // f << np.uint64(BITS)) + own % f + low[at : at + lanes]
    out = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    return struct.pack("<II", n, lanes) + state.astype("<u8").tobytes() + out.astype("<u4").tobytes()


def decode(data: bytes, find) -> np.ndarray:
    """The symbols; find(from, places) gives symbol, low and size of the ranges that hold these places, for the symbols numbered from `from` on."""
    n, lanes = struct.unpack_from("<II", data)
    state = np.frombuffer(data, "<u8", lanes, 8).astype(np.uint64)
    words, at_word = np.frombuffer(data, "<u4", -1, 8 + 8 * lanes).astype(np.uint64), 0
    out = np.zeros(n, np.int64)
    for at in range(0, n, lanes):
        own = state[: n - at]
        place = own & np.uint64((1 << BITS) - 1)
        symbol, low, size = find(at, place.astype(np.int64))
        out[at : at + lanes] = symbol
        own[:] = size.astype(np.uint64) * (own >> np.uint64(BITS)) + place - low.astype(np.uint64)
        few = own < LEAST
        k = int(few.sum())
        if k:
            own[few] = own[few] << np.uint64(32) | words[at_word : at_word + k]
            at_word += k
    return out


def tables(symbols: DataFrame, by: Sequence[str] = ("frame", "layer"), symbol: str = "flag") -> DataFrame:
    """(by, symbol, low, size): ranges in proportion to how often each symbol occurs in its context, none empty; the most frequent one takes what rounding leaves.

    A context can have up to 32,768 different symbols.
    """
    w = W.partitionBy(*by)
    got = frequencies(symbols, by, symbol).withColumn("_kinds", F.count(F.lit(1)).over(w))
    got = got.withColumn("_kinds", F.when(F.col("_kinds") > 1 << (BITS - 1), F.raise_error(F.lit("too many different symbols in a context")).cast("bigint")).otherwise(F.col("_kinds")))
    share = F.floor(F.col("n") * (F.lit(1 << BITS) - F.col("_kinds")) / F.col("total")) + 1
    got = got.withColumn("size", share).withColumn("_left", F.lit(1 << BITS) - F.sum("size").over(w)).withColumn("_first", F.row_number().over(w.orderBy(F.desc("n"), symbol)) == 1)
    got = got.withColumn("size", F.col("size") + F.when(F.col("_first"), F.col("_left")).otherwise(0))
    low = F.sum("size").over(w.orderBy(symbol).rowsBetween(W.unboundedPreceding, -1))
    return got.select(*by, symbol, F.coalesce(low, F.lit(0)).cast("int").alias("low"), F.col("size").cast("int").alias("size"))


def ends(weights: Sequence[Sequence[float]], floor: float = 1e-6) -> np.ndarray:
    """The ends of the ranges that each row of weights gives symbols 0, 1, ...: in proportion to each, which counts as floor of the row's largest at least, none empty. Shorter rows are filled up with 0."""
    most = max(map(len, weights))
    w = np.zeros((len(weights), most))
    for k, row in enumerate(weights):
        w[k, : len(row)] = row
    w = np.nan_to_num(w, nan=0.0, posinf=0.0, neginf=0.0)
    top = w.max(1, keepdims=True)
    sums = np.cumsum(np.maximum(np.divide(w, top, out=np.ones_like(w), where=top > 0), floor), 1)
    inner = np.floor(sums / sums[:, -1:] * ((1 << BITS) - most)).astype(np.int64) + np.arange(1, most + 1)
    return np.concatenate([np.zeros((len(w), 1), np.int64), inner], 1)


def write(symbols: DataFrame, order: Sequence[str] = ("layer", "parent"), low: str = "low", size: str = "size", frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """(frame, chunk, n, bits, stream) of symbols with their ranges, in the frame's order."""
    key = symbols.schema[frame]
    rows = placed(symbols.select(frame, *order, F.col(low).alias("_low"), F.col(size).alias("_size")), order, frame, "_k").withColumn("chunk", F.floor(F.col("_k") / F.lit(chunk)))
    schema = T.StructType([T.StructField(key.name, key.dataType), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("stream", T.BinaryType())])

    def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        data = encode(pdf["_low"].to_numpy(), pdf["_size"].to_numpy())
        return pd.DataFrame([(key_[0], key_[1], len(pdf), 8 * len(data), data)], columns=schema.names)

    return rows.select(frame, "chunk", "_k", "_low", "_size").groupBy(frame, "chunk").applyInPandas(run, schema)


def read(coded: DataFrame, models: DataFrame, layers: DataFrame, symbol: str = "flag", frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """(frame, k, layer, symbol) of write()'s streams of symbols with tables() by frame and layer; layers: (frame, layer, n), how many symbols each layer has.

    A chunk can begin in one layer and end in another. The tables of a frame go to each of its chunks.
    """
    key = coded.schema[frame]
    known = models.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct("layer", "low", "size", F.col(symbol).cast("bigint").alias("symbol")))).alias("_model"))
    sizes = layers.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct("layer", "n"))).alias("_layers"))
    met = coded.select(frame, "chunk", "stream").join(known, frame).join(sizes, frame)
    schema = T.StructType([T.StructField(key.name, key.dataType), T.StructField("k", T.LongType()), T.StructField("layer", T.IntegerType()), T.StructField(symbol, T.LongType())])
    met = met.select(frame, "chunk", "stream", *[F.col(f"_model.{c}").alias(c) for c in ("layer", "low", "size", "symbol")], F.col("_layers.layer").alias("_of"), F.col("_layers.n").alias("_n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part, data, layer, low, size, values, of, n in pdf.itertuples(index=False):
                layer, low, size, values = (np.asarray(x, np.int64) for x in (layer, low, size, values))
                keys, stops = layer << BITS | low, np.cumsum(np.asarray(n, np.int64))
                first, count = part * chunk, struct.unpack_from("<I", data)[0]
                context = np.asarray(of, np.int64)[np.searchsorted(stops, np.arange(first, first + count), side="right")]

                def find(at: int, places: np.ndarray, context=context, keys=keys, values=values, low=low, size=size):
                    j = np.searchsorted(keys, context[at : at + len(places)] << BITS | places, side="right") - 1
                    return values[j], low[j], size[j]

                yield pd.DataFrame({frame: [name] * count, "k": np.arange(first, first + count), "layer": context.astype(np.int32), symbol: decode(data, find)}, columns=schema.names)

    return met.mapInPandas(run, schema)


def write_by(symbols: DataFrame, order: Sequence[str] = ("layer", "parent"), symbol: str = "flag", weights: str = "weights", first: int = 1, floor: float = 1e-6, frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """As write(), by the weights that a model gave at each place for the symbols from first on (flags begin with 1, as 0 can't be); a symbol without a weight is an error."""
    key = symbols.schema[frame]
    rows = placed(symbols.select(frame, *order, F.col(symbol).alias("_s"), F.col(weights).alias("_w")), order, frame, "_k").withColumn("chunk", F.floor(F.col("_k") / F.lit(chunk)))
    schema = T.StructType([T.StructField(key.name, key.dataType), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("stream", T.BinaryType())])

    def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        j, lengths = pdf["_s"].to_numpy(np.int64) - first, pdf["_w"].map(len).to_numpy(np.int64)
        if ((j < 0) | (j >= lengths)).any():
            raise ValueError("a symbol has no weight")
        stops, k = ends(pdf["_w"].tolist(), floor), np.arange(len(pdf))
        data = encode(stops[k, j], stops[k, j + 1] - stops[k, j])
        return pd.DataFrame([(key_[0], key_[1], len(pdf), 8 * len(data), data)], columns=schema.names)

    return rows.select(frame, "chunk", "_k", "_s", "_w").groupBy(frame, "chunk").applyInPandas(run, schema)


def read_by(coded: DataFrame, models: DataFrame, order: Sequence[str] = ("layer", "parent"), symbol: str = "flag", weights: str = "weights", first: int = 1, floor: float = 1e-6, frame: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """(frame, order, symbol) of write_by()'s streams, by the same weights (frame, order, weights) over all layers; each chunk meets the models of its own symbols."""
    rows = placed(models.select(frame, *order, F.col(weights).alias("_w")), order, frame, "_k").withColumn("chunk", F.floor(F.col("_k") / F.lit(chunk)))
    schema = T.StructType([*[models.schema[c] for c in (frame, *order)], T.StructField(symbol, T.LongType())])

    def run(key: tuple, held: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_k")
        if not len(held) or struct.unpack_from("<I", held["stream"].iloc[0])[0] != len(own):
            raise ValueError(f"chunk {key} has {len(own)} models, and not as many symbols")
        stops = ends(own["_w"].tolist(), floor)

        def find(at: int, places: np.ndarray):
            rows_ = stops[at : at + len(places)]
            j = (rows_[:, 1:] <= places[:, None]).sum(1)
            k = np.arange(len(places))
            return j + first, rows_[k, j], rows_[k, j + 1] - rows_[k, j]

        return own[[frame, *order]].assign(**{symbol: decode(held["stream"].iloc[0], find)})

    return coded.select(frame, "chunk", "stream").groupBy(frame, "chunk").cogroup(rows.groupBy(frame, "chunk")).applyInPandas(run, schema)
