"""Probabilities of symbols, the bits they cost, and streams of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from octarine.functions import ranges as R
from octarine.functions.lineage import cut, placed

#: Symbols that one task range codes as one stream.
BLOCK = 1 << 16


def frequencies(symbols: DataFrame, by: Sequence[str], symbol: str = "flag") -> DataFrame:
    """(by, symbol, n, total): how often each symbol occurs in its context. The window is over counts, not over symbols."""
    counts = symbols.groupBy(*by, symbol).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(W.partitionBy(*by)))


def entropy(symbols: DataFrame, by: Sequence[str], symbol: str = "flag") -> DataFrame:
    """(by, n, bits, bits_per_symbol): the least that a coder with these contexts can take."""
    cost = -F.col("n") * F.log2(F.col("n") / F.col("total"))
    got = frequencies(symbols, by, symbol).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(cost).alias("bits"))
    return got.withColumn("bits_per_symbol", F.col("bits") / F.col("n"))


def cdf(symbols: DataFrame, by: Sequence[str], symbol: str = "flag", precision: int = 16) -> DataFrame:
    """(by, symbol, low, high): cumulative probabilities scaled to 2^precision - 1 and cut to whole numbers."""
    w = W.partitionBy(*by).orderBy(symbol)
    run = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))
    scaled = lambda c: F.floor(c / F.col("total") * F.lit(float((1 << precision) - 1)))
    return frequencies(symbols, by, symbol).withColumn("_run", run).select(*by, symbol, scaled(F.col("_run") - F.col("n")).alias("low"), scaled(F.col("_run")).alias("high"))


def adaptive_cost(symbols: DataFrame, size: int, by: Sequence[str], order: str, symbol: str) -> DataFrame:
    """symbols with cost: bits under counts that start at one for each of size symbols and follow the order."""
    before = W.partitionBy(*by, symbol).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    seen, all_ = F.count(F.lit(1)).over(before), F.count(F.lit(1)).over(so_far)
    return symbols.withColumn("cost", -F.log2((seen + 1) / (all_ + F.lit(size))))


def narrowed(symbols: DataFrame) -> DataFrame:
    """symbols (layer, dim, flag) with alphabet: how many symbols a node of the dimension can have, and fits."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("shiftleft", F.lit(1), F.col("dim")))
    return symbols.withColumns({"alphabet": size, "fits": (F.col("flag") > 0) & (F.col("flag") < size)})


def streams(symbols: DataFrame, frame: str = "frame", symbol: str = "flag", width: str = "width", order: Sequence[str] = ("layer", "parent")) -> DataFrame:
    """(frame, n, bits, stream): the symbols of a frame in their order, each in so many bits. One task writes one frame."""
    schema = T.StructType([symbols.schema[frame], T.StructField("n", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("stream", T.BinaryType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        widths = pdf[width].to_numpy(np.int64)
        return pd.DataFrame({frame: [key[0]], "n": [len(pdf)], "bits": [int(widths.sum())], "stream": [R.pack(pdf[symbol].to_numpy(np.int64), widths)]})

    return symbols.select(frame, symbol, width, *order).groupBy(frame).applyInPandas(run, schema)


def read_streams(written: DataFrame, dims: Sequence[int], width: int, frame: str = "frame") -> DataFrame:
    """(frame, layer, parent, flag) from streams of occupancy symbols: each layer has as many as the one above has set bits."""
    from octarine.operators.ntree import plan_dims

    plan = plan_dims(dims, width)
    schema = T.StructType([written.schema[frame], T.StructField("layer", T.IntegerType()), T.StructField("parent", T.LongType()), T.StructField("flag", T.LongType())])

    def run(batches):
        for pdf in batches:
            rows = []
            for key, data in zip(pdf[frame], pdf["stream"], strict=True):
                source, nodes = R.Bits(bytes(data)), np.zeros(1, np.int64)
                for layer, d in enumerate(plan):
                    step = max(d, 1)
                    flags = source.many(np.full(len(nodes), 1 << step))
                    rows.append(pd.DataFrame({frame: [key] * len(nodes), "layer": np.full(len(nodes), layer, np.int32), "parent": nodes, "flag": flags}))
                    at, child = np.nonzero(flags[:, None] >> np.arange(1 << step) & 1)
                    nodes = nodes[at] << step | child
            yield pd.concat(rows)

    return written.select(frame, "stream").mapInPandas(run, schema)


def range_coded(symbols: DataFrame, size: int | None = None, frame: str = "frame", symbol: str = "symbol", order: str = "point_id", block: int = BLOCK) -> DataFrame:
    """(frame, block, n, symbols, counts, stream): each frame's symbols in blocks, range coded by the block's own counts.

    Any whole numbers can be symbols: a block lists those that it has, in ascending order, with their counts. size: symbols are to be from 0, and below that. A
    block is what one task codes, so frames can be of any size; those of up to so many rows are one stream.
    """
    schema = T.StructType([symbols.schema[frame], *[T.StructField(c, T.LongType()) for c in ("block", "n")], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("symbols", "counts")], T.StructField("stream", T.BinaryType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, at, counts = np.unique(pdf.sort_values("_k")["_s"].to_numpy(np.int64), return_inverse=True, return_counts=True)
        if size is not None and (own[0] < 0 or own[-1] >= size):
            raise ValueError(f"symbols are to be from 0, and below {size}")
        sums = [0, *np.cumsum(counts).tolist()]
        return pd.DataFrame({frame: [key[0]], "block": [key[1]], "n": [len(at)], "symbols": [own.tolist()], "counts": [counts.tolist()], "stream": [R.encode(at.tolist(), sums)]})

    rows = placed(symbols.select(frame, F.col(symbol).alias("_s"), F.col(order).alias("_o")), ["_o"], frame, "_k")
    return rows.select(frame, F.floor(F.col("_k") / F.lit(block)).alias("block"), "_k", "_s").groupBy(frame, "block").applyInPandas(run, schema)


def range_decoded(coded: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, k, symbol): what range_coded() wrote, k from 0."""
    schema = T.StructType([coded.schema[frame], T.StructField("k", T.LongType()), T.StructField("symbol", T.LongType())])

    def run(batches):
        for pdf in batches:
            for key, first, n, own, counts, data in zip(*[pdf[c] for c in (frame, "_first", "n", "symbols", "counts", "stream")], strict=True):
                at = np.fromiter(R.decode(bytes(data), [0, *np.cumsum(counts).tolist()], int(n)), np.int64, int(n))
                yield pd.DataFrame({frame: [key] * len(at), "k": int(first) + np.arange(len(at)), "symbol": np.asarray(own)[at]})

    first = F.coalesce(F.sum("n").over(W.partitionBy(frame).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    # a row is a stream, and some bytes stand for a block of symbols: rows are dealt anew, or all of a frame's would be decoded by one task
    dealt = coded.select(frame, "block", "n", "symbols", "counts", "stream").withColumn("_first", first).repartition(F.col(frame), F.col("block"))
    return dealt.mapInPandas(run, schema)


def bit_entropy(codes: DataFrame, width: int, rounds: int, frame: str = "frame", key: str = "code", cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(frame, key, e): for each code the skew of each bit in the node where it was chosen, as an array by bit, over the frame's size.

    In each round a node's codes, as bits of +1 and -1, are summed; a code takes the sum of its node's most skewed unused
    bit (ties: the lowest), and goes to the child that its bit says. Bits never chosen have null.
    """
    if rounds > 62:
        raise ValueError("a node's path of more than 62 bits does not fit a long")
    one = F.lit(1).cast("bigint")
    at = lambda v, k: F.call_function("shiftrightunsigned", v, k).bitwiseAND(one)
    now = codes.select(frame, key, one.alias("node"), F.lit(0).cast("bigint").alias("used"), F.array_repeat(F.lit(None).cast("bigint"), width).alias("e"))
    n = codes.groupBy(frame).agg(F.count(F.lit(1)).alias("_total"))
    for _ in range(min(rounds, width)):  # nothing in a round depends on its number, so that its code is compiled once
        free = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: at(F.col("used"), k) == 0)
        sums = now.select(frame, "node", key, F.explode(free).alias("bit")).groupBy(frame, "node", "bit").agg(F.sum(2 * at(F.col(key), F.col("bit")) - 1).alias("s"))
        best = F.max(F.struct(F.abs("s").alias("w"), (-F.col("bit")).alias("b"), "s"))
        chosen = sums.groupBy(frame, "node").agg(best.alias("_b")).select(frame, "node", (-F.col("_b.b")).alias("bit"), F.col("_b.s").alias("s"))
        met = now.join(cut(chosen), [frame, "node"])
        told = F.transform("e", lambda x, k: F.when(k == F.col("bit"), F.col("s")).otherwise(x))
        now = cut(met.select(frame, key, (F.col("node") * 2 + at(F.col(key), F.col("bit"))).alias("node"), F.col("used").bitwiseOR(F.call_function("shiftleft", one, F.col("bit"))).alias("used"), told.alias("e")))
    return now.join(n, frame).select(frame, key, F.transform("e", lambda x: x / F.col("_total")).alias("e"))


def by_skew(mapped: DataFrame, width: int, key: str = "code") -> DataFrame:
    """bit_entropy() rows with p and sorted_code: each code's own permutation, bits of the larger absolute e to the higher places.

    Bits never chosen come first, in their order; ties keep the lower bit lower. B.permute_by() with p brings the code back.
    """
    weight = F.array(*[F.struct(F.coalesce(F.abs(F.get("e", F.lit(k))), F.lit(-1.0)).alias("w"), F.lit(k).alias("b")) for k in range(width)])
    p = F.transform(F.sort_array(weight), lambda x: x["b"])
    held = mapped.withColumn("p", p)
    new = [F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col(key), F.get("p", F.lit(j)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")), F.lit(j)) for j in range(width)]
    out = new[0]
    for c in new[1:]:
        out = out + c
    return held.withColumn("sorted_code", out)


def coded_by(symbols: DataFrame, frame: str = "frame", symbol: str = "symbol", weights: str = "weights", order: str = "point_id", floor: float = 1e-6) -> DataFrame:
    """(frame, n, stream): each frame's symbols, range coded by the weights that a model gave for each place: symbol k by weights[k - 1], as 0 can't be.

    Weights are taken over their largest, none below floor. The frame is one task's, as one scan is.
    """
    schema = T.StructType([symbols.schema[frame], T.StructField("n", T.LongType()), T.StructField("stream", T.BinaryType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = R.RangeEncoder()
        for s, w in zip(*[pdf.sort_values(order)[c] for c in (symbol, weights)], strict=True):
            sums = _sums(w, floor)
            out.encode(sums[s - 1], sums[s], sums[-1])
        return pd.DataFrame({frame: [key[0]], "n": [len(pdf)], "stream": [out.finish()]})

    return symbols.select(frame, order, symbol, weights).groupBy(frame).applyInPandas(run, schema)


def _sums(weights: Sequence[float], floor: float) -> list[int]:
    top = max(weights) or 1.0
    sums = R.cdf([w / top for w in weights], floor=floor)
    return [s + k for k, s in enumerate(sums)]  # each symbol keeps a range of its own


def decoded_by(coded: DataFrame, models: DataFrame, frame: str = "frame", weights: str = "weights", order: str = "point_id", floor: float = 1e-6) -> DataFrame:
    """(frame, order, symbol) from coded_by(), by the same weights (frame, order, weights)."""
    schema = T.StructType([models.schema[frame], models.schema[order], T.StructField("symbol", T.LongType())])

    def run(key: tuple, streams_: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        source = R.RangeDecoder(bytes(streams_["stream"].iloc[0])) if len(streams_) else None
        found = [source.decode(_sums(w, floor)) + 1 for w in pdf[weights]] if source else []
        return pd.DataFrame({frame: pdf[frame][: len(found)], order: pdf[order][: len(found)], "symbol": found})

    return coded.groupBy(frame).cogroup(models.select(frame, order, weights).groupBy(frame)).applyInPandas(run, schema)
