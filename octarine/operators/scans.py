"""Recurrences over a frame's order in blocks of it, so that a frame can be longer than one task should hold.

Places come from a range sort of the whole table; a block is what one task goes through, and what a block hands to the next is a small row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octarine.functions.lineage import cut, placed

#: Rows of a block, and those whose counts are held at once.
BLOCK, STEPS = 1 << 16, 1 << 10


def _named(frame: T.StructField, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(frame.name, frame.dataType), *[T.StructField(*f) for f in fields]])


def _blocked(points: DataFrame, order: str, frame: str, block: int) -> DataFrame:
    """points with _k, their places, and _block; written, as they are read by each pass."""
    return cut(placed(points, [order], frame, "_k").withColumn("_block", F.floor(F.col("_k") / F.lit(block))))


def decayed(points: DataFrame, values: Sequence[str], keep: float, gain: float, frame: str = "frame", order: str = "point_id", start: float | None = None, block: int = BLOCK) -> DataFrame:
    """points with before_<value>: the state before the own value, where each value turns the state s into keep * s + gain * value.

    The first state is start, or the first value itself if that is None; nulls and NaN pass through the arithmetic as NaN. A block's effect on the state is an affine map, keep to the power of its rows and a sum; the maps of a frame's blocks are applied
    one after the other, a row for each, which gives each block the state that it begins with.
    """
    rows, key, names, own = _blocked(points, order, frame, block), points.schema[frame], list(values), points.columns

    def maps(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_k")[names].to_numpy(float)
        weights = gain * keep ** np.arange(len(x) - 1, -1, -1.0)
        return pd.DataFrame([(k[0], k[1], len(x), x[0].tolist(), (weights @ x).tolist())], columns=[frame, "_block", "n", "first", "sums"])

    def starts(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("_block"), []
        state = np.array(pdf["first"].iloc[0], float) if start is None else np.full(len(names), start)
        for n, sums in zip(pdf["n"], pdf["sums"], strict=True):
            out.append(state.tolist())
            state = keep**n * state + np.array(sums, float)
        return pd.DataFrame({frame: [k[0]] * len(out), "_block": pdf["_block"], "_state": out})

    doubles = T.ArrayType(T.DoubleType())
    small = rows.select(frame, "_block", "_k", *names).groupBy(frame, "_block").applyInPandas(maps, _named(key, ("_block", T.LongType()), ("n", T.LongType()), ("first", doubles), ("sums", doubles)))
    begun = small.groupBy(frame).applyInPandas(starts, _named(key, ("_block", T.LongType()), ("_state", doubles)))
    fields = [*points.schema.fields, *[T.StructField(f"before_{v}", T.DoubleType()) for v in names]]

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        x, out = pdf[names].to_numpy(float), np.empty((len(pdf), len(names)))
        state = np.array(pdf["_state"].iloc[0], float)
        for i, v in enumerate(x):
            out[i] = state
            state = keep * state + gain * v
        return pdf[own].assign(**{f"before_{v}": out[:, j] for j, v in enumerate(names)})

    return rows.join(begun, [frame, "_block"]).groupBy(frame, "_block").applyInPandas(run, T.StructType(fields))


def fading_cost(symbols: DataFrame, size: int, gate: float, frame: str = "frame", order: str = "point_id", symbol: str = "symbol", block: int = BLOCK, others: bool = False) -> DataFrame:
    """symbols (0 to size - 1) with cost: bits under counts that start at one; before a symbol's own count grows by one, all shrink by gate.

    others: whether there may be symbols of size and above. They are in no count, so their cost is null, and counts only shrink by them. The counts that a block begins with are a row of size numbers for it, by the same scan as decayed().
    All is in logarithms: what is not seen for long fades below the least number of a double (at a gate of 0.98 after 37,000 symbols), but has a cost.
    """
    rows, key, columns = _blocked(symbols, order, frame, block), symbols.schema[frame], symbols.columns
    fade = math.log2(gate)

    def maps(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("_k")[symbol].to_numpy(np.int64)
        if len(s) and (s.min() < 0 or (s.max() >= size and not others)):
            raise ValueError(f"symbols are to be from 0, and below {size}")
        at = np.flatnonzero(s < size)
        last = np.zeros(size, np.int64)
        np.maximum.at(last, s[at], at)
        sums = np.bincount(s[at], gate ** (last[s[at]] - at).astype(float), size)
        with np.errstate(divide="ignore"):
            sums = np.log2(sums) + (len(s) - 1 - last) * fade
        return pd.DataFrame([(k[0], k[1], len(s), sums.tolist())], columns=[frame, "_block", "n", "sums"])

    def starts(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("_block"), np.zeros(size), []
        for n, sums in zip(pdf["n"], pdf["sums"], strict=True):
            out.append(state.tolist())
            state = np.logaddexp2(n * fade + state, np.array(sums, float))
        return pd.DataFrame({frame: [k[0]] * len(out), "_block": pdf["_block"], "_state": out})

    doubles = T.ArrayType(T.DoubleType())
    small = rows.select(frame, "_block", "_k", symbol).groupBy(frame, "_block").applyInPandas(maps, _named(key, ("_block", T.LongType()), ("n", T.LongType()), ("sums", doubles)))
    begun = small.groupBy(frame).applyInPandas(starts, _named(key, ("_block", T.LongType()), ("_state", doubles)))

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        count, since = np.array(pdf["_state"].iloc[0], float).tolist(), [0] * size
        total, out = sum(2.0**c for c in count), []
        for t, s in enumerate(pdf[symbol].tolist()):
            if s >= size:
                out.append(None)
                total *= gate
                continue
            own = count[s] + (t - since[s]) * fade
            out.append(math.log2(total) - own)
            count[s], since[s], total = math.log2(2.0**own * gate + 1), t + 1, total * gate + 1
        return pdf[columns].assign(cost=pd.Series(out, pdf.index, object))

    return rows.join(begun, [frame, "_block"]).groupBy(frame, "_block").applyInPandas(run, T.StructType([*symbols.schema.fields, T.StructField("cost", T.DoubleType())]))


def stepped_cost(symbols: DataFrame, size: int, gate: float, frame: str = "frame", order: str = "point_id", symbol: str = "symbol", block: int = BLOCK) -> DataFrame:
    """fading_cost() with others, as numbers of double precision that are rounded at each step have it, to the last bit.

    What is not seen for long stops fading at some least doubles (25 of them at a gate of 0.98), or is zero; its cost is then that of this count, and infinite where its part of all counts is zero.
    A step never puts a larger count below a smaller one. So where the least and the largest count that a block can begin with become the same number within it, that is what any count becomes; only the others, such as symbols
    that a block doesn't have, are gone through from block to block, by their places.
    """
    rows, key, columns = _blocked(symbols, order, frame, block), symbols.schema[frame], symbols.columns
    most = 2 / (1 - gate) + 1 if gate < 1 else math.inf

    def faded(counts: np.ndarray, n: int) -> np.ndarray:
        for k in range(n):
            now = counts * gate
            if k % 64 == 0 and np.array_equal(now, counts):
                break
            counts = now
        return counts

    def maps(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("_k")[symbol].to_numpy(np.int64)
        if len(s) and s.min() < 0:
            raise ValueError("symbols are to be from 0")
        both = np.repeat([[0.0], [most]], size, axis=1)
        for v in s.tolist():
            np.multiply(both, gate, out=both)
            if v < size:
                both[:, v] += 1
        ends = np.where(both[0] == both[1], both[0], np.nan)
        at = np.flatnonzero(np.isnan(ends)[np.minimum(s, size - 1)] & (s < size))
        return pd.DataFrame([(k[0], k[1], len(s), ends.tolist(), at.astype("<i8").tobytes(), s[at].astype("<i8").tobytes())], columns=[frame, "_block", "n", "ends", "at", "seen"])

    def starts(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("_block"), np.ones(size), []
        for r in pdf.itertuples(index=False):
            out.append(state.tolist())
            ends = np.array(r.ends, float)
            open_ = np.flatnonzero(np.isnan(ends))
            counts, before = state[open_], 0
            for at, seen in zip(np.frombuffer(r.at, "<i8").tolist(), np.searchsorted(open_, np.frombuffer(r.seen, "<i8")).tolist(), strict=True):
                counts, before = faded(counts, at + 1 - before) + 0.0, at + 1
                counts[seen] += 1
            ends[open_] = faded(counts, r.n - before)
            state = ends
        return pd.DataFrame({frame: [k[0]] * len(out), "_block": pdf["_block"], "_state": out})

    doubles = T.ArrayType(T.DoubleType())
    fields = [("_block", T.LongType()), ("n", T.LongType()), ("ends", doubles), ("at", T.BinaryType()), ("seen", T.BinaryType())]
    small = rows.select(frame, "_block", "_k", symbol).groupBy(frame, "_block").applyInPandas(maps, _named(key, *fields))
    begun = small.groupBy(frame).applyInPandas(starts, _named(key, ("_block", T.LongType()), ("_state", doubles)))

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("_k"), []
        state, every = np.array(pdf["_state"].iloc[0], float), pdf[symbol].to_numpy(np.int64)
        for at in range(0, len(every), STEPS):
            s = every[at : at + STEPS]
            counts = np.empty((len(s) + 1, size))
            counts[0] = state
            for t, v in enumerate(s.tolist()):
                np.multiply(counts[t], gate, out=counts[t + 1])
                if v < size:
                    counts[t + 1, v] += 1
            state, counts = counts[-1], counts[:-1]
            total = np.zeros(len(s))
            for c in counts.T:  # one after the other, as a sum over a list is
                total += c
            part = counts[np.arange(len(s)), np.minimum(s, size - 1)] / total
            out += [None if v >= size else -math.log2(p) if p else math.inf for v, p in zip(s.tolist(), part.tolist(), strict=True)]
        return pdf[columns].assign(cost=pd.Series(out, pdf.index, object))

    return rows.join(begun, [frame, "_block"]).groupBy(frame, "_block").applyInPandas(run, T.StructType([*symbols.schema.fields, T.StructField("cost", T.DoubleType())]))


def around(points: DataFrame, value: str, k: int, by: Sequence[str] = ("frame",), order: str = "point_id", name: str = "around") -> DataFrame:
    """points with name: the values from k/2 places before to k/2 after, without the own, in a circle over the rows of by.

    Each row sends its value to the places around it, so an exchange by place brings them together; nothing is a window over a frame. In
    a circle of few rows a row can be its own neighbour, and another's on both sides.
    """
    steps = [s for s in range(-(k // 2), k // 2 + 1) if s]
    keyed = points.withColumn("_of", F.struct(*by))
    rows = cut(placed(keyed, [order], "_of", "_k"))
    sizes = rows.groupBy("_of").agg(F.count(F.lit(1)).alias("_n"))
    sent = rows.select("_of", "_k", F.col(value).alias("_v")).join(sizes, "_of").select("_of", "_v", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.pmod(F.col("_k") - s, F.col("_n")).alias("k")) for j, s in enumerate(steps)])).alias("_t"))
    met = sent.groupBy("_of", F.col("_t.k").alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col("_t.j").alias("j"), F.col("_v").alias("v")))).alias("_a"))
    return rows.join(met, ["_of", "_k"]).withColumn(name, F.transform("_a", lambda x: x["v"])).select(*[c for c in points.columns if c != name], name)


def simplify(points: DataFrame, tolerance: float, max_rounds: int = 200, axes: Sequence[str] = ("x", "y", "z"), frame: str = "frame", order: str = "point_id") -> DataFrame:
    """points with corner: a polyline that stays within the tolerance; each round adds the farthest point (ties: the first) of every segment that doesn't.

    A round is one join of the points that are still within an open segment with its ends, and one aggregation by segment, for all segments of
    all frames at once. The first and the last point of a frame always are corners.
    """
    rows = cut(placed(points, [order], frame, "_k"))
    at = lambda p: F.struct(*[F.col(a).cast("double").alias(a) for a in axes]).alias(p)
    inner = rows.select(frame, F.col("_k").alias("k"), at("p"))
    ends = rows.groupBy(frame).agg(F.max("_k").alias("_last"))
    edge = inner.join(ends, frame).where("k = 0 or k = _last")
    corners = edge.select(frame, "k")
    first = edge.where("k = 0").select(frame, F.col("p").alias("pa"))
    segments = edge.where("k = _last and _last > 1").join(first, frame).select(frame, F.lit(0).cast("bigint").alias("a"), F.col("k").alias("b"), "pa", F.col("p").alias("pb"))
    segments = cut(segments)
    now = inner.join(segments.select(frame, "a", "b"), frame).where("k > 0 and k < b").select(frame, "a", "k", "p")
    total = lambda parts: sum(parts[1:], parts[0])
    for _ in range(max_rounds):
        way = {c: F.col(f"pb.{c}") - F.col(f"pa.{c}") for c in axes}
        off = {c: F.col(f"p.{c}") - F.col(f"pa.{c}") for c in axes}
        met = now.join(segments, [frame, "a"]).withColumns({"_n": total([way[c] * way[c] for c in axes]), "_d": total([off[c] * way[c] for c in axes])})
        share = F.when(F.col("_n") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_d") / F.col("_n")))).otherwise(0.0)
        met = met.withColumn("_t", share).withColumn("_e", total([(off[c] - F.col("_t") * way[c]) * (off[c] - F.col("_t") * way[c]) for c in axes]))
        best = F.max(F.struct(F.col("_e").alias("e"), (-F.col("k")).alias("k"), F.col("p").alias("p")))
        split = met.groupBy(frame, "a").agg(best.alias("_m")).where(F.col("_m.e") > tolerance**2)
        split = cut(split.select(frame, "a", (-F.col("_m.k")).alias("m"), F.col("_m.p").alias("pm")))
        if split.isEmpty():
            break
        corners = corners.unionByName(split.select(frame, F.col("m").alias("k")))
        halves = segments.join(split, [frame, "a"])
        left = halves.select(frame, "a", F.col("m").alias("b"), "pa", F.col("pm").alias("pb"))
        segments = cut(left.unionByName(halves.select(frame, F.col("m").alias("a"), "b", F.col("pm").alias("pa"), "pb")))
        moved = now.join(split.select(frame, "a", "m"), [frame, "a"]).where("k != m")
        now = cut(moved.select(frame, F.when(F.col("k") < F.col("m"), F.col("a")).otherwise(F.col("m")).alias("a"), "k", "p"))
    marked = corners.select(frame, F.col("k").alias("_k")).distinct().withColumn("corner", F.lit(True))
    return rows.join(marked, [frame, "_k"], "left").withColumn("corner", F.coalesce("corner", F.lit(False))).drop("_k")


def _turns(x: np.ndarray, first: int, key: np.ndarray, m: float, o: float) -> tuple[list[int], np.ndarray]:
    """The key points of the detector from row first of x on, from the key point before; and the last key point."""
    out = []
    for i in range(first, len(x)):
        p = x[i - 1]
        way, step = p - key, x[i] - p
        far, near = float(way @ way), float(step @ step)
        if far and near and float(way @ step) ** 2 / (far * near) < 1 - math.exp(-o - far / m**2) ** 4:
            out.append(i - 1)
            key = p
    return out, key


def keypoints(points: DataFrame, m: float = 1.0, o: float = 0.0, axes: Sequence[str] = ("x", "y", "z"), frame: str = "frame", order: str = "point_id", block: int = BLOCK) -> DataFrame:
    """points with keypoint: where a scan line turns, by how far the way from the last key point leaves its direction.

    At each point the squared cosine between the way from the last key point to the point before, and from there to this one, is held against
    1 - exp(-o - way / m^2)^4; below it the point before becomes a key point. The first and the last point always are.

    All that a point hands on is the last key point. So blocks begin with a guess, the point before them, and run at once; then those whose
    predecessor ended with another key point than they began with run again, until none has to. After its first key points a block mostly goes on as it did from the guess, so that few run more than twice.
    """
    rows, key = _blocked(points, order, frame, block), points.schema[frame]
    at = F.array(*[F.col(a).cast("double") for a in axes])
    own = rows.select(frame, "_block", "_k", at.alias("p"))
    halo = own.where(F.pmod("_k", F.lit(block)) == block - 1).select(frame, (F.col("_block") + 1).alias("_block"), "_k", "p")
    doubles = T.ArrayType(T.DoubleType())
    schema = _named(key, ("_block", T.LongType()), ("begin", doubles), ("last", doubles), ("turns", T.ArrayType(T.LongType())))
    both = cut(own.unionByName(halo))

    def run(k: tuple, held: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("_k")
        x, start = np.array(held["p"].tolist(), float), int(held["_k"].iloc[0])
        begin = np.array(told["begin"].iloc[0], float) if len(told) else x[0]
        turns, last = _turns(x, max(1, 2 - start), begin, m, o)
        return pd.DataFrame([(k[0], k[1], begin.tolist(), last.tolist(), [start + i for i in turns])], columns=schema.names)

    blocks = own.select(frame, "_block").distinct()
    none = own.select(frame, "_block", F.col("p").alias("begin")).where("false")
    mine = both.join(blocks, [frame, "_block"], "left_semi")
    done = cut(mine.groupBy(frame, "_block").cogroup(none.groupBy(frame, "_block")).applyInPandas(run, schema))
    while True:
        before = done.select(frame, (F.col("_block") + 1).alias("_block"), F.col("last").alias("_last"))
        again = cut(done.join(before, [frame, "_block"]).where("begin != _last").select(frame, "_block", F.col("_last").alias("begin")))
        if again.isEmpty():
            break
        some = mine.join(again.select(frame, "_block"), [frame, "_block"], "left_semi")
        redone = some.groupBy(frame, "_block").cogroup(again.toDF(*again.columns).groupBy(frame, "_block")).applyInPandas(run, schema)
        done = cut(done.join(again.select(frame, "_block"), [frame, "_block"], "left_anti").unionByName(redone))
    ends = rows.groupBy(frame).agg(F.max("_k").alias("_last"))
    turned = done.select(frame, F.explode("turns").alias("_k")).withColumn("_turn", F.lit(True))
    met = rows.join(turned, [frame, "_k"], "left").join(ends, frame)
    return met.withColumn("keypoint", F.coalesce("_turn", F.lit(False)) | (F.col("_k") == 0) | (F.col("_k") == F.col("_last"))).select(*points.columns, "keypoint")
