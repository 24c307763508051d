"""Trees of codes as symbols of any coder, with tails of lone codes, as bit streams, and back."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octarine.functions import bits as B
from octarine.functions import ranges as R
from octarine.functions.lineage import cut, prefix
from octarine.operators import bitstream, ntree

#: Dimensions that name a coder of binary layers: counts of the rarer bit, the same with an overflow, and bits chosen by node.
COUNTER, OVERFLOW, PERMUTATION = 0, -1, -2


def _used(plan: Sequence[int]) -> list[int]:
    """Bits of the code above each layer."""
    return [sum(max(d, 1) for d in plan[:k]) for k in range(len(plan))]


def _bits_below(plan: Sequence[int], width: int) -> F.Column:
    return F.element_at(F.array(*[F.lit(width - u) for u in _used(plan)]), F.col("layer") + 1)


def symbols(codes: DataFrame, dims: Sequence[int], width: int, payload: bool = False) -> tuple[DataFrame, DataFrame]:
    """(symbols, tails) of distinct codes (frame, code).

    symbols: frame, layer, dim, parent, symbol, width, n, a row for each node that is written. The dimension of a layer names its coder: 1 to 6 an
    occupancy flag of 2^dim bits, 0 the count of set bits in as many bits as the node's own count needs, -1 that count with an overflow,
    -2 (for the whole word) the bit that splits the node best. tails: frame, layer, parent, tail, tail_bits. With payload a code that is alone
    in a node is written as it is from that layer's bits on: an occupancy flag of 0 says so there, a count of 1 needs no word. The nodes below have no symbols. Trees of
    chosen bits always have tails.
    """
    plan = ntree.plan_dims(dims, width)
    if plan[0] == PERMUTATION:
        return _permuted(codes, width)
    tokens = ntree.tokenize(codes, dims, width)
    at = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("child").cast("int"))
    nodes = tokens.groupBy("frame", "layer", "dim", "parent").agg(F.bit_or(at).alias("flag"), F.sum(F.when(F.col("dim") <= 0, F.col("child")).otherwise(0)).alias("minor"), F.count(F.lit(1)).alias("n"), F.min("code").alias("code"))
    nodes = nodes.withColumn("major", F.col("n") - F.col("minor"))
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("tail_bits")) - 1
    tails = None
    if payload:
        nodes = cut(nodes)
        first = nodes.where("n = 1").groupBy("frame", "code").agg(F.min("layer").alias("layer"), F.max_by("parent", -F.col("layer")).alias("parent"))
        tails = first.withColumn("tail_bits", _bits_below(plan, width)).select("frame", "layer", "parent", F.col("code").bitwiseAND(low).alias("tail"), "tail_bits")
        begun = first.select(F.col("frame").alias("_f"), F.col("code").alias("_c"), F.col("layer").alias("_first"))
        lone = nodes.where("n = 1").join(begun, (F.col("frame") == F.col("_f")) & (F.col("code") == F.col("_c"))).where("layer = _first and dim > 0").select(*nodes.columns).withColumn("flag", F.lit(0).cast("bigint"))
        nodes = nodes.where("n > 1").unionByName(lone)
    over = ntree.overflow_symbols(ntree.counter_symbols(nodes).withColumnsRenamed({"symbol": "count", "width": "count_width"}))
    symbol = F.when(F.col("dim") > 0, F.col("flag")).when(F.col("dim") == COUNTER, F.col("count")).otherwise(F.col("symbol"))
    size = F.when(F.col("dim") > 0, F.call_function("shiftleft", F.lit(1), F.greatest("dim", F.lit(0)))).when(F.col("dim") == COUNTER, F.col("count_width").cast("int")).otherwise(F.col("width"))
    out = over.select("frame", "layer", "dim", "parent", symbol.alias("symbol"), size.alias("width"), "n")
    if tails is None:
        tails = out.select("frame", "layer", "parent", F.lit(0).cast("bigint").alias("tail"), F.lit(0).alias("tail_bits")).where("false")
    return out, tails


def _states(n: F.Column) -> F.Column:
    """Whether a child has no code, one, or several."""
    return F.least(n, F.lit(2)).cast("bigint")


def _permuted(codes: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Symbols of a tree of chosen bits: the bit's number, then the states of both children; lone codes are written with the bits not chosen on their way."""
    nodes = cut(ntree.permutation(codes, width))
    symbol = (F.col("choice") * 16 + _states(F.col("n") - F.col("ones")) * 4 + _states(F.col("ones"))).cast("bigint")
    out = nodes.select("frame", F.col("layer").cast("int").alias("layer"), F.lit(PERMUTATION).alias("dim"), F.col("node").alias("parent"), symbol.alias("symbol"), F.lit((width - 1).bit_length() + 4).alias("width"), "n")
    one = F.lit(1).cast("bigint")
    now = codes.select("frame", "code", one.alias("node"), F.lit(0).cast("bigint").alias("used"))
    tails = None
    top = nodes.agg(F.max("layer")).first()[0]
    for _ in range(0 if top is None else top + 1):
        met = now.join(nodes.select("frame", "node", "choice"), ["frame", "node"], "left")
        met = cut(met)
        done = met.where("choice is null")
        tails = done if tails is None else tails.unionByName(done)
        bit = F.call_function("shiftleft", one, F.col("choice"))
        now = met.where("choice is not null").select("frame", "code", (F.col("node") * 2 + (F.col("code").bitwiseAND(bit) != 0).cast("bigint")).alias("node"), F.col("used").bitwiseOR(bit).alias("used"))
    now = now.withColumn("choice", F.lit(None).cast("int"))
    tails = now if tails is None else tails.unionByName(now)
    bits = (F.lit(width) - F.bit_count("used")).cast("int")
    free = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.call_function("shiftrightunsigned", F.col("used"), k).bitwiseAND(one) == 0)
    tail = F.aggregate(free, F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("k")), lambda s, k: F.struct((s["v"] + F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("code"), k).bitwiseAND(one), s["k"])).alias("v"), (s["k"] + 1).alias("k")))["v"]
    return out, tails.select("frame", F.bit_count("used").cast("int").alias("layer"), F.col("node").alias("parent"), tail.alias("tail"), bits.alias("tail_bits"))


def write(symbols_: DataFrame, tails: DataFrame, archive: bool = False) -> DataFrame:
    """(frame, n, flag_bits, payload_bits, flags, payload, archive): each frame's symbols and tails as bit streams, in the order of layer and node; archive: both, deflated, or null.

    The bits are packed by array operations; a frame is one task's, as one scan is.
    """
    one = symbols_.select("frame", F.lit(0).alias("kind"), "layer", "parent", F.col("symbol").alias("value"), "width")
    two = tails.select("frame", F.lit(1).alias("kind"), "layer", "parent", F.col("tail").alias("value"), F.col("tail_bits").alias("width"))
    fields = [symbols_.schema["frame"], *[T.StructField(c, T.LongType()) for c in ("n", "flag_bits", "payload_bits")], *[T.StructField(c, T.BinaryType()) for c in ("flags", "payload", "archive")]]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "layer", "parent"])
        parts = [pdf[pdf["kind"] == k] for k in (0, 1)]
        packed = [R.pack(p["value"].to_numpy(np.int64), p["width"].to_numpy(np.int64)) for p in parts]
        small = zlib.compress(packed[0] + packed[1], 9) if archive else None
        return pd.DataFrame({"frame": [key[0]], "n": [len(parts[0])], "flag_bits": [int(parts[0]["width"].sum())], "payload_bits": [int(parts[1]["width"].sum())], "flags": [packed[0]], "payload": [packed[1]], "archive": [small]})

    return one.unionByName(two).groupBy("frame").applyInPandas(run, T.StructType(fields))


def read(written: DataFrame, dims: Sequence[int], width: int, payload: bool = False) -> DataFrame:
    """(frame, code) from write(), with out_points (the number of codes) joined to it: the counts of counter layers start from there."""
    plan = ntree.plan_dims(dims, width)
    schema = T.StructType([written.schema["frame"], T.StructField("code", T.LongType())])

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                source, tails = R.Bits(bytes(r.flags)), R.Bits(bytes(r.payload))
                codes = _read_permuted(source, tails, width, int(r.out_points)) if plan[0] == PERMUTATION else _read_layers(source, tails, plan, width, payload, int(r.out_points))
                yield pd.DataFrame({"frame": [r.frame] * len(codes), "code": np.asarray(codes, np.int64)})

    return written.select("frame", "flags", "payload", "out_points").mapInPandas(run, schema)


def write_streams(symbols_: DataFrame, tails: DataFrame, chunk: int = bitstream.CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flags, payload, sizes): the symbols and the tails as streams in chunks (see bitstream), which any number of tasks write; sizes: (frame, n, flag_bits, payload_bits).

    As write(), but for symbols with an overflow: of a layer come first the counts of all nodes, then the second words of those at their cap, then the bits that tell which
    is larger. So a reader knows the widths of all words before it reads them.
    """
    b = F.greatest(B.bit_length(F.col("n")) - 1, F.lit(0))
    right = lambda k: F.call_function("shiftrightunsigned", F.col("symbol"), k)
    word = lambda plane, value, width: F.struct(F.lit(plane).alias("plane"), value.alias("value"), width.cast("int").alias("width"))
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - 1
    two = [word(0, right(F.col("width") - b), b), word(1, right(F.col("width") - 2 * b).bitwiseAND(low), b)]
    three = word(2, F.col("symbol").bitwiseAND(F.lit(1).cast("bigint")), F.lit(1))
    over = (F.col("dim") == OVERFLOW) & (F.col("n") > 1) & (F.col("width") > b)
    words = F.when(over & (F.col("width") > 2 * b), F.array(*two, three)).when(over, F.array(*two)).otherwise(F.array(word(0, F.col("symbol"), F.col("width"))))
    laid = symbols_.select("frame", "layer", "parent", F.explode(words).alias("w")).select("frame", "layer", "parent", "w.*")
    flags, layers = bitstream.write(laid, ("layer", "plane", "parent"), "value", "width", chunk=chunk)
    payload, below = bitstream.write(tails, ("layer", "parent"), "tail", "tail_bits", chunk=chunk)
    counts = symbols_.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    bits = counts.join(bitstream.sizes(layers).select("frame", F.col("bits").alias("flag_bits")), "frame", "full").join(bitstream.sizes(below).select("frame", F.col("bits").alias("payload_bits")), "frame", "full")
    return flags, payload, bits.na.fill(0, ["n", "flag_bits", "payload_bits"])


def read_streams(flags: DataFrame, payload_: DataFrame, frames: DataFrame, dims: Sequence[int], width: int, payload: bool = False, chunk: int = bitstream.CHUNK) -> DataFrame:
    """(frame, code) from write_streams(), with frames (frame, out_points: the number of codes); payload: whether lone codes were written as they are.

    Layer by layer: what is known of the nodes gives the width of each word, prefix sums its bit, and the word the nodes below. Trees of chosen bits
    are read by frame, or from their tables.
    """
    plan = ntree.plan_dims(dims, width)
    if plan[0] == PERMUTATION:
        raise ValueError("trees of chosen bits are read by read() or decode_permutation()")
    zero = F.lit(0).cast("bigint")
    nodes = frames.where("out_points > 0").select("frame", zero.alias("k"), zero.alias("node"), F.col("out_points").cast("bigint").alias("count"), zero.alias("_at"), zero.alias("_tail"))
    out, below = None, width
    for d in plan:
        lone = None
        if payload and d <= 0:
            nodes = cut(prefix(nodes.withColumn("_on", (F.col("count") > 1).cast("bigint")), "_on", "_rank"))
            lone, nodes = nodes.where("_on = 0").withColumn("_rank", F.col("k") - F.col("_rank")), nodes.where("_on = 1").withColumn("k", F.col("_rank"))
        if d > 0:
            size = 1 << d
            got = bitstream.gather(flags, nodes.select("frame", "k", "node", "_at", "_tail", F.lit(size).alias("_width"), (F.col("_at") + F.col("k") * size).alias("_start")), "_start", "_width", "flag", chunk=chunk)
            got = got.withColumn("_bits", F.lit(size).cast("bigint"))
            if payload:
                got = cut(prefix(got.withColumn("_on", (F.col("flag") != 0).cast("bigint")), "_on", "_rank"))
                lone = got.where("_on = 0").withColumn("_rank", F.col("k") - F.col("_rank"))
            set_ = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.call_function("shiftrightunsigned", F.col("flag"), c).bitwiseAND(F.lit(1).cast("bigint")) == 1)
            got = got.withColumn("_kids", F.transform(set_, lambda c: F.struct(c.alias("c"), F.lit(None).cast("bigint").alias("count"))))
        else:
            got = _counted(flags, nodes, d, chunk)
            both = F.array(F.struct(F.lit(0).alias("c"), (F.col("count") - F.col("minor")).alias("count")), F.struct(F.lit(1).alias("c"), F.col("minor").alias("count")))
            got = got.withColumn("_kids", F.filter(both, lambda x: x["count"] > 0))
        step = max(d, 1)
        got = cut(prefix(got.withColumn("_n", F.size("_kids").cast("bigint")), "_n", "_first")) if d <= 0 or not payload else cut(prefix(got.drop("_on", "_rank").withColumn("_n", F.size("_kids").cast("bigint")), "_n", "_first"))
        ends = got.groupBy("frame").agg((F.max("_at") + F.sum("_bits")).alias("_at"))
        if lone is not None:
            tails = bitstream.gather(payload_, lone.select("frame", "node", F.lit(below).alias("_width"), (F.col("_tail") + F.col("_rank") * below).alias("_start")), "_start", "_width", "tail", chunk=chunk)
            done = tails.select("frame", (F.call_function("shiftleft", F.col("node"), F.lit(below)) + F.col("tail")).alias("code"))
            out = done if out is None else out.unionByName(done)
            used = lone.groupBy("frame").agg(F.count(F.lit(1)).alias("_lone"))
            ends = ends.join(used, "frame", "left").withColumn("_used", F.coalesce("_lone", zero) * below).drop("_lone")
        else:
            ends = ends.withColumn("_used", zero)
        kids = got.select("frame", "_first", "node", "_tail", F.posexplode("_kids").alias("_j", "_kid")).join(ends, "frame")
        nodes = kids.select("frame", (F.col("_first") + F.col("_j")).alias("k"), (F.shiftleft("node", step) + F.col("_kid.c")).alias("node"), F.col("_kid.count").alias("count"), "_at", (F.col("_tail") + F.col("_used")).alias("_tail"))
        below -= step
    rest = nodes.select("frame", F.col("node").alias("code"))
    return rest if out is None else out.unionByName(rest)


def _counted(flags: DataFrame, nodes: DataFrame, d: int, chunk: int) -> DataFrame:
    """nodes (frame, k, node, count, _at, _tail) with minor, the number of their codes with the bit set, and _bits, what its words took."""
    if d == COUNTER:
        asked = cut(prefix(nodes.withColumn("_width", B.bit_length(F.col("count")).cast("int")), "_width", "_start").withColumn("_start", F.col("_at") + F.col("_start")))
        return bitstream.gather(flags, asked, "_start", "_width", "minor", chunk=chunk).withColumn("_bits", F.col("_width").cast("bigint"))
    b = F.greatest(B.bit_length(F.col("count")) - 1, F.lit(0)).cast("int")
    met = nodes.withColumns({"_b": b, "_cap": F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - 1, "_from": F.col("_at"), "_bits": F.lit(0).cast("bigint")})
    for plane in range(3):
        some = [F.lit(True), (F.col("count") > 1) & (F.col("_w0") == F.col("_cap")), (F.col("count") > 1) & (F.col("_w0") == F.col("_cap")) & (F.col("_w1") == F.col("_cap")) & (F.col("count") % 2 == 1)][plane]
        size = [F.greatest("_b", F.lit(1)), F.col("_b"), F.lit(1)][plane]
        asked = cut(prefix(met.withColumn("_width", F.when(some, size).otherwise(0)), "_width", "_start").withColumn("_start", F.col("_from") + F.col("_start")))
        read_ = bitstream.gather(flags, asked.where("_width > 0"), "_start", "_width", f"_w{plane}", chunk=chunk)
        met = read_.unionByName(asked.where("_width = 0").withColumn(f"_w{plane}", F.lit(None).cast("bigint")))
        ends = asked.groupBy("frame").agg(F.sum("_width").alias("_more"))
        met = met.withColumn("_bits", F.col("_bits") + F.col("_width")).join(ends, "frame").withColumn("_from", F.col("_from") + F.col("_more")).drop("_width", "_start", "_more")
    low, high = F.col("_w0"), F.col("_w1")
    minor = F.when(high.isNull(), low).when(high < F.col("_cap"), F.col("count") - high).when(F.col("count") % 2 == 0, (F.col("count") / 2).cast("bigint")).when(F.col("_w2") == 1, F.col("count") - F.col("_cap")).otherwise(F.col("_cap"))
    return met.withColumn("minor", minor)


def _read_layers(source: R.Bits, tails: R.Bits, plan: Sequence[int], width: int, payload: bool, n: int) -> np.ndarray:
    nodes, counts, below, done = np.zeros(1, np.int64), np.array([n]), width, []
    for d in plan:
        if payload and d <= 0:
            lone = counts == 1
            done.append(nodes[lone] << below | tails.many(np.full(lone.sum(), below)))
            nodes, counts = nodes[~lone], counts[~lone]
        if d > 0:
            flags = source.many(np.full(len(nodes), 1 << d))
            if payload:
                lone = flags == 0
                done.append(nodes[lone] << below | tails.many(np.full(lone.sum(), below)))
                nodes, flags = nodes[~lone], flags[~lone]
            at, child = np.nonzero(flags[:, None] >> np.arange(1 << d) & 1)
            nodes, counts = nodes[at] << d | child, np.zeros(len(at), np.int64)
        else:
            minor = source.many(np.array([int(c).bit_length() for c in counts], np.int64)) if d == COUNTER else np.array([_overflow(source, int(c)) for c in counts], np.int64)
            both = np.stack([counts - minor, minor], 1)
            at, child = np.nonzero(both)
            nodes, counts = nodes[at] << 1 | child, both[at, child]
        below -= max(d, 1)
    return np.concatenate([*done, nodes])


def _overflow(source: R.Bits, n: int) -> int:
    """The count of set bits of a node of n codes, as overflow_symbols() writes it."""
    if n == 1:
        return source.one(1)
    b = n.bit_length() - 1
    cap = (1 << b) - 1
    if (minor := source.one(b)) < cap:
        return minor
    major = source.one(b)
    if major < cap:
        return n - major
    if n % 2 == 0:
        return n // 2
    return n - cap if source.one(1) else cap


def _read_permuted(source: R.Bits, tails: R.Bits, width: int, n: int) -> list[int]:
    size, done = (width - 1).bit_length(), []
    level, lone = ([(1, 0, 0)], []) if n > 1 else ([], [(0, 1, 0, 0)] if n else [])
    depth = 0
    while level:
        below = []
        for node, used, value in level:
            choice, states = source.one(size), source.one(4)
            for bit, state in ((0, states >> 2), (1, states & 3)):
                if state:
                    child = (node * 2 + bit, used | 1 << choice, value | bit << choice)
                    if state == 2 and depth + 1 < width:
                        below.append(child)
                    else:
                        lone.append((depth + 1, *child))
        level, depth = below, depth + 1
    for _, _, used, value in sorted(lone):
        free = [k for k in range(width) if not used >> k & 1]
        tail = tails.one(len(free))
        done.append(value | sum((tail >> j & 1) << k for j, k in enumerate(free)))
    return done


def decode_permutation(symbols_: DataFrame, tails: DataFrame, width: int) -> DataFrame:
    """(frame, code) from the tables of a tree of chosen bits: layer by layer from the roots, each node giving its bit; a tail fills the bits that were not chosen."""
    one = F.lit(1).cast("bigint")
    states = F.col("symbol").bitwiseAND(F.lit(15).cast("bigint"))
    own = symbols_.select("frame", F.col("parent").alias("node"), F.floor(F.col("symbol") / 16).cast("int").alias("choice"), F.floor(states / 4).alias("s0"), states.bitwiseAND(F.lit(3).cast("bigint")).alias("s1"))
    ends = tails.select("frame", F.col("parent").alias("node"), "tail")
    own, ends = cut(own), cut(ends)
    frames = own.select("frame").union(ends.select("frame")).distinct()
    now, out = frames.select("frame", one.alias("node"), F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("value")), None
    free = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.call_function("shiftrightunsigned", F.col("used"), k).bitwiseAND(one) == 0)
    filled = F.aggregate(F.transform(free, lambda k, j: F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("tail"), j).bitwiseAND(one), k)), F.col("value"), lambda s, x: s + x)
    top = symbols_.agg(F.max("layer")).first()[0]
    for _ in range(2 + (-1 if top is None else top)):
        met = cut(now.join(own, ["frame", "node"], "left").join(ends, ["frame", "node"], "left"))
        done = met.where("tail is not null").select("frame", filled.alias("code"))
        out = done if out is None else out.unionByName(done)
        kids = met.where("choice is not null").select("frame", "node", "used", "value", "choice", F.explode(F.filter(F.array(F.struct(F.lit(0).cast("bigint").alias("bit"), F.col("s0").alias("s")), F.struct(one.alias("bit"), F.col("s1").alias("s"))), lambda x: x["s"] > 0)).alias("kid"))
        now = kids.select("frame", (F.col("node") * 2 + F.col("kid.bit")).alias("node"), F.col("used").bitwiseOR(F.call_function("shiftleft", one, F.col("choice"))).alias("used"), (F.col("value") + F.call_function("shiftleft", F.col("kid.bit"), F.col("choice"))).alias("value"))
    return out


def decode(symbols_: DataFrame, tails: DataFrame, dims: Sequence[int], width: int) -> DataFrame:
    """(frame, code) from the tables of occupancy layers, with or without tails."""
    plan = ntree.plan_dims(dims, width)
    if min(plan) <= 0:
        raise ValueError("tables of counter layers are decoded from their streams")
    nodes = symbols_.where("layer = 0").select("frame", F.col("parent").alias("node")).distinct()
    symbols_, tails, out = cut(symbols_), cut(tails), None
    low = F.call_function("shiftleft", F.col("node"), F.col("tail_bits"))
    for k, d in enumerate(plan):
        own = tails.where(F.col("layer") == k).select("frame", F.col("parent").alias("node"), "tail", "tail_bits")
        done = own.select("frame", (low + F.col("tail")).alias("code"))
        out = done if out is None else out.unionByName(done)
        nodes = ntree.expand(nodes, symbols_.where(F.col("layer") == k).withColumnRenamed("symbol", "flag"), d)
    return out.unionByName(nodes.withColumnRenamed("node", "code"))


def undo_differences(symbols_: DataFrame, frame: str = "frame_no") -> DataFrame:
    """Symbols with delta back to flag: the xor of a node's deltas since the frame in which it last began to be there.

    Frames are consecutive numbers, so a node's frames in a row share their number less their rank.
    """
    from pyspark.sql import Window as W

    own = W.partitionBy("layer", "parent").orderBy(frame)
    since = symbols_.withColumn("_run", F.col(frame) - F.row_number().over(own))
    flag = F.bit_xor("delta").over(W.partitionBy("layer", "parent", "_run").orderBy(frame).rowsBetween(W.unboundedPreceding, 0))
    return since.withColumn("flag", flag).drop("_run")


def sorted_bits(codes: DataFrame, order: DataFrame, width: int) -> DataFrame:
    """codes with new bit j being old bit p[j] of their frame's order (frame, p)."""
    met = codes.join(order.select("frame", "p"), "frame")
    new = B.total([F.shiftleft(F.call_function("shiftrightunsigned", F.col("code"), F.get("p", F.lit(j)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")), j) for j in range(width)])
    return met.select("frame", new.alias("code"))


def unsorted_bits(codes: DataFrame, order: DataFrame, width: int) -> DataFrame:
    met = codes.join(order.select("frame", "p"), "frame")
    return met.select("frame", B.permute_by(F.col("code"), F.col("p"), width).alias("code"))
