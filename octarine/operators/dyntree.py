"""Trees of boxes whose dimension shrinks as their sides fall below a radius."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octarine.functions import bits as B
from octarine.functions.lineage import cut

AXES = ("x", "y", "z")


def boxes(points: DataFrame, radius: float, frame: str = "frame", axes: Sequence[str] = AXES, centre: bool = True) -> DataFrame:
    """(frame, offset_<k>, box_<k>, axis_<k>): half sides, largest first, and which axis each is; offset is the middle of each axis, or 0."""
    mid = {a: (F.min(a) + F.max(a)) / 2 if centre else F.lit(0.0) for a in axes}
    half = {a: (F.max(a) - F.min(a)) / 2 if centre else F.max(F.abs(a)) for a in axes}
    sides = F.sort_array(F.array(*[F.struct((-half[a] - radius / 2).alias("s"), F.lit(k).alias("axis"), mid[a].alias("mid")) for k, a in enumerate(axes)]))
    got = points.groupBy(frame).agg(sides.alias("_s"))
    out = [c for k in range(len(axes)) for c in ((-F.col("_s")[k]["s"]).alias(f"box_{k}"), F.col("_s")[k]["axis"].alias(f"axis_{k}"), F.col("_s")[k]["mid"].alias(f"offset_{k}"))]
    return got.select(frame, *out)


def placed(points: DataFrame, box: DataFrame, frame: str = "frame", axes: Sequence[str] = AXES) -> DataFrame:
    """points less the offset, with p<k>: the axes in the box's order."""
    values = F.array(*[F.col(a).cast("double") for a in axes])
    met = points.join(box, frame)
    return met.withColumn("_v", values).withColumns({f"p{k}": F.get("_v", F.col(f"axis_{k}")) - F.col(f"offset_{k}") for k in range(len(axes))}).drop("_v")


def encode(points: DataFrame, radius: float, max_layers: int = 64, frame: str = "frame", axes: Sequence[str] = AXES, cut: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame]:
    """(boxes, symbols): symbols are (frame, layer, node, dims, flag, n), a row for each node.

    On every layer a box is halved on the axes whose half side is over the radius. A node with no point farther than
    the radius from its middle on any axis has flag 0 and ends; else flag has a bit for each child box with points.
    node is a path that starts with 1. A layer is one partial aggregation by node and a join back; their number is bounded by the largest box,
    and cut writes a checkpoint after every other one. Empty frames have no rows.
    """
    if radius <= 0:
        raise ValueError("the radius must be above 0")
    d = len(axes)
    box = boxes(points, radius, frame, axes)
    widest = box.agg(F.max(F.greatest(*[F.col(f"box_{k}") for k in range(d)]) if d > 1 else F.col("box_0"))).first()[0]
    layers = 0
    while widest is not None and widest > radius and layers < max_layers:
        widest, layers = widest / 2, layers + 1
    now = placed(points, box, frame, axes).select(frame, F.lit(1).cast("bigint").alias("node"), *[f"p{k}" for k in range(d)], *[f"box_{k}" for k in range(d)])
    out = None
    if 1 + d * layers > 63:
        raise ValueError(f"{layers} layers of {d} axes: a node's path would not fit a long; raise the radius or lower max_layers")
    for layer in range(layers):
        big = [F.col(f"box_{k}") > radius for k in range(d)]
        dims = sum((b.cast("int") for b in big[1:]), big[0].cast("int"))
        far = F.greatest(*[F.abs(f"p{k}") for k in range(d)]) > radius if d > 1 else F.abs("p0") > radius
        child = B.total([F.when(big[k] & (F.col(f"p{k}") >= 0), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in range(d)])
        marked = now.withColumns({"dims": dims, "child": child}).where("dims > 0")
        at = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("child").cast("int"))
        nodes = marked.groupBy(frame, "node").agg(F.max("dims").alias("dims"), F.bool_or(far).alias("keep"), F.bit_or(at).alias("flag"), F.count(F.lit(1)).alias("n"))
        nodes = nodes.withColumn("flag", F.when(F.col("keep"), F.col("flag")).otherwise(F.lit(0).cast("bigint")))
        rows = nodes.select(frame, F.lit(layer).alias("layer"), "node", "dims", "flag", "n")
        out = rows if out is None else out.unionByName(rows)
        alive = marked.join(nodes.where("keep").select(frame, "node"), [frame, "node"])
        half = [F.when(big[k], F.col(f"box_{k}") / 2).otherwise(F.col(f"box_{k}")) for k in range(d)]
        moved = [F.when(big[k], F.col(f"p{k}") + F.when(F.col(f"p{k}") >= 0, -half[k]).otherwise(half[k])).otherwise(F.col(f"p{k}")) for k in range(d)]
        path = F.call_function("shiftleft", F.col("node"), F.col("dims")).bitwiseOR(F.col("child"))
        now = alive.select(frame, path.alias("node"), *[m.alias(f"p{k}") for k, m in enumerate(moved)], *[h.alias(f"box_{k}") for k, h in enumerate(half)])
        if layer % 2:
            now = cut(now)
    if out is None:
        out = now.select(frame, F.lit(0).alias("layer"), "node", F.lit(0).alias("dims"), F.lit(0).cast("bigint").alias("flag"), F.lit(1).cast("bigint").alias("n")).where("false")
    return box, out


def decode(box: DataFrame, symbols: DataFrame, radius: float, frame: str = "frame", axes: Sequence[str] = AXES) -> DataFrame:
    """(frame, axes): the middle of each leaf: of nodes of flag 0, and of those that the last layer leaves."""
    d = len(axes)
    now = box.select(frame, F.lit(1).cast("bigint").alias("node"), *[F.lit(0.0).alias(f"c{k}") for k in range(d)], *[f"box_{k}" for k in range(d)])
    leaves = None
    top = symbols.agg(F.max("layer")).first()[0]
    for layer in range(0 if top is None else top + 1):
        met = now.join(symbols.where(F.col("layer") == layer).select(frame, "node", "dims", "flag"), [frame, "node"], "left")
        met = cut(met) if layer % 2 else met
        done = met.where("flag is null or flag = 0").select(frame, *[f"c{k}" for k in range(d)])
        leaves = done if leaves is None else leaves.unionByName(done)
        kids = met.where("flag != 0").withColumn("child", F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << d) - 1)), lambda k: F.call_function("bit_get", F.col("flag"), k) == 1)))
        big = [F.col(f"box_{k}") > radius for k in range(d)]
        half = [F.when(big[k], F.col(f"box_{k}") / 2).otherwise(F.col(f"box_{k}")) for k in range(d)]
        sign = [F.when(F.call_function("bit_get", F.col("child").cast("bigint"), F.lit(k)) == 1, half[k]).otherwise(-half[k]) for k in range(d)]
        path = F.call_function("shiftleft", F.col("node"), F.col("dims")).bitwiseOR(F.col("child").cast("bigint"))
        now = kids.select(frame, path.alias("node"), *[(F.col(f"c{k}") + F.when(big[k], sign[k]).otherwise(0.0)).alias(f"c{k}") for k in range(d)], *[h.alias(f"box_{k}") for k, h in enumerate(half)])
    rest = now.select(frame, *[f"c{k}" for k in range(d)])
    leaves = rest if leaves is None else leaves.unionByName(rest)
    met = leaves.join(box, frame)
    back = {a: B.total([F.when(F.col(f"axis_{k}") == j, F.col(f"c{k}") + F.col(f"offset_{k}")).otherwise(0.0) for k in range(d)]) for j, a in enumerate(axes)}
    return met.select(frame, *[c.alias(a) for a, c in back.items()])


def prune(points: DataFrame, radius: float, node: Sequence[str] = ("frame",), axes: Sequence[str] = AXES) -> DataFrame:
    """(node, keep, n): whether any point of a node is farther than the radius from 0 on some axis."""
    far = F.greatest(*[F.abs(a) for a in axes]) > radius
    return points.groupBy(*node).agg(F.bool_or(far).alias("keep"), F.count(F.lit(1)).alias("n"))


def mean_split(points: DataFrame, radius: float, max_layers: int | None = None, frame: str = "frame", axes: Sequence[str] = AXES, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(frame, layer, node, dims, flag, n, mean_<axis>, box_<axis>): each node has a box of its own, split at the mean of its points.

    A node's box is the largest distance from its mean on each axis; it is split on the axes where that is over
    the radius, and ends where there is none (flag 0). A child's number has a bit for each axis; a path shifts by the number of axes.
    Layers go on until no box is over the radius, or for max_layers; where a path would no longer fit a long, it is an error.
    """
    d = len(axes)
    now, out = points.select(frame, F.lit(1).cast("bigint").alias("node"), *axes), None
    for layer in count() if max_layers is None else range(max_layers):
        if 1 + d * layer > 63:
            raise ValueError(f"a node's path of {layer} layers of {d} axes does not fit a long")
        means = now.groupBy(frame, "node").agg(*[F.avg(a).alias(f"mean_{a}") for a in axes])
        met = now.join(means, [frame, "node"])
        sides = met.groupBy(frame, "node").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.abs(F.col(a) - F.col(f"mean_{a}"))).alias(f"box_{a}") for a in axes])
        met = met.join(sides, [frame, "node"])
        big = [F.col(f"box_{a}") > radius for a in axes]
        child: Column = B.total([F.when(b & (F.col(a) >= F.col(f"mean_{a}")), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, (a, b) in enumerate(zip(axes, big, strict=True))])
        dims = sum((b.cast("int") for b in big[1:]), big[0].cast("int"))
        met = met.withColumns({"child": child, "dims": dims})
        met = cut(met)  # it is read twice: a plan without cuts would double with each layer
        at = F.when(F.col("dims") > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("child").cast("int"))).otherwise(F.lit(0).cast("bigint"))
        firsts = [F.first(f"{p}_{a}").alias(f"{p}_{a}") for p in ("mean", "box") for a in axes]
        rows = met.groupBy(frame, "node").agg(F.max("dims").alias("dims"), F.bit_or(at).alias("flag"), F.count(F.lit(1)).alias("n"), *firsts).withColumn("layer", ((F.length(F.bin("node")) - 1) / d).cast("int"))
        out = rows if out is None else out.unionByName(rows)
        now = met.where("dims > 0").select(frame, (F.shiftleft("node", d) + F.col("child")).alias("node"), *axes)
        if now.isEmpty():
            break
    return out


def mean_leaves(symbols: DataFrame, frame: str = "frame", axes: Sequence[str] = AXES) -> DataFrame:
    """(frame, node, n, axes): the means of the leaves of mean_split(): nodes of flag 0, and those of the last layer."""
    last = symbols.groupBy(frame).agg(F.max("layer").alias("_last"))
    leaves = symbols.join(last, frame).where("flag = 0 or layer = _last")
    return leaves.select(frame, "node", "n", *[F.col(f"mean_{a}").alias(a) for a in axes])


def streams(symbols: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, n, bits, stream) of encode(): each flag in two to the dims bits, by layer and node."""
    from octarine.operators import entropy

    sized = symbols.where("dims > 0").withColumn("width", F.call_function("shiftleft", F.lit(1), F.col("dims")))
    return entropy.streams(sized, frame, order=("layer", "node"))


def read_streams(written: DataFrame, box: DataFrame, radius: float, max_layers: int = 64, frame: str = "frame", d: int = 3) -> DataFrame:
    """(frame, layer, node, dims, flag) from streams(): a layer's dimension follows from the box, its number of symbols from the flags above."""
    import pandas as pd
    from pyspark.sql import types as T

    from octarine.functions.ranges import BitReader

    schema = T.StructType([written.schema[frame], *[T.StructField(c, t) for c, t in (("layer", T.IntegerType()), ("node", T.LongType()), ("dims", T.IntegerType()), ("flag", T.LongType()))]])

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                source, nodes, sides = BitReader(bytes(r["stream"])), [1], [r[f"box_{k}"] for k in range(d)]
                for layer in range(max_layers):
                    dims, below = sum(s > radius for s in sides), []
                    if not dims or not nodes:
                        break
                    for node in nodes:
                        flag = source.read(1 << dims)
                        rows.append((r[frame], layer, node, dims, flag))
                        below += [node << dims | k for k in range(1 << dims) if flag >> k & 1]
                    nodes, sides = below, [s / 2 if s > radius else s for s in sides]
            yield pd.DataFrame(rows, columns=schema.names)

    return written.join(box, frame).mapInPandas(run, schema)


def mean_bits(symbols: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, bits) of mean_split(): a node takes two to the number of its split axes, so one bit where there is none."""
    return symbols.groupBy(frame).agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("dims"))).alias("bits"))


def mean_streams(symbols: DataFrame, radius: float, frame: str = "frame", axes: Sequence[str] = AXES) -> DataFrame:
    """(frame, n, bits, stream) of mean_split(): by layer and node, which axes are split, in a bit each, and the children in two to their number of bits."""
    from octarine.operators import entropy

    d = len(axes)
    split = B.total([F.when(F.col(f"box_{a}") > radius, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, a in enumerate(axes)])
    at = F.filter(F.sequence(F.lit(0), F.lit((1 << d) - 1)), lambda c: c.cast("bigint").bitwiseAND(F.bitwise_not(split)) == 0)  # children that can be, in their order
    flags = F.aggregate(F.transform(at, lambda c, j: F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("flag"), c.cast("int")).bitwiseAND(F.lit(1).cast("bigint")), j)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    width = F.call_function("shiftleft", F.lit(1), F.col("dims"))
    value = F.call_function("shiftleft", split, width) + flags
    return entropy.streams(symbols.select(frame, "layer", "node", value.alias("value"), (width + d).alias("width")), frame, symbol="value", order=("layer", "node"))


def read_mean_streams(written: DataFrame, frame: str = "frame", d: int = 3) -> DataFrame:
    """(frame, layer, node, dims, split, flag) from mean_streams(): a node's children follow from its flag, and end where nothing is split."""
    import pandas as pd
    from pyspark.sql import types as T

    from octarine.functions.ranges import Bits

    schema = T.StructType([written.schema[frame], *[T.StructField(c, t) for c, t in (("layer", T.IntegerType()), ("node", T.LongType()), ("dims", T.IntegerType()), ("split", T.LongType()), ("flag", T.LongType()))]])

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                source, nodes, layer = Bits(bytes(r["stream"])), [1], 0
                while nodes:
                    below = []
                    for node in nodes:
                        split = source.one(d)
                        can = [c for c in range(1 << d) if not c & ~split]
                        told = source.one(len(can))
                        some = [c for j, c in enumerate(can) if told >> j & 1] if split else []
                        rows.append((r[frame], layer, node, split.bit_count(), split, sum(1 << c for c in some)))
                        below += [node << d | c for c in some]
                    nodes, layer = below, layer + 1
            yield pd.DataFrame(rows, columns=schema.names)

    return written.select(frame, "stream").mapInPandas(run, schema)


def mean_decode(symbols: DataFrame, box: DataFrame, frame: str = "frame", axes: Sequence[str] = AXES) -> DataFrame:
    """(frame, node, axes): leaves of read_mean_streams() without the means: each split halves the box (frame, mean_<axis>, box_<axis> of the root) about its middle.

    The encoder splits at means that are not written, so a leaf is as far off as the means were from the middles.
    """
    d = len(axes)
    now = box.select(frame, F.lit(1).cast("bigint").alias("node"), *[F.col(f"mean_{a}").alias(f"c_{a}") for a in axes], *[F.col(f"box_{a}").alias(f"h_{a}") for a in axes])
    out, top = None, symbols.agg(F.max("layer")).first()[0]
    own = cut(symbols.select(frame, "node", "split", "flag"))
    for _ in range(0 if top is None else top + 1):
        met = cut(now.join(own, [frame, "node"]))
        done = met.where("flag = 0").select(frame, "node", *[F.col(f"c_{a}").alias(a) for a in axes])
        out = done if out is None else out.unionByName(done)
        kids = met.where("flag != 0").withColumn("child", F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << d) - 1)), lambda k: F.call_function("bit_get", F.col("flag"), k) == 1)))
        is_split = lambda k: F.call_function("bit_get", F.col("split"), F.lit(k)) == 1
        half = [F.when(is_split(k), F.col(f"h_{a}") / 2).otherwise(F.col(f"h_{a}")) for k, a in enumerate(axes)]
        sign = [F.when(F.call_function("bit_get", F.col("child").cast("bigint"), F.lit(k)) == 1, half[k]).otherwise(-half[k]) for k in range(d)]
        now = kids.select(frame, (F.shiftleft("node", d) + F.col("child")).alias("node"), *[(F.col(f"c_{a}") + F.when(is_split(k), sign[k]).otherwise(0.0)).alias(f"c_{a}") for k, a in enumerate(axes)], *[h.alias(f"h_{a}") for h, a in zip(half, axes, strict=True)])
    return out


def unit_cells(nodes: DataFrame, layer: int, node: str = "node", axes: Sequence[str] = AXES) -> DataFrame:
    """nodes with the axes of their cell's middle in the unit box: a step of 0.5 ^ (layer + 1) to each side, layer by layer; a path's layers have a bit for each axis."""
    d = len(axes)
    out = {}
    for k, a in enumerate(axes):
        steps = [F.when(F.shiftright(node, d * (layer - 1 - j) + k).bitwiseAND(F.lit(1).cast("bigint")) == 1, 0.5 ** (j + 1)).otherwise(-(0.5 ** (j + 1))) for j in range(layer)]
        out[a] = B.total(steps) if steps else F.lit(0.0)
    return nodes.withColumns(out)
