"""Trees split near the means of their nodes, so that encoder and decoder make the same cuts.

Both know a node's box. On each axis where its half side is over the radius the box is cut at its middle plus q eighths of its side; q, from -2 to 2, is the step
nearest to the mean of the node's points, and is written. So a leaf's place is known to the decoder to the last bit, and it is within the radius of its points on every axis.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octarine.functions import bits as B
from octarine.functions import geometry as G
from octarine.functions.lineage import cut, prefix
from octarine.operators import bitstream

AXES = ("x", "y", "z")
#: Steps of a side, the largest step from its middle, and the bits of one.
STEPS, REACH, STEP_BITS = 8, 2, 3
#: Bits of a node's path.
PATH = 63


def _bit(value: str, k: int) -> Column:
    return F.shiftright(value, k).bitwiseAND(F.lit(1).cast("bigint")) == 1


def _cuts(nodes: DataFrame, radius: float, axes: Sequence[str]) -> DataFrame:
    """nodes (lo_<axis>, hi_<axis>) with mid_<axis>, unit_<axis>, split (a bit for each axis that is cut) and dims (their number)."""
    sides = {f"{n}_{a}": e for a in axes for n, e in (("mid", (F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2), ("unit", (F.col(f"hi_{a}") - F.col(f"lo_{a}")) / STEPS))}
    split = B.total([F.when((F.col(f"hi_{a}") - F.col(f"lo_{a}")) / 2 > radius, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, a in enumerate(axes)])
    return nodes.withColumns(sides | {"split": split}).withColumn("dims", F.bit_count("split").cast("int"))


def _halves(axes: Sequence[str]) -> list[Column]:
    """The box of a child (its bits in child) of a node that is cut at pos_<axis>."""
    out = []
    for k, a in enumerate(axes):
        own = _bit("split", k)
        out.append(F.when(own & _bit("child", k), F.col(f"pos_{a}")).otherwise(F.col(f"lo_{a}")).alias(f"lo_{a}"))
        out.append(F.when(own & ~_bit("child", k), F.col(f"pos_{a}")).otherwise(F.col(f"hi_{a}")).alias(f"hi_{a}"))
    return out


def encode(points: DataFrame, radius: float, max_layers: int | None = None, frame: str = "frame", axes: Sequence[str] = AXES) -> tuple[DataFrame, DataFrame]:
    """(roots, symbols): roots (frame, lo_<axis>, hi_<axis>), the box of all points; symbols (frame, layer, node, split, dims, flag, n, q_<axis>, pos_<axis>), a row for each node.

    A node whose points are all within the radius of its place on every axis has flag 0 and ends, as does one that no axis is long enough to cut (dims 0); else flag has
    a bit for each child with points, and a child's number a bit for each axis. Every step cuts a side to three quarters at most. node is a path that starts with 1; where it would no
    longer fit a long, it is an error. max_layers ends trees early; their last nodes may be farther from their points. Points that are null or not finite
    are left out, frames without others have no rows.

    A layer is one aggregation of points by node, and one join that takes the cuts back to those that go on.
    """
    if radius <= 0:
        raise ValueError("the radius must be above 0")
    d, one = len(axes), F.lit(1).cast("bigint")
    now = points.where(G.finite([F.col(a) for a in axes])).select(frame, one.alias("node"), *[F.col(a).cast("double").alias(a) for a in axes])
    told = roots = out = None
    for layer in count() if max_layers is None else range(max_layers):
        if 1 + d * layer > PATH:
            raise ValueError(f"{layer} layers of {d} axes: a node's path would not fit a long; raise the radius or set max_layers")
        ends = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("least", F.min), ("most", F.max), ("mean", F.avg))]
        stats = now.groupBy(frame, "node").agg(F.count(F.lit(1)).alias("n"), *ends)
        if told is None:
            boxed = stats.withColumns({f"{n}_{a}": F.col(f"{m}_{a}") for a in axes for n, m in (("lo", "least"), ("hi", "most"))})
        else:
            above = told.select(frame, F.col("node").alias("_above"), "split", *[f"{n}_{a}" for a in axes for n in ("lo", "hi", "pos")])
            kids = stats.withColumns({"_above": F.shiftright("node", d), "child": F.col("node").bitwiseAND(F.lit((1 << d) - 1))})
            boxed = kids.join(above, [frame, "_above"]).select(*stats.columns, *_halves(axes))
        nodes = _cuts(boxed, radius, axes)
        step = lambda a: F.when(F.col(f"unit_{a}") > 0, F.least(F.lit(REACH), F.greatest(F.lit(-REACH), F.floor((F.col(f"mean_{a}") - F.col(f"mid_{a}")) / F.col(f"unit_{a}") + 0.5))))
        nodes = nodes.withColumns({f"q_{a}": F.when(_bit("split", k), step(a)).otherwise(0).cast("int") for k, a in enumerate(axes)})
        nodes = nodes.withColumns({f"pos_{a}": F.col(f"mid_{a}") + F.col(f"q_{a}") * F.col(f"unit_{a}") for a in axes})
        far = [_bit("split", k) & (F.greatest(F.col(f"most_{a}") - F.col(f"pos_{a}"), F.col(f"pos_{a}") - F.col(f"least_{a}")) > radius) for k, a in enumerate(axes)]
        far = far[0] if d == 1 else F.array_contains(F.array(*far), True)
        told = cut(nodes.select(frame, F.lit(layer).alias("layer"), "node", "n", "split", "dims", far.alias("far"), *[f"{n}_{a}" for a in axes for n in ("q", "pos", "lo", "hi")]))
        roots = told.select(frame, *[f"{n}_{a}" for a in axes for n in ("lo", "hi")]) if roots is None else roots
        rows = told.drop(*[f"{n}_{a}" for a in axes for n in ("lo", "hi")])
        out = rows if out is None else out.unionByName(rows)
        on = told.where("far").select(frame, "node", "split", *[f"pos_{a}" for a in axes])
        child = B.total([F.when(_bit("split", k) & (F.col(a) >= F.col(f"pos_{a}")), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, a in enumerate(axes)])
        now = now.join(on, [frame, "node"]).select(frame, (F.shiftleft("node", d) + child).alias("node"), *axes)
        now = cut(now)
        if now.isEmpty():
            break
    bit = F.call_function("shiftleft", one, F.col("node").bitwiseAND(F.lit((1 << d) - 1)).cast("int"))
    flags = out.where("layer > 0").groupBy(frame, (F.col("layer") - 1).alias("layer"), F.shiftright("node", d).alias("node")).agg(F.bit_or(bit).alias("flag"))
    symbols = out.drop("far").join(flags, [frame, "layer", "node"], "left").withColumn("flag", F.coalesce("flag", F.lit(0).cast("bigint")))
    return roots, symbols


def _children(d: int) -> Column:
    """The children that a node with these cuts can have, in their order."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << d) - 1)), lambda c: c.cast("bigint").bitwiseAND(F.bitwise_not("split")) == 0)


def write(symbols: DataFrame, frame: str = "frame", axes: Sequence[str] = AXES, chunk: int = bitstream.CHUNK) -> tuple[DataFrame, DataFrame]:
    """(stream, layers) of encode()'s symbols, as bitstream.write() gives them: of each node that can be cut the steps of the cut axes, in three bits each, and its flag, in a bit for each child that it can have."""
    one, d = F.lit(1).cast("bigint"), len(axes)
    if STEP_BITS * d + (1 << d) > 64:
        raise ValueError(f"the symbols of {d} axes do not fit 64 bits")
    can = F.transform(_children(d), lambda c, j: F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("flag"), c).bitwiseAND(one), j))
    value, width = F.aggregate(can, F.lit(0).cast("bigint"), lambda s, x: s + x), F.call_function("shiftleft", F.lit(1), F.col("dims"))
    for k, a in reversed(list(enumerate(axes))):
        own = _bit("split", k)
        value = F.when(own, F.call_function("shiftleft", (F.col(f"q_{a}") + REACH).cast("bigint"), width) + value).otherwise(value)
        width = F.when(own, width + STEP_BITS).otherwise(width)
    some = symbols.where("dims > 0").withColumns({"_v": value, "_w": width})
    return bitstream.write(some, ("layer", "node"), "_v", "_w", frame, chunk)


def decode(stream: DataFrame, roots: DataFrame, radius: float, frame: str = "frame", axes: Sequence[str] = AXES, chunk: int = bitstream.CHUNK) -> DataFrame:
    """(frame, node, axes): the places of the leaves, from write()'s stream and encode()'s roots.

    Layer by layer: a node's box tells the width of its symbol, prefix sums of these where it stands, and its symbol the boxes of its children.
    """
    d, zero = len(axes), F.lit(0).cast("bigint")
    box = [f"{n}_{a}" for a in axes for n in ("lo", "hi")]
    nodes = roots.select(frame, zero.alias("k"), F.lit(1).cast("bigint").alias("node"), zero.alias("_from"), *box)
    out = None
    while True:
        held = _cuts(nodes, radius, axes)
        held = held.withColumn("width", F.when(F.col("dims") > 0, F.col("dims") * STEP_BITS + F.call_function("shiftleft", F.lit(1), F.col("dims"))).otherwise(0))
        held = cut(prefix(held, "width", "_start", frame).withColumn("_start", F.col("_from") + F.col("_start")))
        alone = held.where("dims = 0").withColumn("value", zero)
        told = bitstream.gather(stream, held.where("dims > 0"), "_start", "width", "value", frame, chunk).unionByName(alone)
        at, steps = F.call_function("shiftleft", F.lit(1), F.col("dims")), {}
        for k, a in reversed(list(enumerate(axes))):
            q = F.call_function("shiftrightunsigned", F.col("value"), at).bitwiseAND(F.lit((1 << STEP_BITS) - 1)).cast("int") - REACH
            steps[f"q_{a}"] = F.when(_bit("split", k), q).otherwise(0)
            at = F.when(_bit("split", k), at + STEP_BITS).otherwise(at)
        can = F.filter(F.transform(_children(d), lambda c, j: F.struct(c.cast("bigint").alias("c"), F.call_function("shiftrightunsigned", F.col("value"), j).bitwiseAND(F.lit(1).cast("bigint")).alias("on"))), lambda x: x["on"] == 1)
        told = told.withColumns(steps).withColumn("_kids", F.when(F.col("dims") > 0, F.transform(can, lambda x: x["c"])).otherwise(F.array().cast("array<bigint>")))
        told = cut(told.withColumns({f"pos_{a}": F.col(f"mid_{a}") + F.col(f"q_{a}") * F.col(f"unit_{a}") for a in axes}).withColumn("_n", F.size("_kids").cast("bigint")))
        leaves = told.where("_n = 0").select(frame, "node", *[F.col(f"pos_{a}").alias(a) for a in axes])
        out = leaves if out is None else out.unionByName(leaves)
        if told.where("_n > 0").isEmpty():
            return out
        ends = told.groupBy(frame).agg((F.max("_from") + F.sum("width")).alias("_end"))
        kids = prefix(told, "_n", "_first", frame).where("_n > 0").select("*", F.posexplode("_kids").alias("_j", "child")).join(ends, frame)
        nodes = kids.select(frame, (F.col("_first") + F.col("_j")).alias("k"), (F.shiftleft("node", d) + F.col("child")).alias("node"), F.col("_end").alias("_from"), *_halves(axes))


def leaves(symbols: DataFrame, frame: str = "frame", axes: Sequence[str] = AXES) -> DataFrame:
    """(frame, node, n, axes) of the nodes that end, as the encoder knows them."""
    return symbols.where("flag = 0").select(frame, "node", "n", *[F.col(f"pos_{a}").alias(a) for a in axes])


def errors(points: DataFrame, found: DataFrame, symbols: DataFrame, frame: str = "frame", axes: Sequence[str] = AXES) -> DataFrame:
    """(frame, points, leaves, worst): how far points (frame, axes) are from the decoded leaf on their way down the tree, on the worst axis.

    The way down is one join for each layer, from a point's node to the cut and the child that it says.
    """
    d = len(axes)
    now = points.where(G.finite([F.col(a) for a in axes])).select(frame, F.lit(1).cast("bigint").alias("node"), *axes)
    own, done = cut(symbols.select(frame, "node", "flag", "split", *[f"pos_{a}" for a in axes])), None
    for _ in range((symbols.agg(F.max("layer")).first()[0] or 0) + 1):
        met = cut(now.join(own, [frame, "node"]))
        here = met.where("flag = 0").select(frame, "node", *axes)
        done = here if done is None else done.unionByName(here)
        child = B.total([F.when(_bit("split", k) & (F.col(a) >= F.col(f"pos_{a}")), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, a in enumerate(axes)])
        now = met.where("flag != 0").select(frame, (F.shiftleft("node", d) + child).alias("node"), *axes)
    met = done.join(found.select(frame, "node", *[F.col(a).alias(f"_{a}") for a in axes]), [frame, "node"], "left")
    off = [F.coalesce(F.abs(F.col(a) - F.col(f"_{a}")), F.lit(float("inf"))) for a in axes]  # a leaf that was not decoded is infinitely far
    return met.groupBy(frame).agg(F.count(F.lit(1)).alias("points"), F.count_distinct("node").alias("leaves"), F.max(off[0] if d == 1 else F.greatest(*off)).alias("worst"))


def predicted(symbols: DataFrame, frame: str = "frame", axes: Sequence[str] = AXES) -> DataFrame:
    """symbols of nodes that can be cut, with context, seen, flag_guess, step_<axis>, hit, rest_<axis> and cost: what tables of the layers above foretell of a node, and what is left to tell.

    A node's context is its cuts and its own number among its parent's children. From the nodes of the same context in the frame's earlier layers (seen of them) come flag_guess, the most frequent
    flag (ties: the least; every child, if none was seen), and step_<axis>, their mean step to the nearest whole (0, if none). hit and rest_<axis> (the step less the one foretold) are the labels that are
    left; cost is the bits of the flag under one more than each flag's count. A decoder that goes layer by layer has the same tables.

    Tables have a row for each context, flag and layer, so that their joins are small however many nodes there are.
    """
    d = len(axes)
    own = symbols.where("dims > 0").withColumn("context", F.shiftleft("split", d) + F.col("node").bitwiseAND(F.lit((1 << d) - 1)))
    sums = [F.sum(f"q_{a}").alias(f"s_{a}") for a in axes]
    counts = cut(own.groupBy(frame, "context", "layer", "flag").agg(F.count(F.lit(1)).alias("m"), *sums))
    layers = counts.select(frame, "context", F.col("layer").alias("_layer")).distinct()
    flags = layers.join(counts, [frame, "context"]).where("layer < _layer").groupBy(frame, "context", "_layer", "flag").agg(F.sum("m").alias("m"), *[F.sum(f"s_{a}").alias(f"s_{a}") for a in axes])
    flags = cut(flags)
    best = F.max(F.struct("m", (-F.col("flag")).alias("f")))
    told = flags.groupBy(frame, "context", "_layer").agg(F.sum("m").alias("seen"), best.alias("_b"), *[F.floor(F.sum(f"s_{a}") / F.sum("m") + 0.5).cast("int").alias(f"step_{a}") for a in axes])
    told = told.select(frame, "context", F.col("_layer").alias("layer"), "seen", (-F.col("_b.f")).alias("_guess"), *[f"step_{a}" for a in axes])
    met = own.join(told, [frame, "context", "layer"], "left").join(flags.select(frame, "context", F.col("_layer").alias("layer"), "flag", F.col("m").alias("_m")), [frame, "context", "layer", "flag"], "left")
    every = F.aggregate(F.transform(_children(d), lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), c)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    zero = F.lit(0).cast("bigint")
    met = met.withColumns({"seen": F.coalesce("seen", zero), "flag_guess": F.coalesce("_guess", every), **{f"step_{a}": F.coalesce(f"step_{a}", F.lit(0)) for a in axes}})
    alphabet = F.pow(F.lit(2.0), F.pow(F.lit(2.0), F.col("dims")))
    cost = -F.log2((F.coalesce("_m", zero) + 1) / (F.col("seen") + alphabet))
    return met.withColumns({"hit": F.col("flag") == F.col("flag_guess"), "cost": cost, **{f"rest_{a}": F.col(f"q_{a}") - F.col(f"step_{a}") for a in axes}}).drop("_guess", "_m")
