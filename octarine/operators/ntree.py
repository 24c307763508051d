"""N-bit trees: codes cut into layers, and each layer's nodes aggregated into symbols."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from octarine.functions import bits as B
from octarine.functions.lineage import cut

MOST_DIM = 6


def plan_dims(dims: Sequence[int], width: int) -> list[int]:
    """The dimension of each layer until the word is used up; the last given is repeated, and the last layer cut to what is left.

    A layer uses max(dim, 1) bits. No dims are zeros throughout. More than MOST_DIM, or a dimension of 0 or less after one above 0, is an error.
    """
    dims = list(dims) or [0]
    if max(dims) > MOST_DIM:
        raise ValueError(f"a dimension is at most {MOST_DIM}")
    if any(a > 0 >= b for a, b in zip(dims, dims[1:], strict=False)):
        raise ValueError("no dimension of 0 or less after one above 0")
    out, left = [], width
    while left > 0:
        d = dims[min(len(out), len(dims) - 1)]
        d = min(d, left) if d > 0 else d
        out.append(d)
        left -= max(d, 1)
    return out


def tokenize(codes: DataFrame, dims: Sequence[int], width: int, keep: Sequence[str] = ("frame",)) -> DataFrame:
    """(keep, code, layer, dim, parent, child) for each code and layer: parent is the code's bits above the layer, child those of it."""
    layers, used = [], 0
    for k, d in enumerate(plan_dims(dims, width)):
        step = max(d, 1)
        used += step
        parent, child = F.shiftright("code", width - used + step), F.shiftright("code", width - used).bitwiseAND(F.lit(B.mask(step)).cast("bigint"))
        if width - used + step > 62:
            parent = F.lit(0).cast("bigint")
        layers.append(F.struct(F.lit(k).alias("layer"), F.lit(d).alias("dim"), parent.alias("parent"), child.alias("child")))
    return codes.select(*keep, "code", F.explode(F.array(*layers)).alias("_t")).select(*keep, "code", "_t.*")


def symbols(codes: DataFrame, dims: Sequence[int], width: int, by: Sequence[str] = ("frame",)) -> DataFrame:
    """(by, layer, dim, parent, flag, children, n): the occupancy of each node; codes are taken as distinct.

    A partial aggregation, then one exchange on (by, layer, parent): the few nodes of upper layers are merged before it.
    """
    tokens = tokenize(codes, dims, width, by)
    at = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("child").cast("int"))
    nodes = tokens.groupBy(*by, "layer", "dim", "parent").agg(F.bit_or(at).alias("flag"), F.count(F.lit(1)).alias("n"))
    return nodes.select(*by, "layer", "dim", "parent", "flag", F.bit_count("flag").cast("bigint").alias("children"), "n")


def histogram(codes: DataFrame, dims: Sequence[int], width: int, by: Sequence[str] = ("frame",)) -> DataFrame:
    """(by, layer, parent, child, n)."""
    return tokenize(codes, dims, width, by).groupBy(*by, "layer", "parent", "child").agg(F.count(F.lit(1)).alias("n"))


def expand(nodes: DataFrame, flags: DataFrame, dim: int, by: Sequence[str] = ("frame",)) -> DataFrame:
    """(by, node): the children of one layer's nodes, from flags (by, parent, flag)."""
    own = flags.select(*[F.col(c).alias(f"_{c}") for c in by], "parent", "flag")
    met = nodes.join(own, reduce(lambda a, b: a & b, [nodes[c].eqNullSafe(F.col(f"_{c}")) for c in by], nodes.node == own.parent))
    child = F.filter(F.sequence(F.lit(0), F.lit((1 << dim) - 1)), lambda k: F.call_function("bit_get", F.col("flag"), k) == 1)
    return met.select(*by, "node", F.explode(child).alias("_k")).select(*by, (F.shiftleft("node", dim) + F.col("_k")).alias("node"))


def decode(symbols_: DataFrame, dims: Sequence[int], width: int, by: Sequence[str] = ("frame",)) -> DataFrame:
    """(by, code) from the occupancy symbols, layer by layer from the roots."""
    plan = plan_dims(dims, width)
    nodes = symbols_.where("layer = 0").select(*by, F.col("parent").alias("node")).distinct()
    for k, d in enumerate(plan):
        nodes = expand(nodes, symbols_.where(F.col("layer") == k), max(d, 1), by)
    return nodes.withColumnRenamed("node", "code")


def bit_cost(symbols_: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """(by, bits): what occupancy symbols take, two to the dimension for each node."""
    return symbols_.groupBy(*by).agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("dim"))).alias("bits"))


def halves(codes: DataFrame, width: int, pattern: Column | None = None, by: Sequence[str] = ("frame",)) -> DataFrame:
    """(by, layer, parent, n, minor, major): binary nodes, and how many of their codes have the bit that is not the pattern's."""
    tokens = tokenize(codes, [1], width, by)
    common = F.lit(0).cast("bigint") if pattern is None else pattern
    at = F.call_function("shiftrightunsigned", common, F.lit(width - 1) - F.col("layer")).bitwiseAND(F.lit(1).cast("bigint"))
    is_minor = (F.col("child") != at).cast("bigint")
    got = tokens.groupBy(*by, "layer", "parent").agg(F.count(F.lit(1)).alias("n"), F.sum(is_minor).alias("minor"))
    return got.withColumn("major", F.col("n") - F.col("minor"))


def counter_symbols(nodes: DataFrame) -> DataFrame:
    """nodes of halves() with symbol (the minor count) and width (binary digits of the node's count)."""
    return nodes.withColumns({"symbol": F.col("minor"), "width": B.bit_length(F.col("n"))})


def overflow_symbols(nodes: DataFrame) -> DataFrame:
    """nodes of halves() with symbol and width: b bits hold a minor count below cap = 2^b - 1, else cap and then the major count.

    b is one less than the binary digits of the count, 1 at the least for a count of 1. Where both are at the cap
    or above and the count is odd, one more bit tells whether the minor count is the larger.
    """
    b = F.greatest(B.bit_length(F.col("n")) - 1, F.lit(0))
    pow2 = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
    cap = pow2(b) - 1
    small = F.col("minor") < cap
    both = (F.col("major") >= cap) & (F.col("n") % 2 == 1)
    pair = cap * pow2(b) + F.least("major", cap)
    one = F.col("n") == 1
    symbol = F.when(one, F.col("minor")).when(small, F.col("minor")).when(both, pair * 2 + (F.col("minor") > F.col("major")).cast("bigint")).otherwise(pair)
    width = F.when(one, 1).when(small, b).when(both, 2 * b + 1).otherwise(2 * b)
    return nodes.withColumns({"symbol": symbol, "width": width.cast("int")})


def payload(codes: DataFrame, dims: Sequence[int], width: int, by: Sequence[str] = ("frame",)) -> DataFrame:
    """(by, code, layer, tail_bits, tail): codes that are alone in a node from some layer on, and the bits below it.

    layer is the first whose node holds that code only: no further symbols are needed there, and the tail is written as
    it is. Codes that never are alone have no row.
    """
    plan = plan_dims(dims, width)
    used = [sum(max(d, 1) for d in plan[: k + 1]) for k in range(len(plan))]
    tokens = tokenize(codes, dims, width, by).withColumn("node", F.struct("parent", "child"))
    sizes = tokens.groupBy(*by, "layer", "node").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("code")).where("n = 1")
    first = sizes.groupBy(*by, "code").agg(F.min("layer").alias("layer"))
    tail = F.element_at(F.array(*[F.lit(width - u) for u in used]), F.col("layer") + 1)
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("tail_bits")) - 1
    return first.withColumn("tail_bits", tail).withColumn("tail", F.col("code").bitwiseAND(low))


def differential(symbols_: DataFrame, frame: str = "frame_no") -> DataFrame:
    """symbols (frame, layer, parent, flag) with delta: flag xor that of the same node in the frame before; none is 0."""
    before = symbols_.select((F.col(frame) + 1).alias(frame), "layer", "parent", F.col("flag").alias("_before"))
    return symbols_.join(before, [frame, "layer", "parent"], "left").withColumn("delta", F.col("flag").bitwiseXOR(F.coalesce("_before", F.lit(0).cast("bigint")))).drop("_before")


def undo_differential(first: DataFrame, deltas: DataFrame) -> DataFrame:
    """Flags of a frame (layer, parent, flag), from those of the frame before and its own deltas (layer, parent, delta)."""
    before = first.select("layer", "parent", F.col("flag").alias("_before"))
    return deltas.join(before, ["layer", "parent"], "left").select("layer", "parent", F.col("delta").bitwiseXOR(F.coalesce("_before", F.lit(0).cast("bigint"))).alias("flag"))


def permutation(codes: DataFrame, width: int, frame: str = "frame", depth: int | None = None, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(frame, layer, node, choice, n, ones): trees that split each node at its most skewed bit that is left; choice is that bit.

    A loop over layers, each a partial aggregation of bit counts by node and a join back; cut writes a checkpoint
    after each. Ties: the lowest bit. Nodes of one code, or without bits left, end.
    """
    if (depth or width) > 62:
        raise ValueError("a node's path of more than 62 bits does not fit a long")
    one = F.lit(1).cast("bigint")
    at = lambda v, k: F.call_function("shiftrightunsigned", v, k).bitwiseAND(one)
    now = codes.select(frame, "code", one.alias("node"), F.lit(0).cast("bigint").alias("used"))
    out = None
    for _ in range(depth or width):  # nothing in a round depends on its number, so that its code is compiled once
        free = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: at(F.col("used"), k) == 0)
        sums = now.select(frame, "node", "code", F.bit_count("used").alias("layer"), F.explode(free).alias("bit")).groupBy(frame, "node", "layer", "bit").agg(F.count(F.lit(1)).alias("n"), F.sum(at(F.col("code"), F.col("bit"))).alias("ones")).where("n > 1")
        best = F.max(F.struct(F.greatest(F.col("ones"), F.col("n") - F.col("ones")).alias("w"), (-F.col("bit")).alias("b"), "ones", "n"))
        chosen = sums.groupBy(frame, "node", "layer").agg(best.alias("_b")).select(frame, "layer", "node", (-F.col("_b.b")).alias("choice"), F.col("_b.n").alias("n"), F.col("_b.ones").alias("ones"))
        now = cut(now.drop("layer", "above", "choice", "n", "ones").withColumnRenamed("node", "above").join(chosen.withColumnRenamed("node", "above"), [frame, "above"]).withColumn("node", F.col("above") * 2 + at(F.col("code"), F.col("choice"))).withColumn("used", F.col("used").bitwiseOR(F.call_function("shiftleft", one, F.col("choice")))))
        found = now.select(frame, "layer", F.col("above").alias("node"), "choice", "n", "ones").distinct()
        out = found if out is None else out.unionByName(found)
        if now.isEmpty():
            break
    return out


def running_position(symbols_: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """symbols with start: the bit at which each stands in its frame's stream, in the order of (layer, parent)."""
    before = W.partitionBy(*by).orderBy("layer", "parent").rowsBetween(W.unboundedPreceding, -1)
    return symbols_.withColumn("start", F.coalesce(F.sum(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("dim"))).over(before), F.lit(0)))
