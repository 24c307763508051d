"""Features and labels of tree nodes, and losses and metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from octarine.functions import bits as B
from octarine.operators import scans

AXES = ("x", "y", "z")


def child_bits(nodes: DataFrame, dim: int, width: int, by: Sequence[str] = ("frame", "layer")) -> DataFrame:
    """(by, node, k, features): of each child that a node could have, its path's bits as used - 2 * bit, used being whether any candidate of the layer has the bit."""
    kids = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit((1 << dim) - 1)))).withColumn("_id", F.shiftleft("node", dim) + F.col("k"))
    used = kids.groupBy(*by).agg(F.bit_or("_id").alias("_used"))
    bits = F.array(*[(B.bit(F.col("_used"), j) - 2 * B.bit(F.col("_id"), j)).cast("double") for j in range(width)])
    return kids.join(used, list(by)).select(*by, "node", "k", bits.alias("features"))


def pivots(nodes: DataFrame, k: int = 2, by: Sequence[str] = ("frame", "layer"), axes: Sequence[str] = AXES) -> DataFrame:
    """nodes (by, node, axes) with pivots: exp of minus the squared distance to each of the k nodes around in their order, none at the ends."""
    w = W.partitionBy(*by).orderBy("node")
    out = []
    for s in [s for s in range(-(k // 2), k // 2 + 1) if s]:
        shift = (lambda c, s=s: F.lead(c, s).over(w)) if s > 0 else (lambda c, s=s: F.lag(c, -s).over(w))
        square = B.total([F.pow(shift(F.col(a)) - F.col(a), 2) for a in axes])
        out.append(F.exp(-square))
    return nodes.withColumn("pivots", F.array(*out))


def circular_pivots(nodes: DataFrame, k: int = 2, by: Sequence[str] = ("frame", "layer"), axes: Sequence[str] = AXES) -> DataFrame:
    """candidate_centres() of nodes (by, node, axes, box_<axis>) with pivots: exp of minus the squared distance from the child's middle to each of the k nodes around its parent, in a circle over by in the order of node."""
    near = scans.around(nodes.withColumn("_p", F.struct(*axes)), "_p", k, by, "node", "_around").drop("_p")
    square = lambda p: B.total([(F.col(f"c_{a}") - p[a]) * (F.col(f"c_{a}") - p[a]) for a in axes])
    return candidate_centres(near, axes).withColumn("pivots", F.transform("_around", lambda p: F.exp(-square(p)))).drop("_around")


def permutation_bits(nodes: DataFrame, dim: int, width: int, p: str = "p", layer: str = "layer") -> DataFrame:
    """nodes with features: which of the word's bits the node's layer is made of, by the frame's permutation p (bit j of the sorted word is bit p[j]), as dim times width places of 0 and 1.

    Layers take the sorted word's bits from the lowest up; a place beyond the word is all zeros.
    """
    bit = lambda j: F.get(F.col(p), (F.col(layer) * dim + j).cast("int"))
    hot = [F.coalesce((bit(j) == k).cast("double"), F.lit(0.0)) for j in range(dim) for k in range(width)]
    return nodes.withColumn("features", F.array(*hot))


def ranks(nodes: DataFrame, by: Sequence[str] = ("frame", "layer"), axes: Sequence[str] = AXES) -> DataFrame:
    """nodes with rank_<axis>: the place of each in the order of that axis; ties: the lower node."""
    return nodes.withColumns({f"rank_{a}": F.row_number().over(W.partitionBy(*by).orderBy(a, "node")) for a in axes})


def labels(nodes: DataFrame, dim: int, size: int = 16) -> DataFrame:
    """nodes (flag) with label: the flag's bits, then one of size places set by the flag."""
    flags = [B.bit(F.col("flag"), k).cast("double") for k in range(1 << dim)]
    hot = [(F.col("flag") == k).cast("double") for k in range(size)]
    return nodes.withColumn("label", F.array(*flags, *hot))


def one_hot(label: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == label).cast("double"))


def row_normalize(values: Column) -> Column:
    """The array over its largest absolute value; zeros stay."""
    top = F.array_max(F.transform(values, F.abs))
    return F.transform(values, lambda v: F.coalesce(F.try_divide(v, top), F.lit(0.0)))


def focal_loss(truth: Column, predicted: Column, gamma: float = 5.0) -> Column:
    """Mean of -(1 - pt)^gamma ln pt, pt being the probability given to the truth."""
    pt = (1 - truth) - predicted * (1 - 2 * truth)
    return F.avg(-F.pow(1 - pt, F.lit(gamma)) * F.ln(pt))


def metrics(truth: Column, predicted: Column) -> list[Column]:
    """accuracy at 0.5, rmse and msle."""
    e = predicted - truth
    return [F.avg(((predicted >= 0.5).cast("int") == truth.cast("int")).cast("double")).alias("accuracy"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.pow(F.log1p(predicted) - F.log1p(truth), 2)).alias("msle")]


def combined(parts: Sequence[tuple[float, Column]]) -> Column:
    """A weighted sum of losses, each an aggregation over its own slice."""
    out = F.lit(0.0)
    for weight, loss in parts:
        out = out + weight * loss
    return out


def sliced(values: Column, start: int, length: int, metric) -> Column:
    """A metric over part of an array: metric gets the slice (start from 0) and gives an aggregation."""
    return metric(F.slice(values, start + 1, length))


def candidate_centres(nodes: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """nodes (axes: a box's middle, box_<axis>: its half sides) with a row and k for each of the two to the axes children: c_<axis> is the child's middle."""
    kids = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit((1 << len(axes)) - 1))))
    side = lambda j: F.when(F.shiftright("k", j).bitwiseAND(1) == 1, 0.5).otherwise(-0.5)
    return kids.withColumns({f"c_{a}": F.col(a) + side(j) * F.col(f"box_{a}") for j, a in enumerate(axes)})


def halves_of(values: Column) -> Column:
    """The positive parts of an array of numbers, then the sizes of its negative ones."""
    return F.concat(F.transform(values, lambda v: F.greatest(v, F.lit(0.0))), F.transform(values, lambda v: F.greatest(-v, F.lit(0.0))))


def box_features(nodes: DataFrame, width: int, by: Sequence[str] = ("frame", "layer"), axes: Sequence[str] = AXES) -> DataFrame:
    """nodes (node, axes, box_<axis>) with features: the middle, the box, the path's bits as 1 and -1, and the place in the order of each axis."""
    placed = ranks(nodes, by, axes)
    bits = [(2 * B.bit(F.col("node"), k) - 1).cast("double") for k in range(width)]
    return placed.withColumn("features", F.array(*[F.col(a) for a in axes], *[F.col(f"box_{a}") for a in axes], *bits, *[F.col(f"rank_{a}").cast("double") for a in axes]))


def mean_labels(nodes: DataFrame, dim: int, axes: Sequence[str] = AXES, size: int = 16) -> DataFrame:
    """labels() with the mean's distance from the middle, in half boxes, after them: (mean_<axis> - axis) / box_<axis>."""
    rest = [F.coalesce(F.try_divide(F.col(f"mean_{a}") - F.col(a), F.col(f"box_{a}")), F.lit(0.0)) for a in axes]
    return labels(nodes, dim, size).withColumn("label", F.concat("label", F.array(*rest)))


def dataset(rows: DataFrame, features: str, label: str, by: Sequence[str] = ("frame", "layer"), order: str = "node", most: int = 4096) -> DataFrame:
    """(by, batch, features, labels): rows in their order as arrays, at most so many to a batch, for a trainer that reads the table."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
    got = rows.withColumn("_k", k).withColumn("batch", F.floor(F.col("_k") / most))
    both = F.sort_array(F.collect_list(F.struct("_k", F.col(features).alias("f"), F.col(label).alias("l"))))
    return got.groupBy(*by, "batch").agg(both.alias("_r")).select(*by, "batch", F.col("_r.f").alias("features"), F.col("_r.l").alias("labels"))


def places(rows: DataFrame, by: Sequence[str], order: str, start: float | None = None, stop: float | None = None) -> DataFrame:
    """rows with place: 0 to n - 1 in their order, or as many even steps from start to before stop."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
    if start is None or stop is None:
        return rows.withColumn("place", k.cast("double"))
    return rows.withColumn("place", F.lit(float(start)) + k * (F.lit(float(stop - start)) / F.count(F.lit(1)).over(W.partitionBy(*by))))


def append_metrics(metrics_: DataFrame, path: str, epoch: int) -> None:
    """Adds an epoch's metrics to a table: a folder for each epoch, which a repeated run overwrites."""
    metrics_.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
