"""Ends long lineages of iterated plans, in the folder that the cluster shares, and numbers rows in a global order."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def checkpoint_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where none is set: a temporary folder in local mode, as in tests; else an error, as executors could not read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    # A checkpoint keeps the planner's guess of its size, and a join's is the product of its sides': over iterated joins the number
    # doubles its digits with each round, until it fills the driver. So the rows are taken up anew, without a guess.
    done, spark = df.checkpoint(eager=True), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


#: Tasks that the rows of one key are dealt to by spread().
PARTS = 64


def spread(rows: DataFrame, small: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """rows joined with small, which has a row for each key, where a key can have any number of rows: they are dealt to so many parts by a hash of their plain columns, and small has a row for each.

    The planner still broadcasts small if it turns out so; if not, or not before rows are exchanged, no task reads all rows of a key.
    """
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(parts)).cast("int"))
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies, [key, "_part"]).drop("_part")


def numbered(df: DataFrame, keys: Sequence[str], name: str = "number") -> DataFrame:
    """df with its rows' places from 0, in the order of the keys: a range sort, and the sizes of its partitions, which alone reach the driver."""
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, so_far = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r.part, so_far))
        so_far += r.n
    known = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return placed.withColumn("_part", part).join(known, "_part").withColumn(name, F.col("_before") + within).drop("_part", "_before", "_at")


#: Rows of a block of prefix(): the most that one window holds.
BLOCK = 1 << 16


def prefix(df: DataFrame, value: str, name: str, frame: str = "frame", at: str = "k", block: int = BLOCK) -> DataFrame:
    """df with name: the sum of the value over the frame's rows before, in the order of the places 0, 1, ... in at.

    Blocks of places are summed first, and the sums before a block come from its frame's other blocks: a window holds a block's rows or a frame's blocks, never a frame's rows.
    """
    own = df.withColumn("_block", F.floor(F.col(at) / F.lit(block)))
    sums = own.groupBy(frame, "_block").agg(F.sum(value).alias("_sum"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(frame).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = F.coalesce(F.sum(value).over(W.partitionBy(frame, "_block").orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_within", within).join(offsets, [frame, "_block"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_block", "_before", "_within")


def placed(df: DataFrame, order: Sequence[str], frame: str = "frame", name: str = "k") -> DataFrame:
    """df with the rows' places within their frame, from 0, in the order given. Frames can be of any size: rows are numbered over the whole table, less where their frame begins."""
    rows = cut(numbered(df, [frame, *order], "_number"))
    first = rows.groupBy(frame).agg(F.min("_number").alias("_first"))
    return rows.join(first, frame).withColumn(name, F.col("_number") - F.col("_first")).drop("_number", "_first")
