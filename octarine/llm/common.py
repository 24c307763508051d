"""What the training-data operators share: reading, checkpoints, Arrow batches and components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters and the letters that are lower-cased.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set: a temporary one in local mode, as in tests; else an error, as executors could not read it."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: the lineage ends here, in files that all executors can read."""
    checkpoint_dir(df.sparkSession)
    # A checkpoint keeps the planner's guess of its size, and a join's is the product of its sides': over iterated joins the number
    # doubles its digits with each round, until it fills the driver. So the rows are taken up anew, without a guess.
    done, spark = df.checkpoint(eager=True), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds what Python workers hold: whole texts come by this many rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(df: DataFrame, n: int) -> list[str]:
    """Names that no column of df has, in either case of its letters."""
    return [f"_{uuid.uuid4().hex}_{k}" for k in range(n)]


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: a Python worker outlives its task."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: an expression used within lambdas is otherwise computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _seen(edges: DataFrame) -> tuple:
    """Number and an order-free hash of the edges, to see whether a round changed any."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of the undirected long pairs in the columns a and b; component is the least node reachable.

    Large-star and small-star rounds in turn, until neither changes an edge. Each node's least neighbour is a partial
    aggregation, and the edges meet it in a join, so a hub's edges can be split over tasks. Self-loops give a component
    of one node; repeated edges and edges with a null end count once or not at all; no edges give no rows. Each round
    ends in a checkpoint. Only a hash of the edges reaches the driver.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    pairs = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut(pairs.distinct())
    before = _seen(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        now = cut(_star(now, large=True))
        now = cut(_star(now, large=False))
        after = _seen(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b"))
    return found.union(loops.select("node", "node")).groupBy("node").agg(F.min("component").alias("component"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (a, b) with a > b. The least neighbours are written first: then both sides of the join are exchanged, and a hub's edges can be split."""
    least = cut(edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
    if large:  # every larger neighbour of a node goes to the node's least neighbour, or to the node itself
        return edges.join(least, edges.b == least.n, "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
    down = edges.join(least, edges.a == least.n).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("n", "m")).distinct()
