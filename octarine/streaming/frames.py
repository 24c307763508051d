"""Frames as they arrive: stateless encoding of a file stream, and differences to the frame before kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from octarine.operators import ntree


def point_stream(spark: SparkSession, path: str, schema: str = "frame string, x double, y double, z double", files: int = 1) -> DataFrame:
    """Points of Parquet files as they are added; so many files to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def encode_stream(codes: DataFrame, dims: list[int], width: int, out: str, checkpoint: str) -> StreamingQuery:
    """Symbols of each batch of codes (frame, code) as Parquet, in a folder of its own: a frame comes whole within one batch, so nothing is kept.

    A batch that is run again after a failure overwrites its folder, so no symbol is written twice; batch is the partition column.
    """

    def put(batch: DataFrame, number: int) -> None:
        ntree.symbols(batch.select("frame", "code").distinct(), dims, width).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return codes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def differential_stream(symbols: DataFrame) -> DataFrame:
    """(stream, frame_no, layer, parent, delta) of streamed symbols (stream, frame_no, layer, parent, flag): flag xor that of the same node in the frame before.

    The state of a node is its last frame and flag: as small as the tree is, however long the stream. A frame that
    comes after a later one is told by null: it neither gets a difference nor changes the state.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, flag = state.get if state.exists else (-2, 0)
        rows = []
        for r in pd.concat(parts).sort_values("frame_no").itertuples():
            if r.frame_no <= frame:
                rows.append((key[0], r.frame_no, key[1], key[2], None))
                continue
            rows.append((key[0], r.frame_no, key[1], key[2], r.flag ^ (flag if r.frame_no == frame + 1 else 0)))
            frame, flag = r.frame_no, r.flag
        state.update((int(frame), int(flag)))
        yield pd.DataFrame(rows, columns=["stream", "frame_no", "layer", "parent", "delta"]).astype({"delta": "Int64"})

    out = "stream string, frame_no long, layer int, parent long, delta long"
    return symbols.groupBy("stream", "layer", "parent").applyInPandasWithState(run, out, "frame_no long, flag long", "append", GroupStateTimeout.NoTimeout)
