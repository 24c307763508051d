"""Point-cloud files as DataFrames: raw floats, NumPy arrays and PLY, by Spark's own file readers."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("x", "y", "z", "i")
#: PLY's names of number types.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
FORMATS = ("bin", "npy", "ply", "pcd")


def decode(data: bytes, kind: str, width: int = 4, dtype: str = "<f4") -> np.ndarray:
    """A file's rows; trailing bytes that make no whole row of a raw file are dropped."""
    if kind == "npy":
        return np.load(io.BytesIO(data), allow_pickle=False)
    if kind == "ply":
        return _ply(data)
    if kind == "pcd":
        return _pcd(data)
    if kind == "bin":
        row = np.dtype(dtype).itemsize * width
        return np.frombuffer(data[: len(data) // row * row], dtype).reshape(-1, width)
    raise ValueError(f"unknown format: {kind}")


def _ply(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b"end_header\n")
    lines = head.decode("ascii").split("\n")
    n = next(int(x.split()[2]) for x in lines if x.startswith("element vertex"))
    fields = [(x.split()[2], PLY_TYPES[x.split()[1]]) for x in lines if re.match(r"property (?!list)", x)]
    if "format ascii 1.0" in lines:
        return np.array([x.split() for x in body.decode("ascii").split("\n")[:n]], float).reshape(n, len(fields))
    order = "<" if "format binary_little_endian 1.0" in lines else ">"
    rows = np.frombuffer(body, np.dtype([(a, order + t) for a, t in fields]), n)
    return np.stack([rows[a].astype(float) for a, _ in fields], 1) if n else np.zeros((0, len(fields)))


def _pcd(data: bytes) -> np.ndarray:
    """A .pcd file's rows, of ascii or binary data; a field of several numbers gives as many columns."""
    at = data.index(b"\n", data.index(b"\nDATA ") + 1) + 1
    head = {x.split()[0]: x.split()[1:] for x in data[:at].decode("ascii").split("\n") if x and not x.startswith("#")}
    counts = list(map(int, head.get("COUNT", ["1"] * len(head["FIELDS"]))))
    types = [{"F": "f", "I": "i", "U": "u"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    n = int(head["POINTS"][0])
    if head["DATA"] == ["ascii"]:
        return np.array(data[at:].split(), float).reshape(n, sum(counts))
    if head["DATA"] != ["binary"]:
        raise ValueError("compressed .pcd files are not read")
    rows = np.frombuffer(data[at:], np.dtype([(f"c{k}", "<" + t, (c,)) for k, (t, c) in enumerate(zip(types, counts, strict=True))]), n)
    return np.concatenate([rows[f"c{k}"].astype(float) for k in range(len(types))], 1) if n else np.zeros((0, sum(counts)))


def encode(rows: np.ndarray, kind: str) -> bytes:
    """The rows as a file of 32-bit floats; PLY is little-endian."""
    rows = np.ascontiguousarray(rows, "<f4")
    if kind == "bin":
        return rows.tobytes()
    if kind == "npy":
        out = io.BytesIO()
        np.save(out, rows)
        return out.getvalue()
    if kind == "ply":
        names = ("x", "y", "z", "intensity")[: rows.shape[1]]
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *[f"property float {a}" for a in names], "end_header", ""]
        return "\n".join(head).encode() + rows.tobytes()
    if kind == "pcd":
        names, k = ("x", "y", "z", "intensity")[: rows.shape[1]], rows.shape[1]
        head = ["# .PCD v0.7", "VERSION 0.7", f"FIELDS {' '.join(names)}", f"SIZE {' '.join('4' * k)}", f"TYPE {' '.join('F' * k)}", f"COUNT {' '.join('1' * k)}", f"WIDTH {len(rows)}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(rows)}", "DATA binary", ""]
        return "\n".join(head).encode() + rows.tobytes()
    raise ValueError(f"unknown format: {kind}")


def _parsed(files: DataFrame, width: int, dtype: str, keep: int) -> DataFrame:
    names = COLUMNS[:keep]
    schema = T.StructType([T.StructField("frame", T.StringType()), T.StructField("point_id", T.LongType()), *[T.StructField(a, T.DoubleType()) for a in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                rows = decode(bytes(data), path.rsplit(".", 1)[-1].lower(), width, dtype)[:, :keep].astype(float)
                yield pd.DataFrame({"frame": path, "point_id": np.arange(len(rows)), **{a: rows[:, k] for k, a in enumerate(names)}})

    return files.select("path", "content").mapInPandas(run, schema)


def read(spark: SparkSession, paths: str | Sequence[str], width: int = 4, dtype: str = "<f4", keep: int = 4, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(frame, point_id, x, y, z, i): each file is a frame; the format follows its name (.bin, .npy, .ply).

    paths may hold wildcards; point_id is the order within the file. A file is read whole, as one scan is.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = files.option("pathGlobFilter", glob) if glob else files
    return _parsed(files.load(paths), width, dtype, keep)


def read_index(spark: SparkSession, index: str, root: str, take: int | None = None, seed: int | None = None, **options) -> DataFrame:
    """Frames that an index (a text file of one path a line, under root) names; blank lines don't count.

    take: the first so many lines by name, or so many by a seeded shuffle. The names reach the driver, as every list of files to read does,
    and just those files are read; one that isn't there is an error.
    """
    lines = spark.read.text(index).where(F.trim("value") != "").select(F.trim("value").alias("name")).distinct()
    lines = lines.orderBy(F.xxhash64("name", F.lit(seed)), "name") if seed is not None else lines.orderBy("name")
    names = [r.name for r in (lines.limit(take) if take is not None else lines).collect()]
    width, dtype, keep = options.get("width", 4), options.get("dtype", "<f4"), options.get("keep", 4)
    if not names:
        return _parsed(spark.createDataFrame([], "path string, content binary"), width, dtype, keep)
    return _parsed(spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{n.lstrip('/')}" for n in names]), width, dtype, keep)


def as_files(points: DataFrame, kind: str, axes: Sequence[str] = COLUMNS, frame: str = "frame", order: str = "point_id") -> DataFrame:
    """(frame, content): each frame as the bytes of one file, for a sink that stores them. A frame is one task's."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    schema = T.StructType([points.schema[frame], T.StructField("content", T.BinaryType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({frame: [key[0]], "content": [encode(pdf.sort_values(order)[list(axes)].to_numpy(), kind)]})

    return points.select(frame, order, *axes).groupBy(frame).applyInPandas(run, schema)


def convert(spark: SparkSession, paths: str | Sequence[str], kind: str, intensity: bool = True, **options) -> DataFrame:
    """(frame, content): files of one format as those of another."""
    return as_files(read(spark, paths, **options), kind, COLUMNS if intensity else COLUMNS[:3])


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """(t, epoch, value) of a metric's CSV with a header line."""
    return spark.read.csv(path, header=True, schema="t double, epoch double, value double")


def stream_header(radius: float, box: Sequence[float], offset: Sequence[float]) -> bytes:
    """The fixed header of a radius tree's stream: big-endian 32-bit floats."""
    return struct.pack(f">{1 + len(box) + len(offset)}f", radius, *box, *offset)


def write_headers(headers: DataFrame, path: str) -> None:
    """Headers as Parquet: types and lists stay, and nothing is run when they are read."""
    headers.write.mode("overwrite").parquet(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
