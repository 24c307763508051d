"""Frames as files: a data source that writes .bin, .npy, .ply and .pcd, a file for each frame, all of a job's or none.

Tasks write into a staging folder under names of their own attempt; the commit moves the files of the attempts that count into place, an abort deletes the folder. Names that begin with
an underscore are skipped by Spark's file readers, so a job that was killed leaves nothing that is read.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

import numpy as np
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from octarine.sources.pointfiles import COLUMNS, FORMATS

FORMAT = "octarine_points"
#: Bytes of a frame that a task holds in memory; what is more goes to its own temporary file until the frame ends.
HELD = 64 << 20
#: Rows that are turned into bytes at once.
ROWS = 65_536


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: (staged, final) paths."""

    files: list[tuple[str, str]]


def header(kind: str, n: int, width: int, ascii: bool = False) -> bytes:
    """What stands before n rows of so many 32-bit floats."""
    names = (*COLUMNS[:3], "intensity")[:width]
    if kind == "npy":
        text = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({n}, {width}), }}"
        text += " " * (-(len(text) + 11) % 64) + "\n"
        return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text.encode("latin-1")
    if kind == "ply":
        lines = ["ply", f"format {'ascii' if ascii else 'binary_little_endian'} 1.0", f"element vertex {n}", *[f"property float {a}" for a in names], "end_header", ""]
        return "\n".join(lines).encode()
    if kind == "pcd":
        fields = [("FIELDS", names), ("SIZE", "4" * width), ("TYPE", "F" * width), ("COUNT", "1" * width), ("WIDTH", [n]), ("HEIGHT", [1]), ("VIEWPOINT", "0001000"), ("POINTS", [n]), ("DATA", ["ascii" if ascii else "binary"])]
        return "\n".join(["# .PCD v0.7", "VERSION 0.7", *[f"{a} {' '.join(map(str, b))}" for a, b in fields], ""]).encode()
    return b""


def body(rows: np.ndarray, ascii: bool = False) -> bytes:
    rows = np.ascontiguousarray(rows, "<f4")
    return "".join(" ".join(map(str, r)) + "\n" for r in rows.tolist()).encode() if ascii else rows.tobytes()


class PointWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.kind = options.get("path"), options.get("kind", "bin")
        if not self.path:
            raise ValueError("no path to write to")
        if self.kind not in FORMATS:
            raise ValueError(f"unknown format: {self.kind}")
        self.ascii = str(options.get("ascii", "false")).lower() == "true"
        if self.ascii and self.kind not in ("ply", "pcd"):
            raise ValueError(f"{self.kind} has no text form")
        self.frame = options.get("frame", "frame")
        axes = options.get("axes")
        self.axes = axes.split(",") if axes else [c for c in COLUMNS if c in schema.names]
        missing = [c for c in (self.frame, *self.axes) if c not in schema.names]
        if missing or not self.axes:
            raise ValueError(f"no such columns: {missing or 'axes'}")
        if len(self.axes) > len(COLUMNS):
            raise ValueError(f"a point has {len(COLUMNS)} columns at most")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _place(self) -> tuple[pyarrow.fs.FileSystem, str]:
        """The file system and the folder: any that pyarrow opens by its address, else a path that all executors share."""
        if "://" in self.path or self.path.startswith("file:"):
            return pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:", "file://", 1))
        return pyarrow.fs.LocalFileSystem(), self.path

    def _staging(self, folder: str) -> str:
        return f"{folder.rstrip('/')}/_staging-{self.job}"

    def write(self, rows: Iterator) -> Written:
        fs, folder = self._place()
        attempt, files = uuid.uuid4().hex, []
        fs.create_dir(self._staging(folder), recursive=True)
        for name, own in groupby(rows, key=lambda r: r[self.frame]):
            if name is None:
                raise ValueError("a point has no frame")
            final = f"{folder.rstrip('/')}/{quote(str(name), safe='')}.{self.kind}"
            if files and final in (f for _, f in files):
                raise ValueError("a frame's points must come together: sort by frame, as write() does")
            staged = f"{self._staging(folder)}/{attempt}-{len(files)}"
            self._one(fs, staged, own)
            files.append((staged, final))
        return Written(files)

    def _one(self, fs: pyarrow.fs.FileSystem, path: str, rows: Iterator) -> None:
        """A frame: its rows are laid aside until their number is known, which the header tells."""
        n, some = 0, []
        with tempfile.SpooledTemporaryFile(HELD) as aside:
            for r in rows:
                some.append([np.nan if r[a] is None else r[a] for a in self.axes])
                n += 1
                if len(some) == ROWS:
                    aside.write(body(np.array(some), self.ascii))
                    some = []
            if some:
                aside.write(body(np.array(some), self.ascii))
            aside.seek(0)
            with fs.open_output_stream(path) as out:
                out.write(header(self.kind, n, len(self.axes), self.ascii))
                while data := aside.read(1 << 20):
                    out.write(data)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = self._place()
        files = [f for m in messages if m for f in m.files]
        finals = [final for _, final in files]
        try:
            if len(set(finals)) < len(finals):
                raise ValueError("a frame was written by two tasks: partition by frame, as write() does")
            if self.overwrite:
                for old in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
                    if old.is_file and old.path.rsplit(".", 1)[-1] in FORMATS and not old.base_name.startswith(("_", ".")):
                        fs.delete_file(old.path)
            else:
                taken = [i.path for i in fs.get_file_info(finals) if i.type != pyarrow.fs.FileType.NotFound] if finals else []
                if taken:
                    raise FileExistsError(f"{len(taken)} frames are there already, such as {taken[0]}")
            for staged, final in files:
                fs.move(staged, final)
        finally:
            self._clear(fs, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._place())

    def _clear(self, fs: pyarrow.fs.FileSystem, folder: str) -> None:
        if fs.get_file_info(self._staging(folder)).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(self._staging(folder))


class PointSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PointWriter:
        return PointWriter(self.options, schema, overwrite)


def write(points: DataFrame, path: str, kind: str = "bin", axes: Sequence[str] | None = None, frame: str = "frame", order: str = "point_id", mode: str = "append", ascii: bool = False) -> None:
    """A file for each frame under path, named by it (with % signs for what a name can't hold), its points in their order: .bin, .npy, .ply or .pcd; ascii: the text form of the last two.

    axes: up to four columns, else those of x, y, z, i that are there; nulls are written as NaN. mode: append, where a frame that is there already is an error, or overwrite,
    which takes the place of the point files of any of these formats in the folder. All files appear, or none; frames without points have none. path is an address that pyarrow can open, or a folder that all executors share.
    """
    points.sparkSession.dataSource.register(PointSink)
    used = list(axes) if axes is not None else [c for c in COLUMNS if c in points.columns]
    rows = points.select(frame, order, *[points[a].cast("double").alias(a) for a in used]).repartition(frame).sortWithinPartitions(frame, order).drop(order)
    told = rows.write.format(FORMAT).mode(mode).option("kind", kind).option("axes", ",".join(used)).option("frame", frame).option("ascii", str(ascii))
    told.save(path)


def convert(points: DataFrame, path: str, kind: str, intensity: bool = True, ascii: bool = False, mode: str = "append") -> None:
    """Frames that were read from files of one format as files of another, named as they were; with or without the fourth column."""
    from pyspark.sql import functions as F

    name = F.regexp_replace(F.element_at(F.split("frame", "/"), -1), r"\.[^.]*$", "")
    write(points.withColumn("frame", name), path, kind, COLUMNS if intensity else COLUMNS[:3], mode=mode, ascii=ascii)
