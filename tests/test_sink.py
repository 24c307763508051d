"""Frames written as files: read back, all or none."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from octarine.sources import pointfiles, sink


def points(spark, n=200, frames=("a", "b/ü", "c.1")):
    r = random.Random(1)
    rows = [(f, k, *[float(np.float32(r.uniform(-5, 5))) for _ in range(4)]) for f in frames for k in range(n)]
    return spark.createDataFrame(rows, "frame string, point_id long, x double, y double, z double, i double").repartition(6)


def names(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("."))


@pytest.mark.parametrize("kind, ascii", [("bin", False), ("npy", False), ("ply", False), ("ply", True), ("pcd", False), ("pcd", True)])
def test_write_and_read_back(spark, tmp_path, kind, ascii):
    df = points(spark)
    sink.write(df, str(tmp_path / "out"), kind, ascii=ascii)
    assert names(tmp_path / "out") == sorted(f"{f}.{kind}" for f in ("a", "b%2F%C3%BC", "c.1"))
    back = pointfiles.read(spark, str(tmp_path / "out"))
    frame = F.regexp_replace(F.element_at(F.split("frame", "/"), -1), rf"\.{kind}$", "")
    # the reader's path may be percent-encoded once more
    told = {}
    for r in back.withColumn("frame", frame).collect():
        told.setdefault(r.frame.replace("%25", "%"), {})[r.point_id] = (r.x, r.y, r.z, r.i)
    wanted = {}
    for r in df.collect():
        wanted.setdefault({"b/ü": "b%2F%C3%BC"}.get(r.frame, r.frame), {})[r.point_id] = (r.x, r.y, r.z, r.i)
    assert told.keys() == wanted.keys()
    for f, rows in wanted.items():
        assert told[f].keys() == rows.keys()
        for k, p in rows.items():
            assert np.allclose(told[f][k], p, atol=1e-6)


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "out")
    bad = points(spark).withColumn("x", F.when((F.col("frame") == "c.1") & (F.col("point_id") == 150), F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        sink.write(bad, out, "bin")
    assert not os.path.exists(out) or names(out) == []
    sink.write(points(spark), out, "bin")
    before = {f: os.path.getmtime(f"{out}/{f}") for f in names(out)}
    with pytest.raises(Exception, match="there already"):
        sink.write(points(spark, 3, ("new", "a")), out, "bin")
    assert {f: os.path.getmtime(f"{out}/{f}") for f in names(out)} == before
    sink.write(points(spark, 3, ("new",)), out, "npy", axes=("z", "x"), mode="overwrite")
    assert names(out) == ["new.npy"] and np.load(f"{out}/new.npy").shape == (3, 2)


def test_frames_must_come_together(spark, tmp_path):
    spark.dataSource.register(sink.PointSink)
    apart = points(spark, 9).select("frame", "x", "y", "z").repartition(5)
    with pytest.raises(Exception, match="two tasks|come together"):
        apart.write.format(sink.FORMAT).mode("append").option("kind", "bin").save(str(tmp_path / "out"))
    assert names(tmp_path / "out") == []
    for options, error in (({"kind": "las"}, "unknown format"), ({"kind": "bin", "ascii": "true"}, "no text form"), ({"axes": "x,w"}, "no such columns")):
        with pytest.raises(Exception, match=error):
            apart.write.format(sink.FORMAT).mode("append").options(**options).save(str(tmp_path / "out"))


def test_headers_are_those_of_the_formats():
    rows = np.arange(12, dtype="<f4").reshape(3, 4)
    for kind in pointfiles.FORMATS:
        data = sink.header(kind, 3, 4) + sink.body(rows)
        assert (pointfiles.decode(data, kind) == rows).all()
    assert len(sink.header("npy", 3, 4)) % 64 == 0


def test_convert_and_large_frames(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    rows = np.random.default_rng(2).normal(size=(500, 4)).astype("<f4")
    (tmp_path / "in" / "scan 1.bin").write_bytes(rows.tobytes())
    monkeypatch.setattr(sink, "ROWS", 7)
    sink.convert(pointfiles.read(spark, str(tmp_path / "in")), f"file://{tmp_path}/out", "ply", intensity=False)
    (name,) = names(tmp_path / "out")
    assert (pointfiles.decode((tmp_path / "out" / name).read_bytes(), "ply") == rows[:, :3]).all()
