import numpy as np
import pytest
from pyspark.sql import functions as F

from octarine.plans import codec
from octarine.session import session
from octarine.sources import pointfiles as P
from octarine.streaming import frames


@pytest.fixture()
def scans(tmp_path):
    rng = np.random.default_rng(42)
    clouds = {k: rng.normal(size=(20 + k, 4)).astype("f4") for k in range(3)}
    for k, x in clouds.items():
        for kind in P.FORMATS:
            (tmp_path / kind).mkdir(exist_ok=True)
            (tmp_path / kind / f"{k}.{kind}").write_bytes(P.encode(x, kind))
    return tmp_path, clouds


@pytest.mark.parametrize("kind", P.FORMATS)
def test_reads_and_converts(spark, scans, kind):
    root, clouds = scans
    got = P.read(spark, f"{root}/{kind}/*.{kind}").toPandas()
    for k, x in clouds.items():
        own = got[got.frame.str.endswith(f"/{k}.{kind}")].sort_values("point_id")
        assert np.array_equal(own[["x", "y", "z", "i"]].to_numpy("f4"), x)
    for r in P.convert(spark, f"{root}/{kind}", "bin").collect():
        k = int(r.frame.rsplit("/", 1)[1].split(".")[0])
        assert bytes(r.content) == clouds[k].tobytes()
    assert P.convert(spark, f"{root}/{kind}", "ply", intensity=False).count() == 3


def test_ascii_ply_and_bad_formats():
    text = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n"
    assert P.decode(text, "ply").tolist() == [[1, 2, 3], [4, 5, 6]]
    assert len(P.decode(b"\0" * 35, "bin")) == 2
    for f in (lambda: P.decode(b"", "las"), lambda: P.encode(np.zeros((1, 3)), "las")):
        with pytest.raises(ValueError):
            f()


def test_index(spark, scans):
    root, _ = scans
    (root / "index.txt").write_text("0.bin\n\n2.bin\n")
    got = P.read_index(spark, f"{root}/index.txt", f"{root}/bin")
    assert {r.frame.rsplit("/", 1)[1] for r in got.select("frame").distinct().collect()} == {"0.bin", "2.bin"}
    assert P.read_index(spark, f"{root}/index.txt", f"{root}/bin", take=1).select("frame").distinct().count() == 1


@pytest.mark.parametrize("cfg", [codec.Config(bits=(10, 10, 10)), codec.Config(bits=(8, 8, 8), dims=(1, 2, 3), order="packed"), codec.Config(bits=(14, 14, 14), spherical=True)])
def test_codec_round_trip(spark, scans, tmp_path, cfg):
    root, _ = scans
    points = P.read(spark, f"{root}/bin").select("frame", "x", "y", "z")
    points = points.union(points.limit(1).select("frame", F.lit(float("nan")), "y", "z"))
    headers, symbols = codec.encode_frames(points, cfg)
    P.write_headers(headers, f"{tmp_path}/headers")
    back = codec.decode_frames(P.read_headers(spark, f"{tmp_path}/headers"), symbols, cfg).toPandas()
    assert headers.agg(F.sum("out_points")).first()[0] == len(back)
    for frame, own in points.dropna().toPandas().groupby("frame"):
        own = own[~own.x.isna()]
        c = back[back.frame == frame][["x", "y", "z"]].to_numpy()
        far = np.abs(own[["x", "y", "z"]].to_numpy()[:, None] - c[None]).max(2).min(1)
        assert far.max() < 0.05
    assert codec.streams(symbols).agg(F.sum("bits")).first()[0] == headers.agg(F.sum("flag_bits")).first()[0]


def test_stream_encodes_each_frame(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(f"f{k}", c) for c in (1, 5, 6)], "frame string, code long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    codes = frames.point_stream(spark, f"{tmp_path}/in", "frame string, code long")
    q = frames.encode_stream(codes, [3], 3, f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    got = {r.frame: r.flag for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"f0": 0b1100010, "f1": 0b1100010}


def test_stream_of_differences(spark, tmp_path):
    schema = "stream string, frame_no long, layer int, parent long, flag long"
    for k, flags in enumerate(([(0, 3), (1, 5)], [(2, 5), (4, 6)])):
        spark.createDataFrame([("s", n, 0, 0, f) for n, f in flags], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    import shutil

    shutil.copytree(f"{tmp_path}/in0", f"{tmp_path}/in")
    out = {}
    for k in range(2):
        if k:
            for f in (tmp_path / "in1").glob("*.parquet"):
                shutil.copy(f, tmp_path / "in")
        stream = frames.differential_stream(frames.point_stream(spark, f"{tmp_path}/in", schema))
        q = stream.writeStream.foreachBatch(lambda b, n: out.update({r.frame_no: r.delta for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert out == {0: 3, 1: 6, 2: 0, 4: 6}


def test_session_reuses_settings(spark):
    assert session("again").conf.get("spark.sql.session.timeZone") == "UTC"
