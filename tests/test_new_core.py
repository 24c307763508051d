"""Cases in which the point-cloud operators once gave wrong or lost rows, and newer operators by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from octarine.functions.lineage import numbered
from octarine.operators import dyntree, entropy, learning, neighbours
from octarine.plans import codec
from octarine.sources import pointfiles


def test_numbers_follow_the_order(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), k) for k in range(300)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"]).collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.number)] == sorted(rows)
    assert sorted(x.number for x in got) == list(range(300))


def test_an_index_names_whole_paths(spark, tmp_path):
    for name, n in (("a/b/1.bin", 2), ("b/1.bin", 3)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(np.zeros((n, 4), "<f4").tobytes())
    (tmp_path / "index.txt").write_text("b/1.bin\n\n")
    assert pointfiles.read_index(spark, f"{tmp_path}/index.txt", str(tmp_path)).count() == 3
    (tmp_path / "none.txt").write_text("\n")
    assert pointfiles.read_index(spark, f"{tmp_path}/none.txt", str(tmp_path)).count() == 0


@pytest.mark.parametrize("kind", ["pcd", "ply", "npy", "bin"])
def test_files_come_back(kind):
    rows = np.arange(12, dtype="<f4").reshape(3, 4)
    assert (pointfiles.decode(pointfiles.encode(rows, kind), kind) == rows).all()


def test_ascii_pcd():
    head = "VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA ascii\n1 2 3\n4 5 6\n"
    assert pointfiles.decode(head.encode(), "pcd").tolist() == [[1, 2, 3], [4, 5, 6]]


def test_deep_paths_are_refused(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (0, 1e9, 1e9, 1e9)], "frame int, x double, y double, z double")
    with pytest.raises(ValueError):
        dyntree.encode(points, 1e-3)


def test_points_that_are_no_numbers_meet_nothing(spark):
    r = random.Random(2)
    rows = [(f, k, r.random() * 10**f, r.random(), r.random()) for f in range(3) for k in range(40)]
    odd = [(0, 900, math.inf, 0.0, 0.0), (1, 901, math.nan, 0.0, 0.0), (2, 902, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "frame int, point_id int, x double, y double, z double")
    got = neighbours.nearest(df, df, 2, same=False).collect()
    assert len(got) == 2 * len(rows)
    for g in got:
        p = next(x for x in rows if x[:2] == (g.frame, g.point_id))
        want = sorted((math.dist(p[2:], q[2:]), q[1]) for q in rows if q[0] == p[0] and q[1] != p[1])[g.rank - 1]
        assert g.dist == pytest.approx(want[0])


def test_mean_streams_and_their_boxes_come_back(spark):
    r = random.Random(3)
    points = spark.createDataFrame([(k % 2, r.random(), r.random() / 3, r.random() / 20) for k in range(90)], "frame int, x double, y double, z double")
    tree = dyntree.mean_split(points, 0.1)
    written = dyntree.mean_streams(tree, 0.1)
    back = dyntree.read_mean_streams(written)
    cols = ("frame", "layer", "node", "dims", "flag")
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, tree.select(*cols).collect()))
    bits = {x.frame: x.bits for x in dyntree.mean_bits(tree).collect()}
    assert {x.frame: x.bits - 3 * x.n for x in written.collect()} == bits
    leaves = dyntree.mean_decode(back, tree.where("layer = 0"))
    assert {x.frame: x.n for x in leaves.groupBy("frame").agg(F.count("*").alias("n")).collect()} == {x.frame: x.n for x in tree.where("flag = 0").groupBy("frame").agg(F.count("*").alias("n")).collect()}


def test_symbols_coded_by_given_weights_come_back(spark):
    r = random.Random(4)
    rows = [(f, k, r.randrange(1, 8), [r.random() ** 3 for _ in range(7)]) for f in range(3) for k in range(60)]
    df = spark.createDataFrame(rows, "frame int, point_id int, symbol long, weights array<double>")
    back = entropy.decoded_by(entropy.coded_by(df), df.drop("symbol"))
    assert sorted((x.frame, x.point_id, x.symbol) for x in back.collect()) == [x[:3] for x in rows]


def test_features_of_boxes(spark):
    rows = [(0, 0, k, float(k), 2.0, 3.0, 1.0, 1.0, 1.0, k / 2, 2.0, 3.5, k % 4) for k in range(6)]
    df = spark.createDataFrame(rows, "frame int, layer int, node long, x double, y double, z double, box_x double, box_y double, box_z double, mean_x double, mean_y double, mean_z double, flag long")
    kids = learning.candidate_centres(df).where("node = 2 and k = 5").first()
    assert (kids.c_x, kids.c_y, kids.c_z) == (2.5, 1.5, 3.5)
    first = learning.box_features(df, 3).where("node = 5").first().features
    assert first[:9] == [5.0, 2.0, 3.0, 1.0, 1.0, 1.0, 1.0, -1.0, 1.0] and first[9] == 6
    assert learning.mean_labels(df, 2).where("node = 4").first().label[-3:] == [-2.0, 0.0, 0.5]
    assert df.select(learning.halves_of(F.array(F.lit(1.0), F.lit(-2.0))).alias("h")).first().h == [1.0, 0.0, 0.0, 2.0]
    assert [len(x.features) for x in learning.dataset(df.withColumn("f", F.array("x")), "f", "flag", most=4).orderBy("batch").collect()] == [4, 2]
    assert [x.place for x in learning.places(df, ["frame"], "node", 0, 3).orderBy("node").collect()] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5]
    cells = dyntree.unit_cells(spark.createDataFrame([(0b110101,)], "node long"), 2).first()
    assert (cells.x, cells.y, cells.z) == (-0.25, 0.25, 0.75)


@pytest.mark.parametrize("cfg", [codec.Config(bits=(6, 6, 6), chunk=2, chunk_bits=2, dims=(0, 2)), codec.Config(bits=(6, 6, 6), payload=True, sort_bits=True, archive=True), codec.Config(bits=(9, 9, 9), spherical=True)])
def test_points_come_back_near(spark, cfg):
    r = random.Random(5)
    rows = [(f"f{k % 3}", r.uniform(1, 9), r.uniform(1, 9), r.uniform(1, 9)) for k in range(60)]
    points = spark.createDataFrame(rows + [("f0", math.nan, 0.0, 0.0)], "frame string, x double, y double, z double")
    made = codec.compress(points, cfg)
    assert made.agg(F.sum("inp_points")).first()[0] == 60
    back = codec.expand(made, cfg).collect()
    assert {x.frame for x in back} == {"f0", "f1", "f2"}
    for f, *p in rows:
        assert min(math.dist(p, x[1:]) for x in back if x.frame == f) < 0.5
