import pytest
from pyspark.sql import functions as F
from test_operators import cloud

from octarine.functions import bits as B
from octarine.operators import dyntree, entropy, learning
from octarine.sources import pointfiles


@pytest.mark.parametrize("radius", [0.3, 1.1])
def test_radius_streams_come_back(spark, radius):
    box, symbols = dyntree.encode(cloud(spark, 120), radius)
    back = dyntree.read_streams(dyntree.streams(symbols), box, radius)
    want = symbols.select("frame", "layer", "node", "dims", "flag")
    assert sorted(back.collect()) == sorted(want.collect())


def test_mean_leaves_hold_all_points(spark):
    leaves = dyntree.mean_leaves(dyntree.mean_split(cloud(spark, 100), 0.4, 4))
    got = {r.frame: r.n for r in leaves.groupBy("frame").agg(F.sum("n").alias("n")).collect()}
    assert got == {0: 50, 1: 50}


def test_codes_sorted_by_skew_come_back(spark):
    codes = spark.createDataFrame([(0, c) for c in (0, 1, 3, 7, 12)], "frame int, code long")
    got = entropy.by_skew(entropy.bit_entropy(codes, 4, 3), 4)
    assert got.withColumn("back", B.permute_by(F.col("sorted_code"), F.col("p"), 4)).where("back != code").count() == 0


def test_sliced_metric(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([3.0, 4.0, 9.0],)], "v array<double>")
    mean = lambda s: F.avg(F.aggregate(s, F.lit(0.0), lambda a, x: a + x))
    assert df.agg(learning.sliced(F.col("v"), 0, 2, mean)).first()[0] == 5.0


def test_curves_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Wall time,Step,Value\n1.5,0,2.5\n2.5,1,2.0\n")
    assert [tuple(r) for r in pointfiles.read_curves(spark, f"{tmp_path}/a.csv").collect()] == [(1.5, 0.0, 2.5), (2.5, 1.0, 2.0)]
    assert len(pointfiles.stream_header(0.03, (1, 2, 3), (0, 0, 0))) == 28
