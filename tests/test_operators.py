"""Round trips, golden vectors and brute force for the point-cloud operators."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from octarine.functions import bits as B
from octarine.functions import ranges as R
from octarine.operators import dyntree, entropy, neighbours, ntree, quantize, sequences


def cloud(spark, n=300, frames=2, seed=42, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(k % frames), int(k), *map(float, rng.normal(size=3) * scale)) for k in range(n)]
    return spark.createDataFrame(rows, "frame long, point_id long, x double, y double, z double")


def test_golden_quantization(spark):
    rows = [(0, *map(float, range(3 * k, 3 * k + 3))) for k in range(10)]
    df = spark.createDataFrame(rows, "frame int, x double, y double, z double")
    got = quantize.realize(quantize.encode(df, (16, 16, 16)), (16, 16, 16)).orderBy("x").collect()
    assert [r.code for r in (got[0], got[1], got[9])] == [0, 14555874201144, 131028638072831]
    assert [(r.qx, r.qy, r.qz) for r in got[1:3]] == [(3640, 3510, 3389), (7281, 7021, 6779)]
    assert all(round(r.rx) == r.x and round(r.ry) == r.y and round(r.rz) == r.z for r in got)


def test_zero_extent_and_zero_bits(spark):
    df = spark.createDataFrame([(0, 0.0, 5.0, 1.0), (0, 0.0, 6.0, 2.0)], "frame int, x double, y double, z double")
    got = quantize.realize(quantize.encode(df, (8, 8, 0)), (8, 8, 0)).collect()
    assert {r.qx for r in got} == {0} and {r.qz for r in got} == {0} and {r.scale_x for r in got} == {1.0}


@pytest.mark.parametrize("order", ["packed", "morton", list(range(24))[::-1]])
def test_codes_round_trip(spark, order):
    codes = quantize.encode(cloud(spark), (8, 8, 8), order=order)
    back = quantize.decode(codes.select("code", *[F.col(f"q{a}").alias(f"w{a}") for a in "xyz"]), (8, 8, 8), order=order)
    assert back.where("qx != wx or qy != wy or qz != wz").count() == 0


def test_too_wide_codes(spark):
    with pytest.raises(ValueError):
        quantize.encode(cloud(spark), (32, 32, 8))


@pytest.mark.parametrize("width", [7, 8, 63])
def test_reverse_is_an_involution(spark, width):
    df = spark.range(200).select((F.col("id") * 7919 % (1 << min(width, 30))).alias("code"))
    got = df.withColumn("r", B.reverse(F.col("code"), width)).withColumn("b", B.reverse(F.col("r"), width))
    assert got.where("b != code").count() == 0


def test_sorted_bits_permute_back(spark):
    codes = quantize.encode(cloud(spark), (8, 8, 8)).select("frame", "code").distinct()
    for absolute in (False, True):
        order = quantize.bit_order(quantize.bit_counts(codes, 24, ["frame"]), ["frame"], absolute=absolute)
        met = codes.join(order, "frame")
        new = B.total([F.shiftleft(F.call_function("shiftrightunsigned", F.col("code"), F.get("p", F.lit(j)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")), j) for j in range(24)])
        assert met.withColumn("s", new).withColumn("back", B.permute_by(F.col("s"), F.col("p"), 24)).where("back != code").count() == 0


def test_plan_dims():
    assert ntree.plan_dims([3], 8) == [3, 3, 2]
    assert ntree.plan_dims([], 3) == [0, 0, 0]
    assert ntree.plan_dims([1, 2], 6) == [1, 2, 2, 1]
    assert ntree.plan_dims([0, 2], 3) == [0, 2]
    for bad in ([7], [2, 0]):
        with pytest.raises(ValueError):
            ntree.plan_dims(bad, 8)


def test_golden_occupancy(spark):
    codes = spark.createDataFrame([(0, c) for c in (0b000, 0b001, 0b110, 0b111)], "frame int, code long")
    got = {(r.layer, r.parent): r.flag for r in ntree.symbols(codes, [1], 3).collect()}
    assert got == {(0, 0): 3, (1, 0): 1, (1, 1): 2, (2, 0): 3, (2, 3): 3}


@pytest.mark.parametrize("dims", [[1], [2], [3], [1, 2, 3], [6]])
def test_trees_decode_to_the_codes(spark, dims):
    codes = quantize.encode(cloud(spark), (8, 8, 8), order="morton").select("frame", "code").distinct()
    symbols = ntree.symbols(codes, dims, 24)
    assert sorted(ntree.decode(symbols, dims, 24).collect()) == sorted(codes.collect())
    per_layer = symbols.groupBy("frame", "layer").agg(F.sum("children").alias("kids"), F.count("*").alias("nodes"), F.sum("n").alias("n")).collect()
    by = {(r.frame, r.layer): r for r in per_layer}
    n = dict(codes.groupBy("frame").count().collect())
    for (frame, layer), r in by.items():
        assert r.n == n[frame]
        assert r.kids == (by[frame, layer + 1].nodes if (frame, layer + 1) in by else n[frame])


def test_trees_of_no_codes(spark):
    none = spark.createDataFrame([], "frame long, code long")
    assert ntree.symbols(none, [3], 24).count() == 0 and ntree.payload(none, [3], 24).count() == 0
    assert ntree.decode(ntree.symbols(none, [3], 24), [3], 24).count() == 0


def overflow(n, minor, major):
    if n == 1:
        return minor, 1
    b = n.bit_length() - 1
    cap = (1 << b) - 1
    if minor < cap:
        return minor, b
    pair = cap << b | min(major, cap)
    return (pair << 1 | (minor > major), 2 * b + 1) if major >= cap and n % 2 else (pair, 2 * b)


def test_overflow_symbols(spark):
    rows = [(n, m, n - m) for n in range(1, 20) for m in range(n + 1)]
    df = spark.createDataFrame(rows, "n long, minor long, major long")
    got = {(r.n, r.minor): (r.symbol, r.width) for r in ntree.overflow_symbols(df).collect()}
    assert got == {(n, m): overflow(n, m, k) for n, m, k in rows}
    assert [got[5, 2], got[6, 3], got[7, 3], got[4, 4], got[1, 1]] == [(2, 2), (15, 4), (30, 5), (12, 4), (1, 1)]
    assert {r.n: r.width for r in ntree.counter_symbols(df).collect()} | {} == {n: n.bit_length() for n in range(1, 20)}


def test_payload_tells_codes_apart(spark):
    codes = quantize.encode(cloud(spark), (8, 8, 8), order="morton").select("frame", "code").distinct()
    got = ntree.payload(codes, [3], 24).collect()
    for r in got:
        assert r.tail == r.code & ((1 << r.tail_bits) - 1) and r.tail_bits == 21 - 3 * r.layer
    heads = [(r.frame, r.layer, r.code >> r.tail_bits) for r in got]
    assert len(set(heads)) == len(heads)


def test_differential_is_undone(spark):
    rows = [(f, 0, p, (7 * f + p) % 8 + 1) for f in range(3) for p in range(5) if (f + p) % 4]
    flags = spark.createDataFrame(rows, "frame_no long, layer int, parent long, flag long")
    deltas = ntree.differential(flags)
    back = ntree.undo_differential(flags.where("frame_no = 0"), deltas.where("frame_no = 1").select("layer", "parent", "delta"))
    assert sorted(back.select("parent", "flag").collect()) == sorted(flags.where("frame_no = 1").select("parent", "flag").collect())


def test_permutation_tree_splits_by_the_most_skewed_bit(spark):
    codes = spark.createDataFrame([(0, c) for c in (0b0001, 0b0011, 0b0101, 0b1001)], "frame int, code long")
    got = ntree.permutation(codes, 4).orderBy("layer", "node").collect()
    assert (got[0].choice, got[0].n, got[0].ones) == (0, 4, 4)
    assert got[1].choice == 1 and got[1].node == 3


@pytest.mark.parametrize("radius", [0.2, 0.7])
def test_radius_tree_stays_within_the_radius(spark, radius):
    points = cloud(spark, 200)
    box, symbols = dyntree.encode(points, radius)
    leaves = dyntree.decode(box, symbols, radius).toPandas()
    for frame, own in points.toPandas().groupby("frame"):
        c = leaves[leaves.frame == frame][["x", "y", "z"]].to_numpy()
        p = own[["x", "y", "z"]].to_numpy()
        assert (np.abs(p[:, None] - c[None]).max(2).min(1) <= radius + 1e-9).all()
    kids = symbols.groupBy("frame", "layer").agg(F.sum(F.bit_count("flag")).alias("k"), F.count("*").alias("n")).collect()
    by = {(r.frame, r.layer): r for r in kids}
    for (frame, layer), r in by.items():
        if (frame, layer + 1) in by:
            assert r.k == by[frame, layer + 1].n


def test_mean_split_counts(spark):
    got = dyntree.mean_split(cloud(spark, 100), 0.5, 3).groupBy("frame", "layer").agg(F.sum("n").alias("n")).collect()
    assert all(r.n <= 50 for r in got) and {r.n for r in got if r.layer == 0} == {50}


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_by_brute_force(spark, k, seed):
    a, b = cloud(spark, 80, 1, seed), cloud(spark, 60, 1, seed + 9, 3.0)
    got = {(r.point_id, r["rank"]): (r.other_id, r.dist) for r in neighbours.nearest(a, b, k).collect()}
    pa, pb = a.toPandas(), b.toPandas()
    for _, p in pa.iterrows():
        d = np.sqrt(((pb[["x", "y", "z"]] - p[["x", "y", "z"]]) ** 2).sum(1))
        order = sorted(zip(d, pb.point_id, strict=True))[:k]
        for j, (dist, other) in enumerate(order, 1):
            assert got[p.point_id, j][0] == other and math.isclose(got[p.point_id, j][1], dist)


def test_nearest_in_clusters_that_begin_with_finer_cells(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(2500, 3)), rng.normal(size=(1500, 3)) * 0.01 + 2, rng.normal(size=(20, 3)) * 40])
    df = spark.createDataFrame([(0, k, *map(float, v)) for k, v in enumerate(x)], "frame long, point_id long, x double, y double, z double")
    got = {(r.point_id, r["rank"]): (r.other_id, r.dist) for r in neighbours.nearest(df, df, 3).collect()}
    assert len(got) == 3 * len(x)
    for k, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        best = np.lexsort((np.arange(len(x)), d))[:3]
        assert [got[k, j + 1][0] for j in range(3)] == best.tolist() and np.allclose([got[k, j + 1][1] for j in range(3)], d[best])


def test_rows_of_one_frame_are_dealt_to_many_tasks(spark):
    own = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(own, ("false", "-1", "16"), strict=True):
            spark.conf.set(k, v)
        df = spark.range(2000).select(F.lit("a").alias("frame"), *[F.col("id").cast("double").alias(a) for a in "xyz"])
        got = quantize.encode(df, (8, 8, 8)).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in got) == 2000 and max(r.n for r in got) < 600  # a join by frame brought all to one


def test_nearest_of_nothing(spark):
    a = cloud(spark, 5, 1)
    assert neighbours.nearest(a, a.limit(0)).count() == 0 and neighbours.nearest(a.limit(0), a).count() == 0


def test_report_of_equal_clouds(spark):
    a = cloud(spark, 40, 1)
    r = neighbours.report(a, a).first()
    assert r.xy_mse == 0 and r.sym_psnr == math.inf and r.xy_acc == 100


def test_plane_normals(spark):
    rng = np.random.default_rng(0)
    rows = [(0, k, *map(float, (*rng.uniform(size=2), 0.0))) for k in range(60)]
    df = spark.createDataFrame(rows, "frame long, point_id long, x double, y double, z double")
    assert all(abs(abs(r.nz) - 1) < 1e-6 for r in neighbours.plane_normals(df).collect())


def test_nearest_primitive_by_sampling(spark):
    tri = spark.createDataFrame([(0, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0))], "tri_id int, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>")
    points = [(0, 0.2, 0.2, 1.0), (1, -1.0, 0.5, 0.0), (2, 2.0, 2.0, 0.0), (3, 0.5, -2.0, 0.0)]
    got = {r.point_id: r for r in neighbours.nearest_primitive(spark.createDataFrame(points, "point_id int, x double, y double, z double"), tri).collect()}
    want = {0: (0.2, 0.2, 0.0), 1: (0.0, 0.5, 0.0), 2: (0.5, 0.5, 0.0), 3: (0.5, 0.0, 0.0)}
    assert all(np.allclose((got[k].px, got[k].py, got[k].pz), w) for k, w in want.items())


def test_bit_streams():
    w = R.BitWriter()
    for v, n in ((0x42, 8), (7, 4)):
        w.write(v, n)
    assert bytes(w) == b"\x42\x70" and len(w) == 12
    rng = np.random.default_rng(42)
    items = [(int(rng.integers(1 << n)), n) for n in rng.integers(1, 40, 2000).tolist()]
    w = R.BitWriter()
    for v, n in items:
        w.write(v, n)
    r = R.BitReader(bytes(w))
    assert [r.read(n) for _, n in items] == [v for v, _ in items]
    with pytest.raises(EOFError):
        r.read(64)


def test_range_coder_round_trips():
    assert R.cdf([0.5, 0.25, 0.25]) == [0, 32767, 49151, 65535]
    rng = np.random.default_rng(42)
    for size, n in ((2, 500), (255, 1000), (3, 1), (5, 0)):
        s = (rng.integers(0, size, n) * rng.integers(0, 2, n)).tolist()
        counts = [1 + s.count(k) for k in range(size)]
        sums = [0, *np.cumsum(counts).tolist()]
        data = R.encode(s, sums)
        assert list(R.decode(data, sums, n)) == s
        ideal = sum(-math.log2(counts[x] / sums[-1]) for x in s)
        assert 8 * len(data) <= ideal + 64
    with pytest.raises(ValueError):
        R.RangeEncoder().encode(3, 3, 10)


def test_adaptive_coder_round_trips():
    s = [0, 0, 1, 2, 0, 0, 0, 1] * 20
    model, out = R.Adaptive(4, 0.99), R.RangeEncoder()
    for x in s:
        c = model.cumulative()
        out.encode(c[x], c[x + 1], c[-1])
        model.see(x)
    model, source, got = R.Adaptive(4, 0.99), R.RangeDecoder(out.finish()), []
    for _ in s:
        got.append(source.decode(model.cumulative()))
        model.see(got[-1])
    assert got == s


def test_entropy_bounds_the_range_coder(spark):
    rng = np.random.default_rng(1)
    rows = [(0, k, int(v)) for k, v in enumerate(rng.integers(0, 6, 800))]
    df = spark.createDataFrame(rows, "frame int, point_id long, symbol long")
    bits = entropy.entropy(df, ["frame"], "symbol").first().bits
    coded = entropy.range_coded(df, 6)
    assert 0 <= 8 * len(coded.first().stream) - bits < 64
    assert [r.symbol for r in entropy.range_decoded(coded).orderBy("k").collect()] == [r[2] for r in rows]


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_range_coder_takes_any_symbol(spark, block):
    rows = [(f"f{k % 2}", k, s) for k, s in enumerate([3, 78, -1, 3, 1 << 40, 64, 3, 3, 0, 78, 64, 5, -(1 << 50)])]
    df = spark.createDataFrame(rows, "frame string, point_id long, symbol long").repartition(3)
    got = [(r.frame, r.k, r.symbol) for r in entropy.range_decoded(entropy.range_coded(df, block=block)).collect()]
    assert sorted(got) == sorted((f, k // 2, s) for f, k, s in rows)
    with pytest.raises(Exception, match="below 64"):
        entropy.range_coded(df, 64).collect()


def test_bit_entropy_values(spark):
    codes = spark.createDataFrame([(0, c) for c in (0, 1, 3, 7)], "frame int, code long")
    got = {r.code: r.e for r in entropy.bit_entropy(codes, 3, 1).collect()}
    assert got == {c: [0.5, None, None] for c in (0, 1, 3, 7)}


def test_circular_neighbours_of_short_frames(spark):
    df = spark.createDataFrame([(0, k, float(k)) for k in range(3)], "frame int, point_id int, v double")
    got = {r.point_id: r.around for r in sequences.neighbours(df, "v", 4).collect()}
    assert got == {k: [float((k + s) % 3) for s in (-2, -1, 1, 2)] for k in range(3)}


def test_rings_of_equal_mean_heights(spark):
    heights = {0: [0.3, 0.2, 0.1], 1: [0.1, 0.2, 0.3], 2: [0.2], 3: [0.1], 4: [-1e25, 1e25], 5: [float("inf"), 1.0]}
    df = spark.createDataFrame([(0, r, y) for r, ys in heights.items() for y in ys], "frame int, ring long, y double")
    got = sequences.rank_rings(df, "y").orderBy("rank").collect()
    assert [r.ring for r in got] == [4, 3, 0, 1, 2, 5]
    assert [r.mean for r in got] == [0.0, 0.1, 0.2, 0.2, 0.2, math.inf]


def test_next_marked_takes_time_in_proportion(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(0).alias("frame"), F.col("id").alias("point_id"), F.col("id").cast("double").alias("y"), (F.col("id") % 30_000 == 29_999).alias("mark"))
    start = time.monotonic()
    got = {r.point_id: r.next_value for r in sequences.next_marked(df, "mark", "y").collect()}
    assert time.monotonic() - start < 30  # one read of all later rows for each row took minutes
    assert all(got[k] == (None if k >= 89_999 else (k + 1) // 30_000 * 30_000 + 29_999.0) for k in range(n))


def test_keypoints_and_corners(spark):
    line = [(0, k, float(k), 0.0, 0.0) for k in range(6)] + [(0, 6 + k, 5.0, float(k + 1), 0.0) for k in range(6)]
    df = spark.createDataFrame(line, "frame int, point_id int, x double, y double, z double")
    keys = [r.point_id for r in sequences.keypoints(df).where("keypoint").orderBy("point_id").collect()]
    assert keys[0] == 0 and keys[-1] == 11 and 5 in keys
    assert [r.point_id for r in sequences.simplify(df, 0.1).where("corner").orderBy("point_id").collect()] == [0, 5, 11]


def test_principal_axes_keep_distances(spark):
    got = sequences.align(cloud(spark, 60, 1)).toPandas()
    a, p = got[["a0", "a1", "a2"]].to_numpy(), got[["x", "y", "z"]].to_numpy()
    assert np.allclose(np.linalg.norm(a, axis=1), np.linalg.norm(p - p.mean(0), axis=1))
    assert a[:, 0].var() >= a[:, 1].var() >= a[:, 2].var()


def test_augmentation_is_fixed_by_its_seed(spark):
    df = cloud(spark, 20)
    assert sequences.augment(df, 1).collect() == sequences.augment(df, 1).collect() != sequences.augment(df, 2).collect()
