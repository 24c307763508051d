"""Range coding by many states, trees cut near their means and what layers foretell: against slow versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from octarine.operators import bitstream, closedtree, neighbours, rangestream


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 60_000])
def test_coder_by_itself(n):
    r = np.random.default_rng(n)
    size = np.array([1, 65_536 - 1 - 300 - 20_000, 300, 20_000])
    low = np.concatenate([[0], np.cumsum(size)[:-1]])
    s = r.choice(4, n, p=[0.001, 0.699, 0.01, 0.29])
    data = rangestream.encode(low[s], size[s])
    back = rangestream.decode(data, lambda at, p: (j := np.searchsorted(low, p, side="right") - 1, low[j], size[j]))
    assert back.tolist() == s.tolist()
    least = float(np.sum(16 - np.log2(size[s]))) if n else 0
    assert 8 * len(data) <= 1.006 * least + 64 + 96


def test_ends_of_ranges():
    got = rangestream.ends([[1.0, 0.0, 3.0], [0.0, 0.0], [float("nan"), 5.0, float("inf")]])
    assert (got[:, 0] == 0).all() and (got[:, -1] == 1 << 16).all() and (np.diff(got, axis=1) >= 1).all()
    assert got[0, 1] == pytest.approx(16384, abs=4)


@pytest.mark.parametrize("chunk", [37, 1 << 17])
def test_frames_of_several_layers(spark, chunk):
    r = random.Random(3)
    rows = [(f, layer, k, r.choice([1, 1, 1, 5, 9, 255] if layer else [7])) for f in ("a", "b") for layer in range(4) for k in range(1 if f == "b" else 1 + 60 * layer)]
    df = spark.createDataFrame(rows, "frame string, layer int, parent long, flag long").repartition(4)
    models = rangestream.tables(df)
    assert {r_.t for r_ in models.groupBy("frame", "layer").agg(F.sum("size").alias("t")).collect()} == {1 << 16}
    coded = rangestream.write(df.join(models, ["frame", "layer", "flag"]), chunk=chunk)
    back = rangestream.read(coded, models, df.groupBy("frame", "layer").agg(F.count(F.lit(1)).alias("n")), chunk=chunk)
    for f in ("a", "b"):
        own = [x.flag for x in sorted((x for x in back.collect() if x.frame == f), key=lambda x: x.k)]
        assert own == [x[3] for x in sorted(x for x in rows if x[0] == f)]
    weighted = df.withColumn("weights", F.transform(F.sequence(F.lit(1), F.lit(255)), lambda k: 1.0 / (1 + F.abs(k - F.col("layer") * 5))))
    told = rangestream.read_by(rangestream.write_by(weighted, chunk=chunk), weighted.drop("flag"), chunk=chunk)
    assert sorted(map(tuple, told.collect())) == sorted(rows)
    with pytest.raises(Exception, match="no weight"):
        rangestream.write_by(weighted.withColumn("flag", F.lit(256)), chunk=chunk).collect()


# ---- trees


def slow_tree(points, radius):
    """Leaves and symbols of one frame, by recursion."""
    d = len(points[0])
    out = []

    def walk(own, lo, hi, node, layer):
        mid, unit = [(a + b) / 2 for a, b in zip(lo, hi, strict=True)], [(b - a) / 8 for a, b in zip(lo, hi, strict=True)]
        split = [(b - a) / 2 > radius for a, b in zip(lo, hi, strict=True)]
        mean = [sum(p[k] for p in own) / len(own) for k in range(d)]
        q = [min(2, max(-2, math.floor((mean[k] - mid[k]) / unit[k] + 0.5))) if split[k] else 0 for k in range(d)]
        pos = [m + s * u for m, s, u in zip(mid, q, unit, strict=True)]
        far = any(split[k] and max(abs(p[k] - pos[k]) for p in own) > radius for k in range(d))
        kids = {}
        if far:
            for p in own:
                kids.setdefault(sum(1 << k for k in range(d) if split[k] and p[k] >= pos[k]), []).append(p)
        out.append((layer, node, sum(split), sum(1 << c for c in kids), len(own), *q))
        for c, some in sorted(kids.items()):
            at = [split[k] and c >> k & 1 for k in range(d)]
            walk(some, [pos[k] if at[k] else lo[k] for k in range(d)], [pos[k] if split[k] and not at[k] else hi[k] for k in range(d)], node << d | c, layer + 1)

    walk(points, [min(p[k] for p in points) for k in range(d)], [max(p[k] for p in points) for k in range(d)], 1, 0)
    return sorted(out)


@pytest.mark.parametrize("axes", ["xyz", "xy", "x"])
def test_closed_trees(spark, axes):
    r = random.Random(7)
    frames = {
        "cloud": [tuple(r.gauss(0, 1) * (k + 1) for k in range(len(axes))) for _ in range(400)],
        "same": [(2.5,) * len(axes)] * 5,
        "one": [(0.0,) * len(axes)],
        "flat": [tuple(r.random() if k == 0 else 1.0 for k in range(len(axes))) for _ in range(60)],
        "skew": [tuple(r.random() ** 9 for _ in axes) for _ in range(200)],
    }
    rows = [(f, *p) for f, own in frames.items() for p in own] + [("cloud", *[float("nan")] * len(axes)), ("none", *[float("inf")] * len(axes))]
    df = spark.createDataFrame(rows, "frame string, " + ", ".join(f"{a} double" for a in axes)).repartition(4)
    radius = 0.3
    roots, symbols = closedtree.encode(df, radius, axes=axes)
    got = {}
    for s in symbols.collect():
        got.setdefault(s.frame, []).append((s.layer, s.node, s.dims, s.flag, s.n, *[s[f"q_{a}"] for a in axes]))
    assert {f: sorted(x) for f, x in got.items()} == {f: slow_tree(own, radius) for f, own in frames.items()}
    stream, layers = closedtree.write(symbols, axes=axes, chunk=16)
    found = closedtree.decode(stream, roots, radius, axes=axes, chunk=16)
    wanted = {(x.frame, x.node): tuple(x[a] for a in axes) for x in closedtree.leaves(symbols, axes=axes).collect()}
    assert {(x.frame, x.node): tuple(x[a] for a in axes) for x in found.collect()} == wanted
    told = {x.frame: x for x in closedtree.errors(df, found, symbols, axes=axes).collect()}
    assert told.keys() == frames.keys()
    assert all(x.worst <= radius + 1e-12 and x.points == len(frames[x.frame]) for x in told.values())
    bits = {x.frame: x.bits for x in bitstream.sizes(layers).collect()}
    assert bits == {f: b for f, x in got.items() if (b := sum(3 * s[2] + (1 << s[2]) if s[2] else 0 for s in x))}


def test_trees_that_end_early_or_never(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 1e9, 1.0, 1.0), ("a", 1e-9, 1.0, 1.0)], "frame string, x double, y double, z double")
    with pytest.raises(ValueError, match="would not fit"):
        closedtree.encode(df, 1e-12)
    assert closedtree.encode(df, 1e-12, max_layers=2)[1].agg(F.max("layer")).first()[0] == 1
    with pytest.raises(ValueError, match="above 0"):
        closedtree.encode(df, 0.0)
    roots, symbols = closedtree.encode(df.where("false"), 0.1)
    assert symbols.count() == 0 and closedtree.decode(closedtree.write(symbols)[0], roots, 0.1).count() == 0


def test_foretold_by_a_slow_version(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(f, *[r.gauss(0, 1) for _ in "xyz"]) for f in (1, 2) for _ in range(300)], "frame long, x double, y double, z double")
    symbols = closedtree.encode(df, 0.3)[1]
    got = {(x.frame, x.node): x for x in closedtree.predicted(symbols).collect()}
    rows, known, checked = symbols.where("dims > 0").collect(), {}, 0
    for layer in sorted({x.layer for x in rows}):
        own = [x for x in rows if x.layer == layer]
        for x in own:
            seen = known.get((x.frame, x.split, x.node & 7), [])
            count = {f: sum(s.flag == f for s in seen) for f in {s.flag for s in seen}}
            every = sum(1 << c for c in range(8) if not c & ~x.split)
            guess = min(count, key=lambda f: (-count[f], f)) if seen else every
            steps = [math.floor(sum(s[f"q_{a}"] for s in seen) / len(seen) + 0.5) if seen else 0 for a in "xyz"]
            y = got[x.frame, x.node]
            assert (y.seen, y.flag_guess, y.hit, [y[f"step_{a}"] for a in "xyz"], [y[f"rest_{a}"] for a in "xyz"]) == (len(seen), guess, guess == x.flag, steps, [x[f"q_{a}"] - s for a, s in zip("xyz", steps, strict=True)])
            assert y.cost == pytest.approx(-math.log2((count.get(x.flag, 0) + 1) / (len(seen) + 2 ** (2**x.dims))))
            checked += bool(seen)
        for x in own:
            known.setdefault((x.frame, x.split, x.node & 7), []).append(x)
    assert len(got) == len(rows) and checked


# ---- rays


def test_triangles_of_all_sizes(spark):
    r = random.Random(9)
    near = lambda c, s: tuple(x + r.uniform(-s, s) for x in c)
    tris = [(k, *[near(c, 10.0 ** r.uniform(-4, 0)) for _ in range(3)]) for k in range(150) for c in [(r.random(), r.random(), r.random())]]
    tris += [(150, (0.0, 0.0, 0.5), (1.0, 0.0, 0.5), (0.0, 1.0, 0.5)), (151, (0.3, 0.3, 0.3),) + ((0.3, 0.3, 0.3),) * 2]
    point = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame(tris, f"tri_id long, a {point}, b {point}, c {point}")
    rays = [(k, tuple(r.uniform(-1, 2) for _ in range(3)), tuple(r.uniform(-1, 2) for _ in range(3))) for k in range(60)]
    rays += [(60 + k, (x, y, -1.0), (x, y, 2.0)) for k, (x, y) in enumerate([(0.1, 0.1), (0.0, 0.5), (0.3, 0.3)])]
    aim = [(100 + k, tuple(x - 0.7 for x in m), tuple(x + 0.7 for x in m)) for k, t in enumerate(tris[:150]) for m in [tuple(sum(v) / 3 for v in zip(*t[1:], strict=True))]]
    rays += aim
    got = {(x.ray_id, x.tri_id): x.t for x in neighbours.raycast(spark.createDataFrame(rays, f"ray_id long, p0 {point}, p1 {point}"), df).collect()}
    wanted = {}
    for i, p, q in rays:
        o, e = np.array(p), np.array(q) - np.array(p)
        for j, a, b, c in tris:
            a, b, c = map(np.array, (a, b, c))
            h, s = np.cross(e, c - a), o - a
            det = (b - a) @ h
            if det == 0:
                continue
            u, v, t = s @ h / det, e @ np.cross(s, b - a) / det, (c - a) @ np.cross(s, b - a) / det
            if u >= 0 and v >= 0 and u + v <= 1 and 0 <= t <= 1:
                wanted[i, j] = t
    assert got.keys() == wanted.keys() and len(wanted) > 150
    assert all(got[k] == pytest.approx(wanted[k]) for k in got)
    boxes = neighbours.levelled(neighbours._boxed(df))
    assert neighbours._gridded(boxes, "_side", 1e-6).count() <= 8 * len(tris)
    assert neighbours.raycast(spark.createDataFrame(rays, f"ray_id long, p0 {point}, p1 {point}"), df.where("false")).count() == 0
