"""Recurrences in blocks against the same one after the other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from octarine.operators import learning, scans
from octarine.plans import sequence_queries


def walk(seed, sizes=(1, 2, 3, 60, 147)):
    r, rows = random.Random(seed), []
    for f, n in enumerate(sizes):
        p = [0.0, 0.0, 0.0]
        for k in range(n):
            p = [a + r.choice([0.0, 0.0, 1.0, r.gauss(0, 1)]) for a in p] if k % 9 else p
            rows.append((f"f{f}", k * 10 + r.randrange(10), *p, r.randrange(5)))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "frame string, point_id long, x double, y double, z double, symbol int").repartition(5)


def by_frame(rows):
    out = {}
    for x in sorted(rows):
        out.setdefault(x[0], []).append(x)
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_decay_and_fading_counts(spark, block):
    rows = walk(1)
    got = {(x.frame, x.point_id): (x.before_x, x.before_y) for x in scans.decayed(table(spark, rows), ["x", "y"], 0.9, 0.1, block=block).collect()}
    from_zero = {(x.frame, x.point_id): x.before_x for x in scans.decayed(table(spark, rows), ["x"], 0.5, 1.0, start=0.0, block=block).collect()}
    cost = {(x.frame, x.point_id): x.cost for x in scans.fading_cost(table(spark, rows), 5, 0.9, block=block).collect()}
    for own in by_frame(rows).values():
        state, zero, counts = list(own[0][2:4]), 0.0, [1.0] * 5
        for x in own:
            assert got[x[:2]] == pytest.approx(state) and from_zero[x[:2]] == pytest.approx(zero)
            assert cost[x[:2]] == pytest.approx(-math.log2(counts[x[5]] / sum(counts)))
            state, zero = [0.9 * s + 0.1 * v for s, v in zip(state, x[2:4], strict=True)], 0.5 * zero + x[2]
            counts = [c * 0.9 for c in counts]
            counts[x[5]] += 1
    with pytest.raises(Exception, match="below 5"):
        scans.fading_cost(table(spark, [("a", 1, 0.0, 0.0, 0.0, 5)]), 5, 0.9).collect()


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_fading_counts_with_symbols_beyond_them(spark, block):
    symbols = [5, 0, 1, 9, 1, 4, 5, 0]
    df = table(spark, [("a", k, 0.0, 0.0, 0.0, s) for k, s in enumerate(symbols)])
    got = {x.point_id: x.cost for x in scans.fading_cost(df, 5, 0.9, block=block, others=True).collect()}
    counts = [1.0] * 5
    for k, s in enumerate(symbols):
        assert got[k] is None if s >= 5 else got[k] == pytest.approx(-math.log2(counts[s] / sum(counts)))
        counts = [c * 0.9 + (j == s) for j, c in enumerate(counts)]


@pytest.mark.parametrize("block", [500, 1 << 16])
def test_fading_counts_below_the_least_double(spark, block):
    df = table(spark, [("a", k, 0.0, 0.0, 0.0, int(k == 1200)) for k in range(1201)])
    got = {x.point_id: x.cost for x in scans.fading_cost(df, 2, 0.5, block=block).collect()}
    assert got[1200] == pytest.approx(1200 + math.log2(sum(0.5**k for k in range(60))))


def doubles(symbols, size, gate):
    counts, out = np.ones(size), []
    for s in symbols:
        part = counts[s] / np.cumsum(counts)[-1] if s < size else None
        out.append(part and (-math.log2(part)) if part != 0 else math.inf)
        counts = counts * gate
        if s < size:
            counts[s] += 1
    return out


@pytest.mark.parametrize(("block", "gate"), [(7, 0.9), (97, 0.5), (97, 0.98), (1 << 16, 0.98)])
def test_counts_in_doubles_to_the_last_bit(spark, block, gate):
    r = random.Random(7)
    frames = {"a": [r.choice([0, 1, 1, 2, 3, 9, 5]) for _ in range(400)], "b": [2] * 300 + [0, 1, 4, 2], "c": [8], "d": [r.randrange(2) for _ in range(50)]}
    df = table(spark, [(f, k, 0.0, 0.0, 0.0, s) for f, own in frames.items() for k, s in enumerate(own)])
    got = {(x.frame, x.point_id): x.cost for x in scans.stepped_cost(df, 5, gate, block=block).collect()}
    assert got == {(f, k): c for f, own in frames.items() for k, c in enumerate(doubles(own, 5, gate))}
    with pytest.raises(Exception, match="from 0"):
        scans.stepped_cost(table(spark, [("a", 1, 0.0, 0.0, 0.0, -1)]), 5, 0.9).collect()


def test_query_where_counts_stop_fading(spark, tmp_path):
    symbols = [3] + [0, 1] * 18_700 + [3, 5, 3, 0, 70, 5]
    rows = [("a", k, 10.0 * s + 1) for k, s in enumerate(symbols)]
    spark.createDataFrame(rows, "event_type string, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {x.point_id: x.cost for x in sequence_queries.fading_cost(spark, str(tmp_path)).collect()}
    wanted = doubles(symbols, 64, 0.98)
    assert wanted[-6] == math.inf
    assert got == {k: c if c is None or math.isinf(c) else pytest.approx(c, abs=1e-6) for k, c in enumerate(wanted)}


def slow_keys(x, m, o):
    mask = [k in (0, len(x) - 1) for k in range(len(x))]
    key = x[0]
    for i in range(2, len(x)):
        way, step = x[i - 1] - key, x[i] - x[i - 1]
        far, near = float(way @ way), float(step @ step)
        if far and near and float(way @ step) ** 2 / (far * near) < 1 - math.exp(-o - far / m**2) ** 4:
            mask[i - 1], key = True, x[i - 1]
    return mask


@pytest.mark.parametrize("block", [1, 2, 13, 1 << 16])
def test_keypoints_of_blocks(spark, block):
    rows = walk(2)
    got = {(x.frame, x.point_id): x.keypoint for x in scans.keypoints(table(spark, rows), 2.0, 0.1, block=block).collect()}
    for own in by_frame(rows).values():
        assert [got[x[:2]] for x in own] == slow_keys([np.array(x[2:5]) for x in own], 2.0, 0.1)
    assert 10 < sum(got.values()) < len(got) - 10


def slow_corners(x, tolerance):
    corner = {0, len(x) - 1}
    while True:
        at, new = sorted(corner), set()
        for a, b in zip(at, at[1:], strict=False):
            if b - a < 2:
                continue
            d = x[b] - x[a]
            errors = []
            for i in range(a + 1, b):
                off = x[i] - x[a]
                t = min(1.0, max(0.0, float(off @ d) / float(d @ d))) if d @ d else 0.0
                errors.append(float(((off - t * d) ** 2).sum()))
            if max(errors) > tolerance**2:
                new.add(a + 1 + errors.index(max(errors)))
        if not new:
            return [k in corner for k in range(len(x))]
        corner |= new


def test_corners_of_all_segments_at_once(spark):
    rows = walk(3)
    got = {(x.frame, x.point_id): x.corner for x in scans.simplify(table(spark, rows), 1.5).collect()}
    for own in by_frame(rows).values():
        assert [got[x[:2]] for x in own] == slow_corners([np.array(x[2:5]) for x in own], 1.5)
    once = scans.simplify(table(spark, rows), 1.5, max_rounds=1).where("corner").groupBy("frame").count().collect()
    assert all(x["count"] <= 3 for x in once)


@pytest.mark.parametrize("k", [2, 4, 6])
def test_circles(spark, k):
    rows = walk(4, (1, 2, 3, 40))
    got = {(x.frame, x.point_id): x.around for x in scans.around(table(spark, rows), "x", k).collect()}
    for own in by_frame(rows).values():
        for i, x in enumerate(own):
            assert got[x[:2]] == [own[(i + s) % len(own)][2] for s in range(-(k // 2), k // 2 + 1) if s]


def test_features_of_circles_and_permutations(spark):
    r = random.Random(5)
    rows = [(f, layer, n, r.random(), r.random()) for f in "ab" for layer in (1, 2) for n in range(5 if f == "a" else 1)]
    df = spark.createDataFrame(rows, "frame string, layer int, node long, x double, y double").withColumns({"box_x": F.lit(0.4), "box_y": F.lit(0.2)})
    own = {}
    for x in rows:
        own.setdefault(x[:2], []).append(x)
    for g in learning.circular_pivots(df, 4, axes="xy").collect():
        mates = own[g.frame, g.layer]
        x = mates[g.node]
        c = (x[3] + (0.2 if g.k & 1 else -0.2), x[4] + (0.1 if g.k & 2 else -0.1))
        near = [mates[(g.node + s) % len(mates)] for s in (-2, -1, 1, 2)]
        assert g.pivots == pytest.approx([math.exp(-((c[0] - n[3]) ** 2) - (c[1] - n[4]) ** 2) for n in near])
    bits = learning.permutation_bits(df.withColumn("p", F.array(*map(F.lit, (3, 0, 2, 1, 4)))), 2, 5).collect()
    p = (3, 0, 2, 1, 4)
    for g in bits:
        places = [p[j] if j < 5 else None for j in (g.layer * 2, g.layer * 2 + 1)]
        assert g.features == [float(k == b) for b in places for k in range(5)]
