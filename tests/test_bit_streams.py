"""Streams that many tasks write: the bytes that one would write."""

import random

import numpy as np
import pytest

from octarine.functions import ranges as R
from octarine.functions.lineage import placed, prefix
from octarine.operators import bitstream, ntree


def rows_of(seed, frames=3, n=900):
    r = random.Random(seed)
    out = []
    for f in range(frames):
        for k in range(n if f else 1):
            w = r.choice([0, 1, 3, 8, 13, 31, 63, 64])
            out.append((f"f{f}", k % 5, k // 5, r.getrandbits(64) - (1 << 63), w))
    return out


@pytest.mark.parametrize("chunk, piece", [(64, 50), (16, 7), (1 << 16, 1 << 16)])
def test_same_bytes_as_one_task(spark, chunk, piece):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "frame string, layer int, parent long, flag long, width int").repartition(5)
    stream, layers = bitstream.write(df, chunk=chunk, piece=piece)
    got = {r.frame: bytes(r.stream) for r in bitstream.whole(stream).collect()}
    told = {(r.frame, r.layer): (r.start, r.n, r.bits) for r in layers.collect()}
    for f in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == f), key=lambda x: x[1:3])
        packed = R.pack(np.array([x[3] for x in own]), np.array([x[4] for x in own]))
        assert got.get(f, b"") == packed
        at = 0
        for layer in sorted({x[1] for x in own}):
            part = [x[4] for x in own if x[1] == layer]
            assert told[f, layer] == (at, len(part), sum(part))
            at += sum(part)
    assert all(len(r.content) == chunk for r in stream.collect() if r.chunk < len(got[r.frame]) // chunk)


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_values_are_read_at_any_bit(spark, chunk):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "frame string, layer int, parent long, flag long, width int")
    stream, _ = bitstream.write(df, chunk=chunk, piece=40)
    wanted, known = [], {}
    for f in {x[0] for x in rows}:
        at = 0
        for x in sorted((x for x in rows if x[0] == f), key=lambda x: x[1:3]):
            if x[4]:
                wanted.append((f, len(wanted), at, x[4]))
                known[len(wanted) - 1] = x[3] & ((1 << x[4]) - 1)
            at += x[4]
    got = bitstream.gather(stream, spark.createDataFrame(wanted, "frame string, id long, start long, width int").repartition(3), chunk=chunk).collect()
    assert {r.id: r.value & ((1 << 64) - 1) for r in got} == known
    with pytest.raises(Exception, match="EOFError"):
        bitstream.gather(stream, spark.createDataFrame([("f1", 0, 10**7, 3)], "frame string, id long, start long, width int"), chunk=chunk).collect()


def test_nothing_to_write(spark):
    stream, layers = bitstream.write(spark.createDataFrame([], "frame string, layer int, parent long, flag long, width int"))
    assert stream.count() == layers.count() == 0
    assert bitstream.read_tree(stream, [3], 24).count() == 0


@pytest.mark.parametrize("dims", [[3], [1, 2, 3, 6]])
def test_trees_come_back(spark, dims):
    r = random.Random(4)
    codes = spark.createDataFrame([(f, c) for f in (1, 2) for c in {r.getrandbits(18) for _ in range(700 if f == 1 else 1)}], "frame long, code long")
    tree = ntree.symbols(codes, dims, 18).selectExpr("frame", "layer", "parent", "flag", "1 << dim as width")
    stream, layers = bitstream.write(tree, chunk=32, piece=100)
    back = bitstream.read_tree(stream, dims, 18, chunk=32)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tree.drop("width").collect()))
    assert {tuple(x) for x in bitstream.sizes(layers).collect()} == {tuple(x) for x in tree.groupBy("frame").agg({"*": "count", "width": "sum"}).selectExpr("frame", "`count(1)`", "`sum(width)`").collect()}


def test_prefix_sums_and_places(spark):
    r = random.Random(5)
    rows = [(f, r.randrange(1000), r.randrange(9)) for f in "ab" for _ in range(300)]
    df = placed(spark.createDataFrame(rows, "frame string, t int, v int").repartition(4), ["t", "v"])
    got = sorted((x.frame, x.k, x.t, x.v, x.s) for x in prefix(df, "v", "s", block=17).collect())
    for f in "ab":
        own, run = [x for x in got if x[0] == f], 0
        assert [x[1] for x in own] == list(range(300)) and [x[2:4] for x in own] == sorted(x[1:] for x in rows if x[0] == f)
        for x in own:
            assert x[4] == run
            run += x[3]
