"""Every coder of codes, through its streams and its tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from octarine.functions import ranges as R
from octarine.operators import coding, ntree


def rows_of(seed, width, sizes):
    r = random.Random(seed)
    return sorted({(f, r.getrandbits(width) & (r.getrandbits(width) if f % 2 else -1)) for f, n in enumerate(sizes) for _ in range(n)})


def test_bits_are_packed_as_one_by_one():
    r = np.random.default_rng(1)
    widths = r.integers(0, 65, 300)
    values = np.array([int(r.integers(0, 1 << min(int(w), 62))) if w else 0 for w in widths], np.int64)
    slow = R.BitWriter()
    for v, w in zip(values.tolist(), widths.tolist(), strict=True):
        slow.write(v, w)
    assert R.pack(values, widths) == bytes(slow)
    assert (R.Bits(bytes(slow)).many(widths) == values).all()
    with pytest.raises(EOFError):
        R.Bits(b"a").many(np.array([9]))


@pytest.mark.parametrize(("dims", "payload"), [((3,), False), ((2, 3, 5), True), ((0,), False), ((0, 0, 2, 3), True), ((-1,), True), ((-1, -1, 1), False), ((-2,), True)])
def test_streams_come_back(spark, dims, payload):
    width = 13
    rows = rows_of(2, width, (40, 1, 90, 2))
    codes = spark.createDataFrame(rows, "frame int, code long")
    made = coding.symbols(codes, dims, width, payload)
    written = coding.write(*made, archive=True)
    sizes = codes.groupBy("frame").agg(F.count(F.lit(1)).alias("out_points"))
    back = coding.read(written.join(sizes, "frame"), dims, width, payload).collect()
    assert sorted(map(tuple, back)) == rows
    for r in written.collect():
        assert len(r.flags) == -(-r.flag_bits // 8) and len(r.payload) == -(-r.payload_bits // 8) and r.archive
    if min(ntree.plan_dims(dims, width)) > 0:
        assert sorted(map(tuple, coding.decode(*made, dims, width).collect())) == rows
    if dims == (-2,):
        assert sorted(map(tuple, coding.decode_permutation(*made, width).collect())) == rows


def test_differences_of_frames_come_back(spark):
    r = random.Random(3)
    rows = sorted({(f, r.getrandbits(9)) for f in range(6) for _ in range(40)})
    flags = ntree.symbols(spark.createDataFrame(rows, "frame_no int, code long"), [3], 9, by=["frame_no"])
    want = flags.select("frame_no", "layer", "parent", "flag")
    got = coding.undo_differences(ntree.differential(flags).drop("flag")).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize(("dims", "payload"), [((3,), False), ((2, 3, 5), True), ((0,), False), ((0, 0, 2, 3), True), ((-1,), True), ((-1, -1, 1), False)])
def test_chunked_streams_come_back(spark, dims, payload):
    width = 9
    rows = rows_of(4, width, (40, 1, 90, 2))
    codes = spark.createDataFrame(rows, "frame int, code long")
    made = coding.symbols(codes, dims, width, payload)
    flags, tails, sizes = coding.write_streams(*made, chunk=16)
    told = {r.frame: (r.n, r.flag_bits, r.payload_bits) for r in sizes.collect()}
    assert told == {r.frame: (r.n, r.flag_bits, r.payload_bits) for r in coding.write(*made).collect()}
    back = coding.read_streams(flags, tails, codes.groupBy("frame").agg(F.count(F.lit(1)).alias("out_points")), dims, width, payload, chunk=16)
    assert sorted(map(tuple, back.collect())) == rows
