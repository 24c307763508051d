"""Near-duplicates at the edge of the least similarity: tails, cuts, scattered edits and chains of revisions."""

import random

import pytest
from pyspark.sql import functions as F

from octarine.llm import simhash

WORDS = [f"w{k}" for k in range(5000)]


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def similar(one, two):
    a, b = shingles(one), shingles(two)
    return len(a & b) / len(a | b)


def edited(r, words, n):
    while True:
        out = list(words)
        for k in r.sample(range(len(out)), n):
            out[k] = r.choice(WORDS)
        if out != words and similar(words, out) >= 0.8:
            return out


def groups_of(kind, n, seed):
    r, out = random.Random(seed), []
    for _ in range(n):
        text = [r.choice(WORDS) for _ in range(r.randrange(100, 400))]
        if kind == "tails":
            out.append([text, text + [r.choice(WORDS) for _ in range(int((len(text) - 4) * 0.24))]])
        elif kind == "cuts":
            out.append([text, text[int((len(text) - 4) * 0.19) :]])
        elif kind == "edits":
            out.append([text, edited(r, text, max(1, len(text) // 60))])
        else:
            chain = [text[:100] + [r.choice(WORDS) for _ in range(100)]]
            while len(chain) < 12:
                chain.append(edited(r, chain[-1], 3))
            out.append(chain)
        assert all(similar(a, b) >= 0.8 for a, b in zip(out[-1], out[-1][1:], strict=False))
    return out


@pytest.mark.parametrize("kind, n, least", [("tails", 150, 0.95), ("cuts", 150, 0.95), ("edits", 100, 0.95), ("chains", 20, 0.9)])
def test_later_ones_go(spark, kind, n, least):
    groups = groups_of(kind, n, 5)
    rows = [(k, g, " ".join(x)) for k, (g, x) in enumerate((g, x) for g, own in enumerate(groups) for x in own)]
    df = spark.createDataFrame(rows, "doc_id long, own long, text string").repartition(4)
    kept = simhash.near_unique(df).select("doc_id", "own").collect()
    assert {x.own for x in kept} == set(range(n))  # none is lost whole
    assert (len(rows) - len(kept)) / (len(rows) - n) >= least


def test_fingerprints_differ_with_the_sets():
    r = random.Random(6)
    a = [r.choice(WORDS) for _ in range(2000)]
    b = a + [r.choice(WORDS) for _ in range(480)]
    one, two = (simhash.slots(simhash.shingles([w.encode() for w in x])) for x in (a, b))
    off = sum(int(x ^ y).bit_count() for x, y in zip(one.tolist(), two.tolist(), strict=True))
    assert abs(off / (simhash.TABLES * simhash.SLOT_BITS) - (1 - similar(a, b)) / 2) < 0.05
    whole = simhash.slots(simhash.shingles([b"x%d" % k for k in range(3 * simhash.SHINGLES)]))
    assert len(whole) == simhash.TABLES and (whole >> simhash.SLOT_BITS).tolist() == list(range(simhash.TABLES))


def crowded(seed):
    r = random.Random(seed)
    fps = {r.getrandbits(20) for _ in range(60)}
    fps |= {f ^ 1 << r.randrange(20) ^ 1 << r.randrange(20) for f in list(fps) for _ in range(3)}
    return fps | {min(fps) ^ 1 << k for k in range(20)}  # a crowd around one value


def test_pairs_link_what_all_pairs_link(spark):
    fps = crowded(7)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")

    def parts(pairs):
        lead = {f: f for f in fps}

        def top(f):
            while lead[f] != f:
                f = lead[f]
            return f

        for a, b in pairs:
            lead[max(top(a), top(b))] = min(top(a), top(b))
        return {f: top(f) for f in fps}

    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    got = [(x.a, x.b) for x in simhash.near_pairs(df, 2, 20).collect()]
    assert set(got) <= set(near) and parts(got) == parts(near)
    assert simhash.near_pairs(df.where(F.lit(False)), 2, 20).count() == 0


def test_one_other_from_the_most_crowded_variant(spark):
    fps = crowded(8)
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    steps = [0, *[1 << k for k in range(20)]]
    at = {}
    for f in fps:
        for k, m in enumerate(steps):
            at.setdefault(f ^ m, []).append((k, f))
    best = {}
    for met in at.values():
        met.sort()
        for k, (_, f) in enumerate(met):
            if len(met) > 1:
                best[f] = max(best.get(f, (0, 0)), (len(met), met[0 if k else 1][1]))
    got = {x.a: x.b for x in simhash.nearest_crowds(df, 20).collect()}
    assert got == {f: other for f, (_, other) in best.items()}
    assert simhash.nearest_crowds(df.where(F.lit(False)), 20).count() == 0
