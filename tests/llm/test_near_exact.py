"""Near-duplicates link all similar pairs, also in crowds that have no centre and among texts that share very frequent shingles."""

import random

import numpy as np
import pytest

from octarine.llm import simhash

WORDS = [f"w{k}" for k in range(3000)]


def sets_of(texts):
    return [frozenset(simhash.shingles(simhash.words_of(t)).tolist()) for t in texts]


def crowds(seed):
    """Walks that drift away from one text in many directions, so that neighbours of a walk are alike and no text is like all; all texts share a passage."""
    r = random.Random(seed)
    passage = [f"common{k}" for k in range(20)]
    base, out = [r.choice(WORDS) for _ in range(80)], []
    for _ in range(25):
        now = list(base)
        for _ in range(8):
            now = list(now)
            for k in r.sample(range(len(now)), r.choice([1, 1, 2])):
                now[k] = r.choice(WORDS)
            out.append(" ".join(now))
    out += [" ".join([r.choice(WORDS) for _ in range(40)] + passage) for _ in range(60)]
    return out + [out[0], "one two", "one two three", "", " ".join(passage)]


def parts(n, pairs):
    lead = list(range(n))

    def top(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in pairs:
        lead[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


def test_all_similar_pairs_are_linked(spark):
    texts = crowds(3)
    sets = sets_of(texts)
    like = lambda x, y: x == y or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9)
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if like(sets[a], sets[b])]
    want = parts(len(sets), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(simhash.heavy_shingles(df)) > 0  # the passage is met at last
    marked = simhash.signatures(df).dropDuplicates(["key"])
    linked = {(x.a, x.b) for x in simhash.like_pairs(marked, df).collect()}
    signed = lambda k: k - (1 << 64) if k >= 1 << 63 else k
    keys = [signed(simhash.key_of(simhash.shingles(simhash.words_of(t)))) for t in texts]
    first = {k: x for x, k in reversed(list(enumerate(keys)))}
    assert linked <= {tuple(sorted((keys[a], keys[b]))) for a, b in pairs}
    assert parts(len(texts), [(first[a], first[b]) for a, b in linked] + [(first[k], x) for x, k in enumerate(keys)]) == want
    assert {x.doc_id for x in simhash.near_unique(df).collect()} == set(want)


def test_no_first_shingle_is_of_a_passage_that_all_share(spark):
    """A passage longer than what is a text's own: wherever its shingles' hashes lie, none of them is among a text's first fifth, at which texts meet."""
    r = random.Random(5)
    passage = [f"common{k}" for k in range(120)]
    texts = [" ".join([f"own{r.random()}" for _ in range(80)] + passage) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    shared = simhash.signatures(df).selectExpr("explode(first) s").groupBy("s").count().where("count > 1")
    assert shared.count() == 0


@pytest.mark.parametrize("every", [0, 1, 3])
def test_which_shingles_count_as_heavy_changes_no_result(spark, monkeypatch, every):
    """They are judged by some texts and are no more than so many; none of them, all, or any third of them put the shingles in another order, and the same documents stay."""
    texts = crowds(6)
    sets = sets_of(texts)
    like = lambda x, y: x == y or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9)
    want = parts(len(sets), [(a, b) for b in range(len(sets)) for a in range(b) if like(sets[a], sets[b])])
    found = np.array(sorted(set().union(*sets))[:: every or 1], np.uint64)[: None if every else 0]
    random.Random(every).shuffle(order := found.tolist())
    monkeypatch.setattr(simhash, "heavy_shingles", lambda docs, words: np.array(order, np.uint64))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in simhash.near_unique(df).collect()} == set(want)
