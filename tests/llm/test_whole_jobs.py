"""Cases in which the training-data operators once did less than the whole job."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from octarine.llm import language_id, simhash

# --- 4: languages


def syllables(r, own, words):
    return " ".join("".join(r.choice(own) for _ in range(r.randrange(1, 4))) for _ in range(words))


def noise(r, letters, words):
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 10))) for _ in range(words))


def test_foreign_texts_are_rejected_at_any_length(spark):
    r = random.Random(4)
    own = {
        "aa": "ka lo me ra ti no sa vel por mun des ga ri tol ben si".split(),
        "bb": "sch ung ter gru ck ptz eit lich ver auf zen ach mit kel or un".split(),
    }
    rows = [(k, syllables(r, own[("aa", "bb")[k % 2]], r.choice((4, 8, 20, 60, 150, 400, 900))), ("aa", "bb")[k % 2]) for k in range(900)]
    rows += [(k, "sa " * 300, "aa") for k in range(900, 930)]  # junk
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang"))
    sizes = (5, 10, 20, 60, 200, 1000, 5000)
    clean = [syllables(r, own[k], n) for k in own for n in sizes for _ in range(5)]
    names, _, far = model.predict(clean)
    assert names == [k for k in own for _ in sizes for _ in range(5)] and not any(far)
    foreign = [noise(r, a, n) for a in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя") for n in sizes for _ in range(5)]
    foreign += [syllables(r, "xi qua dhy jyu фо wö hwae oqu".split(), n) for n in sizes for _ in range(5)]
    far = model.predict(foreign)[2]
    assert sum(far) >= 0.97 * len(far)


def test_sparse_sizes_share_their_neighbours_threshold():
    import numpy as np

    size = np.array([900] * 80 + [30] * 2)
    least = language_id.thresholds(0.02 * np.sqrt(size), size)
    assert (least > 0.01).all() and (least < 0.02).all()
    assert not language_id.thresholds(np.zeros(0), np.zeros(0)).any()


# --- pipeline: near-duplicates


def slow_sets(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def like_groups(rows):
    """The number of each row's group, by all pairs of different sets."""
    found = [slow_sets(t) for _, t in rows]
    names = {x: k for k, x in enumerate(dict.fromkeys(found))}
    group = list(range(len(names)))
    some = list(names)
    holders = {}
    for k, x in enumerate(some):
        for g in x:
            holders.setdefault(g, []).append(k)
    for i, a in enumerate(some):
        for j in {j for g in a for j in holders[g] if j < i}:
            b = some[j]
            if group[i] != group[j] and len(a & b) >= 0.8 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    return [group[names[x]] for x in found]


def first_of_like(rows):
    least = {}
    of = like_groups(rows)
    for (d, _), g in zip(rows, of, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return {d for (d, _), g in zip(rows, of, strict=True) if d is None or d == least[g]}


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(12)
    rows, words = [], [f"w{k}" for k in range(400)]
    for _ in range(30):
        base = [r.choice(words) for _ in range(r.choice((12, 60, 300)))]
        for _ in range(r.randrange(1, 7)):
            copy = list(base)
            for _ in range(r.randrange(len(base) // 45 + 2)):
                copy[r.randrange(len(base))] = f"w{r.randrange(400, 999)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (None, rows[9][1]), (905, "a b c d e f g h"), (906, "a b c d e f g h i")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    keep = first_of_like(rows)
    assert sorted(x.doc_id or -1 for x in got.collect()) == sorted(d or -1 for d in keep)
    assert len(keep) < len({slow_sets(t) for _, t in rows}) - 10
    assert simhash.like_groups(df.limit(0)).count() == 0 and simhash.near_unique(df.limit(0)).count() == 0


def test_a_star_of_copies_is_one_group(spark):
    r = random.Random(13)
    words = [f"word{k}" for k in range(2000)]
    base = [r.choice(words) for _ in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 150):
        copy = list(base)
        for _ in range(8):
            copy[r.randrange(400)] = f"edit{r.randrange(9999)}"
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join(r.choice(words) for _ in range(400))) for k in range(50)]
    kept = {x.doc_id for x in simhash.near_unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == first_of_like(rows)
    assert len([k for k in kept if k < 1000]) <= 3


def test_near_unique_judges_rows_by_id_and_text(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, b), (5, b), (5, a), (7, a), (3, b)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, _id string").withColumn("lead", F.lit(1)).withColumn("key", F.lit(2))
    got = simhash.near_unique(df)
    assert got.columns == df.columns
    assert sorted((x.doc_id, x.text) for x in got.collect()) == [(3, b), (3, b), (5, a)]
