"""Centroids, aligned tokenizers and the trie: against plain versions and the libraries."""

import hashlib
import random

import numpy as np
import pytest
from oracle import differences
from pyspark.sql import Row
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from octarine.llm import alignment, centroids, trie_bpe

SIGNS = "aábç 's'\n\t  re.1²٣\x1c\x85　!?-_日本😀ΣİſÑß½ªµ▁"


def texts(seed, n=1500):
    r = random.Random(seed)
    out = ["".join(r.choice(SIGNS) for _ in range(r.randrange(40))) for _ in range(n)]
    out += ["".join(r.choice("abcé ") for _ in range(r.randrange(60))) for _ in range(n)]
    out += ["".join(r.choice(["<|startoftext|>", "<|endoftext|>", "<s>", "<0x41>", "a", " ", "<|", "é", "'s"]) for _ in range(r.randrange(9))) for _ in range(n)]
    out += ["".join(r.choice("etaoinshr") for _ in range(r.randrange(250, 600))) for _ in range(40)]
    return [*out, "a" * 20_000, "ab" * 9_000, "éß" * 700, "the quick brown fox\njumps over the lazy dog " * 500, " ", "", None]


# ---- centroids


def slow_clusters(rows, k=16, rounds=3):
    import math

    kept = [(i, [math.floor(64 * float(v)) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [q for _, q in kept[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in range(len(cs)):
            own = [q for (_, q), o in zip(kept, of, strict=True) if o == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(q)) for i, q in kept]
    sums = {j: sum(d for _, d, o in found if o == j) for j in range(len(cs))}
    return sorted((i, o, d, sums[o], sum(sums.values()), hashlib.sha256(",".join(map(str, cs[o])).encode()).hexdigest()) for i, d, o in found)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, note string").repartition(3)


@pytest.mark.parametrize("seed, n", [(1, 300), (2, 40), (3, 9)])
def test_clusters_by_brute_force(spark, seed, n):
    r = np.random.default_rng(seed)
    rows = [(k, r.normal(size=64).astype(np.float32).tolist()) for k in range(n)]
    rows += [(k + n, rows[k][1]) for k in range(n // 3)] + rows[:3]  # equal vectors, repeated rows
    rows += [(9001, None), (9002, []), (9003, [1.0] * 63), (9004, [None] + [1.0] * 63), (9005, [float("nan")] + [1.0] * 63), (9006, [float("inf")] * 64)]
    got = centroids.cluster(vectors(spark, [(*x, "own", "n") for x in rows])).collect()
    found = sorted((g.vec_id, g.cluster, g.distance, g.cluster_inertia, g.inertia, g.centroid_sha256) for g in got)
    assert found == slow_clusters(rows)
    assert {g.note for g in got} == {"n"}


def test_no_vectors_and_large_components(spark):
    assert centroids.cluster(vectors(spark, [])).count() == 0
    assert centroids.cluster(vectors(spark, [(1, [1.0], "", "")])).count() == 0
    with pytest.raises(Exception, match="a component is over"):
        centroids.cluster(vectors(spark, [(1, [3e9] * 64, "", "")])).collect()
    big = [(k, [float((-1) ** (j * k) * (1 << 21)) for j in range(64)]) for k in range(6)]
    got = centroids.cluster(vectors(spark, [(*x, "", "") for x in big]), rounds=2)
    assert sorted((g.vec_id, g.cluster, g.distance, g.cluster_inertia, g.inertia, g.centroid_sha256) for g in got.collect()) == slow_clusters(big, rounds=2)


def test_products_follow_changes():
    r = np.random.default_rng(5)
    q, old = r.integers(-99, 99, (50, 8)), r.integers(-99, 99, (4, 8))
    new = old.copy()
    new[1, 3], new[2] = 7, 0
    assert (centroids.changed(q @ old.T, q, old, new) == q @ new.T).all()


def test_clusters_equal_sql(spark, sf):
    assert differences(centroids.op11_centroid_clustering(spark, sf), centroids.OP11_SQL, sf) == (0, 0)


# ---- aligned tokenizers


@pytest.fixture(scope="module")
def both():
    a, b = Tokenizer.from_file(alignment.BYTE_BPE), SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    a.encode_special_tokens = True
    names = {k: bytes(map(alignment.byte_characters().__getitem__, t)) for t, k in a.get_vocab(with_added_tokens=False).items()}
    return a, b, names


def slow_tokens(both, text):
    """Ids with the bytes that they cover, of either tokenizer."""
    a, b, names = both
    if not text:
        return [], []
    one = [(k, names[k]) for k in a.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    two = [(k, piece(k)) for k in b.encode(text)]
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (one, two)):
        return [], []
    out = []
    for side in (one, two):
        spans, at = [], 0
        for k, x in side:
            spans.append((k, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def slow_figures(both, rows):
    found = []
    for i, text in rows:
        a, b = slow_tokens(both, text)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            inside = [",".join(str(k) for k, s, e in side if start <= s and e <= end) for side in (a, b)]
            groups.append("|".join(inside))
            start = end
        pairs = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e] if len(a) < 60 else near_pairs(a, b)
        found.append((i, len(a), len(b), groups, pairs))
    count, best = {}, {}
    for *_, pairs in found:
        for p in pairs:
            count[p] = count.get(p, 0) + 1
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted((i, na, nb, len(g), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), digest(g)) for i, na, nb, g, p in found)


def near_pairs(a, b):
    """As above, with the tokens of b sought from where the one before began."""
    out, j = [], 0
    for x, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((x, b[k][0]))
            k += 1
    return out


def test_links_by_brute_force(spark, both):
    rows = list(enumerate(texts(7, 300)))
    rows += [(7, rows[3][1]), rows[5], rows[5]]  # a repeated id, repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", docs_column()).repartition(5)
    got = alignment.link_figures(docs)
    assert sorted(map(tuple, got.collect())) == slow_figures(both, rows)
    assert alignment.link_figures(docs.where("false")).count() == 0
    assert alignment.link_figures(docs.where("doc_id < 0 or text is null")).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("a column of the caller's")


def test_groups_of_ids(spark, both):
    rows = [Row(doc_id=k, text=x, at=str(k)) for k, x in enumerate(texts(8, 200))]
    for r in alignment.align(spark.createDataFrame(rows).repartition(3)).collect():
        a, b = slow_tokens(both, rows[r.doc_id].text)
        assert r.at == str(r.doc_id)
        assert [x for g in r.groups for x in g.a] == [x for x, *_ in a] and [x for g in r.groups for x in g.b] == [x for x, *_ in b]
        assert len(r.groups) == len({e for *_, e in a} & {e for *_, e in b})


def test_whole_corpus_by_brute_force(spark, sf, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, alignment.op12_cross_tokenizer(spark, sf).collect())) == slow_figures(both, rows)


# ---- the trie


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(trie_bpe.VOCABULARY)


@pytest.mark.parametrize("cache, nodes", [(16, 50), (100_000, 100_000)])
def test_trie_equals_library(library, cache, nodes):
    own, r = trie_bpe.Codec(cache=cache, nodes=nodes), random.Random(3)
    names = [t.removesuffix("</w>") for t in library.get_vocab()]
    all_ = texts(9) + ["".join(r.choice(names) for _ in range(r.randrange(1, 5))) for _ in range(3000)]
    for part in (all_[:2500], all_[2000:]):
        own.learn(part)
        for x in part:
            ids = np.frombuffer(own.encode(x), "<u4").tolist()
            assert ids == library.encode(x or "", add_special_tokens=False).ids, x
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_trie_shares_prefixes(library):
    own = trie_bpe.Codec()
    words = own.trie.encode({"internation", "international", "internationally", "interest"})
    assert len(own.trie.last) == 1 + len({w[:k] for w in words for k in range(1, len(w))})
    assert all(np.frombuffer(x, "<u4").tolist() == library.encode(w, add_special_tokens=False).ids for w, x in words.items())


def test_trie_over_tables(spark, sf, library):
    def wanted(x):
        ids = library.encode(x or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {r.doc_id: wanted(r.text) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in trie_bpe.op13_trie_bpe(spark, sf).collect()} == known
    rows = spark.createDataFrame(list(enumerate(texts(10, 100))), "k long, text string").selectExpr("k", "text", "'mine' as ids", "k as n_tokens")
    coded = trie_bpe.encode(rows)
    assert coded.columns == ["k", "n_tokens", "ids"] and coded.where("k = n_tokens").count() == rows.count()
    told = {r.k: (r.ids, r.text) for r in coded.join(trie_bpe.decode(coded).select("k", "text"), "k").collect()}
    for r in rows.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert told[r.k] == (ids, library.decode(ids, skip_special_tokens=False))
    assert trie_bpe.round_trip(rows.where("false")).count() == 0


# ---- line dedup leaves callers' columns alone


def test_line_dedup_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    from octarine.llm import line_dedup

    run = "\n".join(["one two three four five six", "seven eight nine ten"])
    names = ("_id", "_key", "_gone", "_own", "key", "pos", "upto", "gid")
    df = spark.createDataFrame([(1, run), (2, f"first\n{run}"), (3, None), (None, "")], "doc_id long, text string")
    df = df.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in names], F.lit(7).alias("n_lines"))
    got = {g.doc_id: g for g in line_dedup.dedup(df).collect()}
    assert {i: (g.text, g.n_lines, g.n_removed) for i, g in got.items()} == {1: (run, 2, 0), 2: ("first", 3, 2), 3: (None, 0, 0), None: ("", 1, 0)}
    assert all(g[n] == f"{n}{'null' if i is None else i}" for i, g in got.items() for n in names)
    assert line_dedup.dedup(df.where("false")).count() == 0
