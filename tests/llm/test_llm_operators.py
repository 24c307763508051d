"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from octarine.llm import bpe, chat_format, common, decontamination, language_id, line_dedup, lm_scoring, quality_rules, simhash, suffix_dedup, url_filters

DOC = "doc_id long, text string"


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], DOC)


# --- components


def test_components_by_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(500, 600 + k) for k in range(200)] + [(7, 7), (None, 3), (-5, 2)]
    got = dict(common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for x in parent}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: suffix arrays


def removed(rows):
    data = [(LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for key, _, b in sorted(data, key=lambda x: x[0]):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], key)
    out = []
    for key, i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key:
                gone[k : k + 50] = b"\1" * 50
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(b), tuple(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return Counter(out)


LAST = suffix_dedup.LAST


@pytest.mark.parametrize("letters", ["ab", "abcdefgh \0é"])
def test_suffix_dedup_by_brute_force(spark, letters):
    r = random.Random(7)
    pool = ["".join(r.choice(letters) for _ in range(r.randrange(40, 160))) for _ in range(6)]
    rows = []
    for k in range(120):
        text = "".join(r.choice(pool)[r.randrange(40) :] + "".join(r.choice(letters) for _ in range(r.randrange(20))) for _ in range(r.randrange(4)))
        rows.append((k, text))
    rows += [(3, rows[5][1]), (3, rows[5][1]), (None, rows[8][1]), (9, None), (500, "x" * 5000), (501, "x" * 70)]
    df = docs(spark, rows).withColumn("kept", F.lit(1)).repartition(3)
    got = suffix_dedup.dedup(df, block_bytes=1500).collect()
    assert Counter((g.doc_id, g.n_bytes, tuple(tuple(s) for s in g.spans), bytes(g.kept)) for g in got) == removed(rows)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.dedup(empty(spark)).count() == 0
    assert suffix_dedup.dedup(docs(spark, [(1, None), (2, "")])).count() == 2


# --- 2: urls


def test_rules(spark):
    urls = [("HTTP://Sub.Example.ORG/en/12?x", "block", "example.org/en/1"), ("http://example.org/en/2", "allow", "org/"), ("http://badexample.org/es/", "allow", "org/"), ("http://a.com/de/x", "block", "com/de/"), ("http://a.com/fr/", "allow", "com/fr/"), ("http://a.org", "allow", None), ("nothing", "allow", None), (None, "allow", None), ("x://h#a://org/", "allow", None), ("http://org/", "allow", "org/")]
    df = spark.createDataFrame([(k, u, None, "clash") for k, (u, *_) in enumerate(urls)], "page_id int, url string, html string, host string")
    for rules in (url_filters.RULES, spark.createDataFrame(url_filters.RULES, "verdict string, rule string")):
        got = {r.page_id: (r.verdict, r.rule) for r in url_filters.judge(df, rules).collect()}
        assert got == {k: (v, rule) for k, (_, v, rule) in enumerate(urls)}
    first = url_filters.judge(df).orderBy("page_id").first()
    assert (first.host, first.path) == ("sub.example.org", "/en/12")


def test_block_decisions_spread(spark):
    link = lambda u: f'<html><head><LINK href="{u}" REL=canonical></head>'
    move = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    pages = [
        ("http://one.net/a", link("http://two.net/b")),
        ("http://two.net/b", move("http://bad.com/de/1")),
        ("http://three.net/c", link("http://one.net/a#top")),
        ("http://four.net/", "<p>canonical</p>"),
        ("http://good.org/", link("http://five.net/")),
        ("http://five.net/", move("http://bad.com/de/2")),
        ("http://bad.com/de/2", None),
        ("http://six.net/x", link("/y")),
        ("http://six.net/y", move("//bad.com/de/9")),
        ("http://six.net/y", None),
    ]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id int, url string, html string")
    got = [r.verdict for r in url_filters.judge(df).orderBy("page_id").collect()]
    assert got == ["block", "block", "block", "allow", "allow", "allow", "block", "block", "block", "block"]
    assert url_filters.judge(df.limit(0)).count() == 0


def test_links_are_resolved_by_their_page(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    cases = [
        ("http://a.net/x/y.html", link("z.html"), "http://a.net/x/z.html"),
        ("http://a.net/x/y.html?q", link("../z?a=1&amp;b=2"), "http://a.net/z?a=1&b=2"),
        ("http://a.net", link("z"), "http://a.net/z"),
        ("http://a.net/x/y", link("?k=1"), "http://a.net/x/y?k=1"),
        ("http://a.net/x/y", link("./a/./b/../../../../c/."), "http://a.net/c/"),
        ("https://a.net/x", link("//B.net/q"), "https://B.net/q"),
        ("http://a.net/x/y", '<base href="/deep/er/">' + link("z"), "http://a.net/deep/er/z"),
        ("http://a.net/x/y", "<base href='http://c.net/d/e'>" + "<meta http-equiv=refresh content=\"0;URL=z#top\">", "http://c.net/d/z#top"),
        ("http://a.net/x", "<link rel=canonical href=/plain>", "http://a.net/plain"),
    ]
    df = spark.createDataFrame([(u, h) for u, h, _ in cases], "url string, html string")
    assert [r.target for r in url_filters.link_edges(df).collect()] == [x for *_, x in cases]


def test_ties_of_rules_allow(spark):
    rules = [("block", "b.org/ab"), ("allow", "a.b.org/"), ("block", "c.net/"), ("allow", "c.net/")]
    df = spark.createDataFrame([(1, "http://a.b.org/abc", None), (2, "http://c.net/", None)], "page_id int, url string, html string")
    for given in (rules, rules[::-1], spark.createDataFrame(rules, "verdict string, rule string"), spark.createDataFrame(rules[::-1], "verdict string, rule string")):
        assert {(r.rule, r.verdict) for r in url_filters.judge(df, given).collect()} == {("a.b.org/", "allow"), ("c.net/", "allow")}


def test_random_links_by_union_find(spark):
    r = random.Random(15)
    urls = [f"http://s{k}.{r.choice(['net', 'net', 'net', 'com/de', 'org'])}/{k}" for k in range(80)] + [None, "x" * 5000, "http://s1.net/" + "y" * 50_000]
    edges = [(r.choice(urls[:80]), r.choice(urls[:80])) for _ in range(40)] + [(urls[0], None), (urls[0], urls[0])]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b:
            parent[find(a)] = find(b)
    own = lambda u: None if not u else "allow" if ".org/" in u else "block" if ".com/de/" in u else None
    words = {}
    for u in urls[:80]:
        words.setdefault(find(u), set()).add(own(u))
    want = [own(u) or ("allow" if u not in parent or "allow" in words[find(u)] or "block" not in words[find(u)] else "block") for u in urls]
    df = spark.createDataFrame([(k, u, None, "clash") for k, u in enumerate(urls)] * 2, "page_id int, url string, html string, word string").withColumn("_key", F.lit(1))
    got = url_filters.judge(df, edges=spark.createDataFrame(edges, "source string, target string"))
    assert set(df.columns) < set(got.columns)
    assert sorted((x.page_id, x.verdict) for x in got.collect()) == sorted([*enumerate(want)] * 2)
    assert "block" in {w for u, w in zip(urls, want, strict=True) if not own(u)}


# --- 3: language model


def slow_base(rows):
    import math

    token = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(token(t)), sum(w in c for w in token(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token(t)), 6)) for i, t in rows]


def test_base_scores(spark):
    r = random.Random(5)
    words = ["the", "of", "Été", "a\x1cb", "x\x85y", *[f"w{k}" for k in range(400)]]
    rows = [(k, " \t\n".join(r.choice(words[: 5 + 20 * (k % 20)]) for _ in range(r.randrange(60)))) for k in range(80)]
    rows += [(81, None), (82, ""), (83, "only here"), (3, rows[3][1]), (3, rows[3][1]), (None, "the of"), (84, "LONG " * 20_000)]
    df = docs(spark, rows).withColumn("score", F.lit("clash")).withColumn("held_out", common.remainder(F.col("doc_id"), 5) == 1)
    got = lm_scoring.score(df).collect()
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == Counter(slow_base(rows))
    assert all(g.score < 0 for g in got)


def test_scores_without_training_rows(spark):
    df = docs(spark, [(1, "a b"), (2, None)]).withColumn("held_out", F.lit(True))
    got = lm_scoring.score(df).collect()
    assert {(g.n_tokens, g.n_known, g.train_tokens) for g in got} == {(3, 0, 0), (1, 0, 0)}
    assert lm_scoring.score(df.limit(0)).count() == 0


def test_a_contexts_probabilities_sum_to_one():
    import numpy as np

    r = np.random.default_rng(3)
    model = lm_scoring.LogBilinear(r.integers(0, 500, 97))
    units = r.integers(0, 97, 5000)
    model.train([(*lm_scoring.contexts(units, np.array([4000, 1, 999]), 97), units)], 1)
    for one, two in ((97, 97), (0, 97), (5, 96)):
        each = lm_scoring.LogBilinear.log_probabilities(model, np.full(97, one), np.full(97, two), np.arange(97))
        assert (10.0**each).sum() == pytest.approx(1, abs=1e-4)
        h = model.r[one].astype(float) * model.c[0] + model.r[two].astype(float) * model.c[1]
        for u in range(97):  # slowly, in double precision
            k = u // model.size
            of = np.exp(h @ model.s.T.astype(float) + model.d)
            inside = np.exp(h @ model.q[k * model.size : (k + 1) * model.size].T.astype(float) + model.b[k * model.size : (k + 1) * model.size])
            assert each[u] == pytest.approx(np.log10(of[k] / of.sum() * inside[u % model.size] / inside.sum()), abs=1e-4)


def test_contexts_end_with_the_text():
    import numpy as np

    one, two = lm_scoring.contexts(np.array([5, 6, 7, 8, 9]), np.array([3, 1, 1]), 99)
    assert one.tolist() == [99, 5, 6, 99, 99] and two.tolist() == [99, 99, 5, 99, 99]


def test_model_learns_what_follows_what(spark):
    r = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    follow = {w: r.sample(words, 3) for w in words}
    rows = []
    for k in range(500):
        text = [r.choice(words)]
        while len(text) < 80:
            text.append(r.choice(follow[text[-1]]) if r.random() < 0.8 else r.choice(words))
        rows.append((k, " ".join(text)))
    got = lm_scoring.score(docs(spark, rows).withColumn("held_out", common.remainder(F.col("doc_id"), 5) == 1)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.2


# --- 4: languages


def test_languages(spark):
    r = random.Random(8)
    own = {"aa": "kalo mera tino", "bb": "schtr gruck ptzt", "cc": "ñañe ççi øøra"}
    rows = []
    for k in range(240):
        lang = r.choice(list(own))
        rows.append((k, " ".join(r.choice(own[lang].split()) + r.choice("abc") for _ in range(r.randrange(5, 80))), lang))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 ...!", "cc"), (903, "kalo mera", None), (904, "kalo mera tino " * 20_000, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.fit(language_id.known_part(df))
    got = {g.doc_id: g for g in language_id.predict(df, model).collect()}
    assert model.languages == ["aa", "bb", "cc"]
    assert [got[k].lang_pred for k in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "aa"]
    held = [k for k, _, _ in rows[:240] if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and sum(got[k].lang_pred == rows[k][2] for k in held) >= 0.97 * len(held)
    assert all(0 <= g.score <= 1 for g in got.values())
    assert language_id.predict(df.limit(0), model).count() == 0
    nothing = language_id.fit(df.select("text", "lang").limit(0))
    assert {g.lang_pred for g in language_id.predict(df, nothing).collect()} == {"und"}


# --- 5: chats


TURN = "conv_id long, turn long, role string, text string"


def slow_chats(rows, most):
    """(conv_id, part, n_turns, n_alike, chat) by comparing all conversations."""
    null = lambda x: (x is not None, x or "")
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda x: ((x[1] is not None, x[1] or 0), null(x[2] and x[2][:64]), null(x[3] and x[3][:64]), null(x[2]), null(x[3]))):
        convs.setdefault(c, []).append((role, text))
    out = []
    for c, turns in convs.items():
        alike = [x for x, t in convs.items() if t == turns]
        if any(len(t) > len(turns) and t[: len(turns)] == turns for t in convs.values()) or c != min(alike, key=lambda x: (x is not None, x or 0)):
            continue
        for k in range(0, len(turns), most):
            out.append((c, k // most, len(turns), len(alike), "".join(f"<|{r or ''}|>\n{t or ''}\n" for r, t in turns[k : k + most])))
    return sorted(out, key=str)


def chats(spark, rows, most=chat_format.PART):
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], f"{TURN}, number int, at string")
    return sorted((tuple(r) for r in chat_format.render(chat_format.maximal(df), most).collect()), key=str)


def test_chats(spark):
    base = [("user", "a"), ("assistant", "b"), ("user", None), (None, "d")]
    convs = {1: base, 2: base[:2], 3: base, 4: [("user", "x"), *base], 5: base[:3], 6: [("user", "a"), ("assistant", "other")], None: base[:1], 8: [("user", "lone")], 9: [("user", ""), ("", "q")], 10: [("user", None), (None, "q")]}
    rows = [(c, 10 * k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    got = chats(spark, rows)
    assert got == slow_chats(rows, chat_format.PART) and {x[0] for x in got} == {1, 4, 6, 8, 9, 10}
    assert chats(spark, []) == []


def test_a_null_is_no_text(spark):
    assert len(chats(spark, [(1, 0, None, "a"), (2, 0, "a", None)])) == 2


def test_places_not_numbers_cut_a_chat(spark):
    rows = [(1, 1000, "user", "a"), (1, 2000, "user", "b"), (1, -5, None, None)]
    got = chats(spark, rows)
    assert got == slow_chats(rows, chat_format.PART) and len(got) == 1


def test_random_chats_by_brute_force(spark):
    r = random.Random(14)
    rows = []
    for c in [None, *range(60)]:
        for k in range(r.randrange(1, 7)):
            rows.append((c, r.choice([None, k, k, 3]), r.choice([None, "", "u"]), r.choice([None, "", "x", "y" * 70 + r.choice("ab")])))
    assert chats(spark, rows, 2) == slow_chats(rows, 2)


def test_long_chats_come_in_parts(spark):
    n = 2 * chat_format.CHUNK + 5
    rows = [(1, k, "user", f"t{k}") for k in range(n)] + [(2, k, "user", f"t{k}") for k in range(n - 300)] + [(4, k, "user", "other" if k == n - 1 else f"t{k}") for k in range(n)] + [(3, None, "user", "t0"), (3, None, "user", "t0")]
    rows.append((5, 0, "user", "w" * 300_000))
    got = chats(spark, rows)
    assert [x for x in got if x[0] == 5][0][4] == f"<|user|>\n{'w' * 300_000}\n"
    assert {x[0] for x in got} == {1, 3, 4, 5}
    assert "".join(x[4] for x in sorted(x for x in got if x[0] == 1)) == "".join(f"<|user|>\nt{k}\n" for k in range(n))


# --- 6: tokens


def test_tokens_round_trip(spark):
    rows = [(1, "Hello  world's\n 12345 naïve 日本"), (2, None), (3, ""), (1, "again again"), (4, "word " * 30_000)]
    df = docs(spark, rows).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    encoded = bpe.encode(df.drop("n_tokens"))
    assert Counter(r.text for r in bpe.decode(encoded).collect()) == Counter((t or "") for _, t in rows)
    by = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    got = bpe.round_trip(df).collect()
    assert {r.decoded_sha256 for r in got} == by and len(got) == 5
    ids = {hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest(): len(r.ids) for r in encoded.collect()}
    assert {r.ids_sha256: r.n_tokens for r in got} == ids
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_other_patterns_cut_as_they_say(spark):
    import tiktoken

    for pattern in (r"\s+|\S+", r"(\w)(\w*)|\W", r"\w+"):
        own = bpe.Codec(pattern=pattern)
        public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
        for text in ("hello world", "two  spaces and\nlines", "naïve 日本 x1", " lead"):
            own.learn([text])
            assert own.encode(text) == public.encode_ordinary(text)


# --- 7: quality


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_statistics(spark):
    r = random.Random(9)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\x0by\x85z é|#\n\nx\n x\nx", "a a a a a", "w " * 40_000]
    texts += ["".join(r.choice("ab \n|é\t") for _ in range(r.randrange(120))) for _ in range(150)]
    df = docs(spark, list(enumerate(texts))).withColumn("_w", F.lit(1)).withColumn("n_lines", F.lit("clash"))
    for row in quality_rules.statistics(df).collect():
        want = slow_statistics(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, texts[row.doc_id]
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_rules_are_learned(spark):
    r = random.Random(10)
    rows, labels = [], []
    for k in range(240):
        words = [f"w{r.randrange(1000)}" for _ in range(80)]
        bad = k % 4 == 0
        rows.append((k, " ".join(w + "###" * bad for w in words)))
        if k < 200:
            labels.append((k, int(not bad)))
    labels += [(5, None), (None, 0), (4, 0)]
    got = {x.doc_id: x for x in quality_rules.judge(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(got[k].kept == (k % 4 != 0) for k in range(240))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(x.kept for x in quality_rules.judge(docs(spark, rows), none).collect())
    assert quality_rules.judge(empty(spark), none).count() == 0


# --- 8: fingerprints


def test_near_groups_by_brute_force(spark):
    r = random.Random(11)
    rows, words = [], [f"w{k}" for k in range(500)]
    for k in range(60):
        base = [r.choice(words) for _ in range(300)]
        for _ in range(r.randrange(1, 4)):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(300)] = "edit"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (5, rows[7][1]), (None, rows[9][1]), (905, "long " * 30_000)]
    got = simhash.near_groups(docs(spark, rows).withColumn("component_id", F.lit("clash"))).collect()
    fps = sorted({g.fp & (1 << 64) - 1 for g in got})
    group = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = {}
    for g in got:
        key = group[g.fp & (1 << 64) - 1]
        if g.doc_id is not None:
            least[key] = min(least.get(key, g.doc_id), g.doc_id)
    assert len(got) == len(rows) and all(g.component_id == least.get(group[g.fp & (1 << 64) - 1]) for g in got)
    assert len(set(least.values())) < len(fps)
    assert simhash.near_groups(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_pairs(empty(spark), 4)


# --- 9: lines


def slow_lines(rows, least):
    lines = {i: (t.split("\n") if t is not None else []) for i, t in rows}
    units = {i: [k for k, x in enumerate(ls) if x.split()] for i, ls in lines.items()}
    gone = {i: set() for i in lines}
    seen = {}
    order = sorted(lines, key=lambda i: (i is not None, i))
    for i in order:
        for a in range(len(units[i])):
            for b in range(a + 1, len(units[i]) + 1):
                block = tuple(lines[i][k] for k in units[i][a:b])
                if sum(len(x.split()) for x in block) >= least:
                    if block in seen:
                        gone[i] |= set(range(a, b))
                    else:
                        seen[block] = (i, a)
    out = {}
    for i, ls in lines.items():
        cut = set()
        for u in gone[i]:
            end = units[i][u + 1] if u + 1 < len(units[i]) else len(ls)
            cut |= set(range(units[i][u], end))
        out[i] = (None if dict(rows)[i] is None else "\n".join(x for k, x in enumerate(ls) if k not in cut), len(ls), len(cut))
    return out


def test_line_runs_by_brute_force(spark):
    r = random.Random(12)
    pool = ["a", "b b", "c c c", "d d d d", "", " ", "e e e e e e e"]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(9)))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "a\nb b\nc c c"), (102, "\n".join(["z z z z z z"] * 300))]
    df = docs(spark, rows).withColumn("_gone", F.lit(1)).withColumn("key", F.lit("clash"))
    for least in (6, 1):
        got = {g.doc_id: (g.text, g.n_lines, g.n_removed) for g in line_dedup.dedup(df, least).collect()}
        assert got == slow_lines(rows, least)
    twice = line_dedup.dedup(df.union(df), 6).collect()
    assert len(twice) == 2 * len(rows) and {g.doc_id: g.text for g in twice} == {i: x[0] for i, x in slow_lines(rows, 6).items()}
    assert line_dedup.dedup(empty(spark)).count() == 0


# --- 10: benchmark


def test_contaminated_pairs(spark):
    item = [f"w{k}" for k in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (None, "p q r s t u v")], "item_id long, text string")
    rows = [(1, "x " + " ".join(item[10:] + ["y"] + item[:10])), (2, " ".join(item[:9])), (3, None), (4, ""), (1, " ".join(item)), (5, "noise " * 30_000 + "P q, r s t u v!"), (None, " ".join(item))]
    df = docs(spark, rows).withColumn("item_id", F.lit("clash"))
    got = Counter((r.doc_id, r.item_id, r.n_words) for r in decontamination.pairs(df, bench).collect())
    assert got == Counter([(1, 1, 20), (1, 1, 20), (5, None, 7), (None, 1, 20)])
    assert sorted(r.doc_id for r in decontamination.clean(df, bench).collect()) == [2, 3, 4]
    assert decontamination.pairs(df, bench.limit(0)).count() == 0 and decontamination.clean(df, bench.limit(0)).count() == len(rows)
    assert decontamination.pairs(empty(spark), bench).count() == 0
    assert len(list(decontamination.blocks(bench, 40))) > 1


def test_short_items_are_matched_whole(spark):
    bench = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma delta epsilon zeta eta")], "item_id long, text string")
    got = decontamination.pairs(docs(spark, [(1, "x alpha, BETA y"), (2, "alpha y beta"), (3, "alpha"), (4, "gamma delta epsilon zeta eta")]), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_tiles, r.n_words, r.coverage) for r in got) == [(1, 1, 1, 2, 1.0), (4, 2, 1, 5, 1.0)]


def test_repeated_words_are_tiled_in_time():
    import time

    began = time.time()
    assert sum(n for *_, n in decontamination.tiles([1] * 2000, [1] * 100_000)) == 2000
    assert sum(n for *_, n in decontamination.tiles([1, 2] * 500, [1, 2] * 20_000)) == 1000
    assert sum(n for *_, n in decontamination.tiles([1] * 300 + [7] + [2] * 300, [1] * 5000 + [3] + [2] * 5000)) == 600
    assert time.time() - began < 20


def test_reordered_passages_by_brute_force():
    r = random.Random(16)
    for _ in range(60):
        item, text = [r.randrange(3) for _ in range(r.randrange(4, 14))], [r.randrange(3) for _ in range(r.randrange(4, 20))]
        left_item, left_text, want = set(range(len(item))), set(range(len(text))), []
        while True:  # the longest free common stretch, the first by item and text
            best = (0, 0, 0)
            for p in range(len(item)):
                for t in range(len(text)):
                    n = 0
                    while p + n in left_item and t + n in left_text and item[p + n] == text[t + n]:
                        n += 1
                    if n > best[2]:
                        best = (p, t, n)
            if best[2] < 3:
                break
            want.append(best)
            left_item -= set(range(best[0], best[0] + best[2]))
            left_text -= set(range(best[1], best[1] + best[2]))
        got = decontamination.tiles(item, text, 3)
        assert sorted(n for *_, n in got)[::-1][:1] == sorted(n for *_, n in want)[::-1][:1]
        assert all(item[p : p + n] == text[t : t + n] for p, t, n in got)
