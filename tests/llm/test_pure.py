"""The Python cores against brute force and the public libraries."""

import random

import numpy as np
import pytest
import tiktoken
import xxhash

from octarine.llm import bpe, decontamination, language_id, lm_scoring, quality_rules, simhash, suffix_dedup

ALPHABET = "aábç 's'\n\t  re.1²٣\x1c\x85　!?-_日本😀"


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.codec(bpe.VOCABULARY, bpe.public_tokenizers.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("cache", [16, 100_000])
def test_bpe_equals_tiktoken(tokenizer, cache):
    own, r = bpe.Codec(cache=cache), random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(2000)]
    texts += ["".join(r.choice("abcé ") for _ in range(r.randrange(60))) for _ in range(2000)]
    texts += ["a" * 30_000, "ab" * 9_000, "".join(r.choice("abcdefgh") for _ in range(20_000)), "", None]
    for part in (texts[:3000], texts[2000:]):
        own.learn(part)
        for x in part:
            ids = own.encode(x)
            assert ids == tokenizer.encode_ordinary(x or "")
            assert own.decode(ids) == (x or "").encode()


def test_bpe_merges_alike_alone_and_together():
    own, r = bpe.Codec(), random.Random(2)
    pieces = [bytes(r.choice(b"abc \xc3\xa9") for _ in range(r.randrange(1, 20))) for _ in range(500)]
    together = own.batch.merge(pieces)
    assert [np.frombuffer(x, "<u2").tolist() for x in together] == [own.merger.merge(p) for p in pieces]


def greedy(item, text, shortest):
    used_item, used_text, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not used_item[p + n] and not used_text[t + n]:
                    n += 1
                best = max(best, (n, -p, -t))
        n, p, t = best[0], -best[1], -best[2]
        if n < shortest:
            return total
        for k in range(n):
            used_item[p + k] = used_text[t + k] = True
        total += n


def test_tiling_equals_greedy():
    r = random.Random(3)
    for _ in range(600):
        item, text = [r.randrange(4) for _ in range(r.randrange(25))], [r.randrange(4) for _ in range(r.randrange(35))]
        got = decontamination.tiles(item, text, 3)
        assert sum(n for *_, n in got) == greedy(item, text, 3)
        assert all(item[p : p + n] == text[t : t + n] and n >= 3 for p, t, n in got)


def test_reordered_passages_are_found():
    item = [f"w{k}" for k in range(30)]
    known = decontamination.index(((7, " ".join(item)), (8, "too short"), (9, None or "")))
    text = "Before! " + " ".join(item[18:]).upper() + " between; " + " ".join(item[:18])
    assert [(i, n, c) for i, n, c, _ in decontamination.contaminations(text, known)] == [(7, 2, 30)]
    assert decontamination.contaminations(" ".join(item[:15]), known) == []
    assert decontamination.contaminations(None, known) == decontamination.contaminations("", known) == []


def test_fingerprint_by_hand():
    def slow(text):
        words = text.lower().split()
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for text in ("", "One", "one Two", "a b c", "a b c d e f g a b c", "x " * 500):
        assert simhash.fingerprint(text) == slow(text)
    assert simhash.fingerprint(None) == 0


def test_repeat_intervals():
    assert sorted(suffix_dedup._intervals([2, 1, 3])) == sorted([(2, 1, 0, 1), (3, 1, 2, 3), (1, -1, 0, 3)])


def test_language_vectors():
    assert language_id.has_letter("1 é") and not language_id.has_letter("12 .!") and not language_id.has_letter(None)
    x = np.eye(6, dtype=np.float32)[[0, 0, 1, 1, 2, 2]]
    assert len(language_id.cluster(x, 3)) == 3 and len(language_id.cluster(x[:1], 4)) == 1
    assert language_id.counts(None).sum() >= 0


def test_decision_lists():
    r = random.Random(4)
    rows = [{"a": r.random(), "b": r.random()} for _ in range(600)]
    rows = [x | {"bad": x["a"] > 0.7 and x["b"] < 0.4} for x in rows]
    rules = quality_rules.learn(rows, features=("a", "b"))
    hit = [any(all(c.holds(x) for c in rule) for rule in rules) for x in rows]
    assert rules and sum(h == x["bad"] for h, x in zip(hit, rows, strict=True)) > 0.95 * len(rows)
    assert quality_rules.learn([x | {"bad": False} for x in rows], features=("a", "b")) == []
    assert quality_rules.learn([], features=("a",)) == []


def test_model_probabilities_sum_to_one_and_learn():
    n = 40  # seven classes of seven units, the last one short
    model, start = lm_scoring.LogBilinear(np.arange(n, 0, -1)), n
    pairs = [(3, 5), (4, start), (start, start)]
    all_units = np.arange(n)
    total = lambda one, two: (10.0 ** model.log_probabilities(np.full(n, one), np.full(n, two), all_units)).sum()
    assert all(total(*p) == pytest.approx(1, abs=1e-4) for p in pairs)
    one, two, unit = (np.array(x, np.int32) for x in zip(*[(3, 5, 9), (start, 5, 31), (8, 1, 0)], strict=True))
    before = model.log_probabilities(one, two, unit)
    assert sum(model.train([(np.repeat(one, 60), np.repeat(two, 60), np.repeat(unit, 60))], k) for k in range(60)) == 60 * 180
    assert (model.log_probabilities(one, two, unit) > before).all()
    for o, t, u in zip(one, two, unit, strict=True):
        assert model.log_probabilities(np.full(n, o), np.full(n, t), all_units).argmax() == u
    assert all(total(*p) == pytest.approx(1, abs=1e-4) for p in pairs)
    again = lm_scoring.LogBilinear(np.arange(n, 0, -1), seed=1).load(model.flat())
    assert (again.log_probabilities(one, two, unit) == model.log_probabilities(one, two, unit)).all()


def test_probabilities_by_hand():
    """The two softmaxes of the docstring, unit by unit."""
    n = 11
    model, r = lm_scoring.LogBilinear(np.arange(n, 0, -1)), np.random.default_rng(3)
    model.load(r.normal(size=len(model.flat())).astype(np.float32))
    for one, two in ((0, 4), (n, n), (10, 2)):
        h = model.r[one] * model.c[0] + model.r[two] * model.c[1]
        of = np.exp(model.s @ h + model.d)
        for unit in range(n):
            k = unit // model.size
            own = np.exp(model.q[k * model.size : (k + 1) * model.size] @ h + model.b[k * model.size : (k + 1) * model.size])
            wanted = np.log10(of[k] / of.sum() * own[unit % model.size] / own.sum())
            assert model.log_probabilities(*(np.array([x]) for x in (one, two, unit)))[0] == pytest.approx(wanted, abs=1e-3)


def test_contexts_do_not_cross_texts():
    s = 99
    one, two = lm_scoring.contexts(np.array([5, 6, 7, 8, 9], np.int32), np.array([3, 1, 1]), s)
    assert one.tolist() == [s, 5, 6, s, s] and two.tolist() == [s, s, 5, s, s]
    one, two = lm_scoring.contexts(np.array([5, 6, 7, 8, 9], np.int32), np.array([1, 2, 2]), s)
    assert one.tolist() == [s, s, 6, s, 8] and two.tolist() == [s, s, s, s, s]
