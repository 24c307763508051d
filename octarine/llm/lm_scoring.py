"""Language-model scoring: a log-bilinear neural model with a vector for each word, trained by noise-contrastive estimation."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octarine.llm.common import cut, give_back, remainder, small_batches, table

#: The end of a text; no word has this form.
END = "\n"
#: A word has vectors of its own if it occurs in the training rows as often as the root of all their tokens over ROOT, or
#: LEAST times: so the vocabulary grows with the root of the corpus, and the model stays one that a task can hold.
ROOT, LEAST = 16.0, 8
#: Bands of the other words, by how often they occur: one vector each.
BANDS = 192
DIM, NOISE, CLASS_NOISE, ROUNDS, BATCH, RATE = 16, 4, 24, 2, 8192, 0.1
#: Draws of noise that are made for each class beforehand.
POOL = 4096
#: Tokens that are scored at once.
SCORED = 1 << 15
#: Blocks that one task trains on, at least SHARDS tasks; their parameters are averaged after each round, by CHUNK numbers.
SHARD_BLOCKS, SHARDS, CHUNK = 64, 12, 1 << 16
#: Bytes of text in one block of documents. Words are counted within a block before they are shuffled.
BLOCK_BYTES = 12 << 20
#: Words of blocks that one task adds up.
PART_WORDS = 1 << 20


def tokens(text: str | None) -> list[bytes]:
    """A-Z in lower case; words between ASCII white space, then one end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END.encode()]


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(bytes(x)), kind)


def band(count: np.ndarray) -> np.ndarray:
    """Band of words without a vector of their own, by how often they occur: 0 for never, and two to three for each doubling."""
    c = np.maximum(count, 1)
    return np.where(count > 0, np.minimum(BANDS - 1, np.where(c <= 4, c, 2.5 * np.log2(c)).astype(np.int64)), 0)


def blocks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, held_out) as blocks: documents as numbers of the block's own words, in the order of their hashes, and how often training rows have each."""
    small_batches(docs.sparkSession)
    binary = [T.StructField(c, T.BinaryType()) for c in ("held", "lengths", "ids", "words", "n")]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("size", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)), *binary])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        fresh = lambda: ([], [], [], [], {}, 0)
        docs_, held, lengths, parts, own, size = fresh()

        def done(kind: pa.DataType) -> pa.RecordBatch:
            words = list(own)
            order = np.argsort(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            ids, h = rank[np.concatenate(parts)], np.array(held, bool)
            known = np.bincount(ids[np.repeat(~h, lengths)], minlength=len(own))
            named = zstandard.compress(b" ".join([words[k] for k in order.tolist()]), 1)
            one = lambda x, t: pa.array([x], t)
            packed = (pack(h), pack(np.array(lengths, np.int32)), pack(ids), named, pack(known))
            return pa.RecordBatch.from_arrays([one(number, pa.int64()), one(len(words), pa.int64()), one(int(known.sum()), pa.int64()), one(docs_, pa.list_(kind)), *[one(x, pa.binary()) for x in packed]], schema.names)

        for b in batches:
            kind = b.schema.field(0).type
            for d, text, is_held in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found = tokens(text)
                for w in found:
                    if w not in own:
                        own[w] = len(own)
                docs_.append(d)
                held.append(bool(is_held))
                lengths.append(len(found))
                parts.append(np.fromiter(map(own.__getitem__, found), np.int32, len(found)))
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield done(kind)
                    number += 1
                    docs_, held, lengths, parts, own, size = fresh()
        if docs_:
            yield done(kind)
        give_back()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)


def counts(made: DataFrame) -> DataFrame:
    """How often all training rows have the words of each block: (block, part, counts), the parts in the order of the block's words.

    Blocks deal their words out by ranges of hashes, each word once, and get its sum back. For each part there is
    also a row without a block: n and v (tokens and different words), mass (tokens by band, of words without vectors of their own) and top (the words with).
    """
    entries, tokens_ = made.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    parts, least = max(12, int(entries // PART_WORDS)), max(LEAST, math.sqrt(tokens_) / ROOT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                words, n = zstandard.decompress(row["words"]).split(b" "), unpack(row["n"], "<i8")
                part = np.fromiter((h * parts >> 64 for h in map(xxhash.xxh64_intdigest, words)), np.int64, len(words))
                ends = np.searchsorted(part, np.arange(parts + 1)).tolist()
                some = [(g, a, b) for g, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
                columns = ([g for g, *_ in some], [row["block"]] * len(some), [zstandard.compress(b" ".join(words[a:b]), 1) for _, a, b in some], [pack(n[a:b]) for _, a, b in some])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "words", "n"])

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lists = [zstandard.decompress(x).split(b" ") for x in rows["words"]]
        total: dict[bytes, int] = {}
        get = total.get
        for words, n in zip(lists, rows["n"], strict=True):
            for w, k in zip(words, unpack(n, "<i8").tolist(), strict=True):
                total[w] = get(w, 0) + k
        sums = [pack(np.fromiter(map(total.__getitem__, words), np.int64, len(words))) for words in lists]
        c = np.fromiter(total.values(), np.int64, len(total))
        rare = c[c < least]
        mass = np.bincount(band(rare), rare, BANDS).astype(np.int64).tolist()
        top = [(w.decode("utf-8", "replace"), k) for w, k in total.items() if k >= least]
        out = [(b, key[0], x, None, None, None, None) for b, x in zip(rows["block"].tolist(), sums, strict=True)]
        out.append((None, key[0], None, int(c.sum()), int((c > 0).sum()), mass, [{"word": w, "c": k} for w, k in top]))
        return pd.DataFrame(out, columns=["block", "part", "counts", "n", "v", "mass", "top"]).astype({"block": "Int64", "n": "Int64", "v": "Int64"})

    dealt = made.select("block", "words", "n").mapInArrow(deal, "part long, block long, words binary, n binary")
    return dealt.groupBy("part").applyInPandas(meet, "block long, part long, counts binary, n long, v long, mass array<long>, top array<struct<word:string,c:long>>")


@dataclass(frozen=True)
class Vocabulary:
    """What holds of the whole training corpus.

    n tokens, v different ones, the words with vectors of their own, the tokens of each band. Units are those words and the bands, in the order of how
    often they occur: of_word and of_band are their numbers, counts their tokens.
    """

    n: int
    v: int
    words: tuple[bytes, ...]
    mass: np.ndarray
    of_word: np.ndarray
    of_band: np.ndarray
    counts: np.ndarray


def vocabulary(counted: DataFrame) -> Vocabulary:
    """From the summaries of counts(): the words with vectors reach the driver, some root of the corpus."""
    own = counted.where("block is null")
    n, v = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    top = own.select(F.explode("top").alias("t")).select("t.word", "t.c").orderBy(F.desc("c"), "word").collect()
    mass = np.zeros(BANDS, np.int64)
    for r in own.select(F.posexplode("mass").alias("k", "m")).groupBy("k").agg(F.sum("m").alias("m")).collect():
        mass[r.k] = r.m
    counts_ = np.concatenate([np.array([r.c for r in top], np.int64), mass])
    order = np.argsort(-counts_, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return Vocabulary(int(n), int(v), tuple(r.word.encode() for r in top), mass, number[: len(top)], number[len(top) :], counts_[order])


def classed(made: DataFrame, counted: DataFrame, voc: Vocabulary) -> DataFrame:
    """Blocks with their words' counts, as units.

    Per block: lengths, known (tokens with a count), base and within (sums by document), units for scoring and for
    training. A token of a training row is trained as its count would be without itself, so a word that occurs once
    stands for the unknown ones. A word of a band has its share of the band's tokens.
    """
    schema = T.StructType([made.schema["doc_ids"], *[T.StructField(c, T.BinaryType()) for c in ("held", "lengths", "known", "base", "within", "units", "trained")]])
    sent = made.sparkSession.sparkContext.broadcast(voc)

    def run(key: tuple, sums: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        own, out = sent.value, []
        count = np.concatenate([unpack(x, "<i8") for x in sums.sort_values("part")["counts"]])
        bands = band(count)
        for r in rows.itertuples():
            at = {w: k for k, w in enumerate(zstandard.decompress(r.words).split(b" "))}
            of = np.full(len(count), -1)
            found = [(at[w], u) for w, u in zip(own.words, own.of_word.tolist(), strict=True) if w in at]
            if found:
                places, numbers = zip(*found, strict=True)
                of[list(places)] = numbers
            unit = np.where(of >= 0, of, own.of_band[bands]).astype(np.int32)
            in_training = np.where(of >= 0, of, own.of_band[band(count - 1)]).astype(np.int32)
            base = np.log10((count + 0.5) / (own.n + 0.5 * (own.v + 1)))
            within = np.where((of < 0) & (count > 0), np.log10(np.maximum(count, 1) / np.maximum(own.mass[bands], 1)), 0.0)
            lengths, ids = unpack(r.lengths, "<i4"), unpack(r.ids, "<i4")
            start = np.cumsum(lengths) - lengths
            sums_ = lambda x: pack(np.add.reduceat(x[ids], start))  # noqa: B023, E731
            trained = in_training[ids[np.repeat(~unpack(r.held, "?"), lengths)]]
            out.append((r.doc_ids, r.held, r.lengths, sums_((count > 0).astype(np.int64)), sums_(base), sums_(within), pack(unit[ids]), pack(trained)))
        return pd.DataFrame(out, columns=schema.names)

    own = made.select(F.col("block").alias("own"), "doc_ids", "held", "lengths", "ids", "words")
    sums = counted.where("block is not null").select("block", "part", "counts")
    return sums.groupBy("block").cogroup(own.groupBy("own")).applyInPandas(run, schema)


def contexts(units: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token and the one before that; start before a text."""
    one = np.concatenate([[start], units[:-1]]).astype(np.int32)
    two = np.concatenate([[start, start], units[:-2]]).astype(np.int32)[: len(units)]
    first = np.cumsum(lengths) - lengths
    one[first] = two[first] = start
    two[first[lengths > 1] + 1] = start
    return one, two


class LogBilinear:
    """P(unit | the two before): h = R[one] * C1 + R[two] * C2, then the softmax of h . S + d over classes of units, times that of h . Q + b over the units of the class.

    Units are numbered by how often they occur, and a class is the root of their number of them, in that order; so each
    probability takes two short matrix products, and those of all units sum to 1. R has a row more: what stands before a text.
    """

    def __init__(self, counts_: np.ndarray, seed: int = 42):
        rng = np.random.default_rng(seed)
        n = len(counts_)
        self.n, self.size = n, max(1, math.isqrt(max(0, n - 1)) + 1)
        self.starts = np.arange(0, n, self.size)
        self.share = (counts_ + 0.5) / (counts_ + 0.5).sum()
        self.of_class = np.add.reduceat(self.share, self.starts)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.r, self.c, self.s, self.q = small(n + 1, DIM), np.ones((2, DIM), np.float32), small(len(self.starts), DIM), small(n, DIM)
        self.d = np.log(self.of_class).astype(np.float32)
        self.b = np.log(self.share / self.of_class[np.arange(n) // self.size]).astype(np.float32)

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.r, self.c, self.s, self.q, self.d, self.b

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def train(self, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> int:
        """One pass over (one, two, unit) by noise-contrastive estimation with AdaGrad; returns the number of tokens.

        A token's class is told from CLASS_NOISE classes drawn by their shares, the unit from NOISE units drawn by their shares from its class.
        """
        rng, seen = np.random.default_rng(seed), 0
        squares = [np.full(p.shape, 1.0, np.float32) for p in self.parts()]
        ends, sums = np.cumsum(self.share), np.concatenate([[0.0], np.cumsum(self.of_class)])
        # units drawn from each class beforehand, of which the noise is picked
        pool = np.searchsorted(ends, sums[:-1, None] + rng.random((len(self.starts), POOL)) * self.of_class[:, None])
        pool = np.clip(pool, self.starts[:, None], np.minimum(self.starts + self.size, self.n)[:, None] - 1).astype(np.int32)
        log_class = np.log(CLASS_NOISE * self.of_class).astype(np.float32)
        log_unit = np.log(NOISE * self.share / self.of_class[np.arange(self.n) // self.size]).astype(np.float32)
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

        def step(rows: np.ndarray, *changes: tuple[int, np.ndarray]) -> None:
            order = np.argsort(rows.astype(np.uint16) if self.n < 1 << 16 else rows, kind="stable")  # short numbers are sorted by their digits
            rows = rows[order]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            rows = rows[first]
            for k, g in changes:
                g, p, q = np.add.reduceat(g[order], first), self.parts()[k], squares[k]
                q[rows] += g * g
                p[rows] += RATE * g / np.sqrt(q[rows])

        for one, two, unit in parts:
            seen += len(unit)
            for at in range(0, len(unit), BATCH):
                o, t, w = one[at : at + BATCH], two[at : at + BATCH], unit[at : at + BATCH]
                r1, r2, of = self.r[o], self.r[t], w // self.size
                h = r1 * self.c[0] + r2 * self.c[1]
                drawn = rng.choice(len(self.starts), CLASS_NOISE, p=self.of_class)
                up = 1 - sigmoid((h * self.s[of]).sum(1) + self.d[of] - log_class[of])
                down = -sigmoid(h @ self.s[drawn].T + self.d[drawn] - log_class[drawn])
                gh = up[:, None] * self.s[of] + down @ self.s[drawn]
                noise = pool[of[:, None], rng.integers(0, POOL, (len(w), NOISE), np.int32)]
                near, far = self.q[w], self.q[noise]
                right = 1 - sigmoid((h * near).sum(1) + self.b[w] - log_unit[w])
                wrong = -sigmoid(np.einsum("id,ikd->ik", h, far) + self.b[noise] - log_unit[noise])
                gh += right[:, None] * near + np.einsum("ik,ikd->id", wrong, far)
                gq = np.concatenate([right[:, None] * h, (wrong[:, :, None] * h[:, None, :]).reshape(-1, DIM)])
                step(np.concatenate([w, noise.ravel()]), (3, gq), (5, np.concatenate([right, wrong.ravel()])))
                step(np.concatenate([of, drawn]), (2, np.concatenate([up[:, None] * h, down.T @ h])), (4, np.concatenate([up, down.sum(0)])))
                step(np.concatenate([o, t]), (0, np.concatenate([gh * self.c[0], gh * self.c[1]])))
                gc = np.stack([(gh * r1).mean(0), (gh * r2).mean(0)])
                squares[1] += gc * gc
                self.c += RATE * gc / np.sqrt(squares[1])
        return seen

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """log10 of P(unit | one, two), for each token; matrix products over SCORED tokens at once, and over those of each class."""
        out = np.empty(len(unit), np.float32)

        def log_softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
            x -= x.max(1, keepdims=True)
            picked = x[np.arange(len(x)), at]
            return picked - np.log(np.exp(x, out=x).sum(1))

        for a in range(0, len(unit), SCORED):
            w = unit[a : a + SCORED]
            of = w // self.size
            order = np.argsort(of.astype(np.uint16), kind="stable")
            w, of = w[order], of[order]
            h = self.r[one[a : a + SCORED][order]] * self.c[0] + self.r[two[a : a + SCORED][order]] * self.c[1]
            got = log_softmax(h @ self.s.T + self.d, of)
            bounds = np.searchsorted(of, np.arange(len(self.starts) + 1)).tolist()
            for k, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if i < j:
                    members = slice(k * self.size, min(self.n, (k + 1) * self.size))
                    got[i:j] += log_softmax(h[i:j] @ self.q[members].T + self.b[members], w[i:j] - k * self.size)
            out[a : a + SCORED][order] = got
        return out / np.float32(np.log(10))


def fit(blocks_: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
    """Trained over all training tokens of blocks_ (held, lengths, trained), each document in one of the rounds.

    Tasks go through their blocks one after another; their parameters are averaged by the tokens seen, in pieces, so that the driver gets one
    model, of a size that grows with the root of the corpus.
    """
    model = LogBilinear(voc.counts)
    n = blocks_.count()
    own = blocks_.select("held", "lengths", "trained").coalesce(max(SHARDS, n // SHARD_BLOCKS))
    spark = blocks_.sparkSession
    for k in range(rounds if voc.n else 0):
        held = spark.sparkContext.broadcast((voc.counts, model.flat()))

        def run(batches: Iterator[pa.RecordBatch], held=held, k=k) -> Iterator[pa.RecordBatch]:
            counts_, flat = held.value
            mine = LogBilinear(counts_).load(flat)

            def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for b in batches:
                    for is_held, lengths, units in zip(*[c.to_pylist() for c in b.columns], strict=True):
                        lengths, units = unpack(lengths, "<i4")[~unpack(is_held, "?")], unpack(units, "<i4")
                        mine_ = np.arange(len(lengths)) % rounds == k
                        tokens_, lengths = units[np.repeat(mine_, lengths)], lengths[mine_]
                        if len(tokens_):
                            yield (*contexts(tokens_, lengths, mine.n), tokens_)

            seen = mine.train(parts(), k + 1)
            flat = mine.flat()
            if seen:
                pieces = [flat[a : a + CHUNK].astype("<f4").tobytes() for a in range(0, len(flat), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.binary()), pa.array([float(seen)] * len(pieces))], ["piece", "flat", "n"])

        def mean(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            flat = np.average([np.frombuffer(x, "<f4") for x in rows["flat"]], axis=0, weights=rows["n"])
            return pd.DataFrame({"piece": [key[0]], "flat": [flat.astype("<f4").tobytes()]})

        found = own.mapInArrow(run, "piece long, flat binary, n double").groupBy("piece").applyInPandas(mean, "piece long, flat binary").collect()
        if found:
            model.load(np.concatenate([np.frombuffer(r.flat, "<f4") for r in sorted(found)]))
    return model


def scored(blocks_: DataFrame, model: LogBilinear, voc: Vocabulary) -> DataFrame:
    """A row for each document of the blocks."""
    doc_id = T.StructField("doc_id", blocks_.schema["doc_ids"].dataType.elementType)
    schema = T.StructType([doc_id, *[T.StructField(c, t) for c, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))]])
    sent, n = blocks_.sparkSession.sparkContext.broadcast((voc.counts, model.flat())), voc.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_, flat = sent.value
        own = LogBilinear(counts_).load(flat)
        for b in batches:
            for k in range(b.num_rows):
                held, lengths, known, base, within, units = (unpack(b.column(c)[k].as_py(), t) for c, t in zip(range(1, 7), ("?", "<i4", "<i8", "<f8", "<f8", "<i4"), strict=True))
                one, two = contexts(units, lengths, own.n)
                at = np.cumsum(lengths) - lengths
                score = np.add.reduceat(own.log_probabilities(one, two, units).astype(np.float64), at) + within
                ids = b.column(0)[k].values
                del one, two, units
                give_back()
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(lengths.astype(np.int64)), pa.array(known), pa.array(np.full(len(known), n, np.int64)), pa.array(base), pa.array(score)], schema.names)

    return blocks_.select("doc_ids", "held", "lengths", "known", "base", "within", "units").mapInArrow(run, schema)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text, held_out).

    The base and the model learn from the rows that are not held out, all of them. A null text counts as empty: its one
    token is the end. The model's vocabulary is every training word and one unknown word: P(word) = P(unit | the two units
    before), a unit being a word or, for rare words, a band of words of like counts, in which a word has its share of the tokens; the probabilities of a context sum to 1. Repeated rows
    count and come back as often; other columns are ignored; an empty table gives no rows. Without training rows all
    words are unknown.
    """
    made = cut(blocks(docs))
    counted = cut(counts(made))
    voc = vocabulary(counted)
    blocks_ = cut(classed(made, counted, voc))
    return scored(blocks_, fit(blocks_, voc), voc)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 1))
