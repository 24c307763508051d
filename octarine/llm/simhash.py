"""SimHash near-duplicates: fingerprints of words, met on all variants within half the radius, and verified."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octarine.functions.lineage import numbered
from octarine.llm.common import connected_components, cut, fresh, small_batches, table

BITS, SEED, WORDS, RADIUS = 64, 42, 3, 2
#: Shingle hashes whose bits are counted at once, and those that take part in minima at once.
BLOCK, SHINGLES = 1 << 16, 1 << 12
#: For texts of like words: words of a shingle, and the least Jaccard similarity of two texts that are linked.
LIKE_WORDS, LEAST = 5, 0.8
#: Fingerprints of a text that near copies are looked for by, and the bits of each.
TABLES, SLOT_BITS = 12, 32
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, TABLES * SLOT_BITS, np.uint64) << np.uint64(1) | np.uint64(1)
#: An odd factor that spreads values over 64 bits, and its inverse.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNMIX = np.uint64(pow(int(_MIX), -1, 1 << 64))
#: Values whose variants are made at once, and variants that one task sorts.
SLICE, GROUP = 1 << 16, 1 << 22
#: Texts that are looked up by a broadcast of their keys; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: Longs of a text's parities. Texts that have a shingle before it counts as heavy, one text in how many is asked for that, and the most heavy ones that all tasks hold. A block of sets has 1 << BLOCK_BITS keys.
PARITIES, SHARED, EVERY, MOST_HEAVY, BLOCK_BITS = 2, 16, 8, 1 << 20, 7


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are what stands between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(tokens: list[bytes], words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than a shingle has are one shingle, and no words none."""
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed)][: len(tokens)], np.uint64)
    joined = map(b" ".join, zip(*[tokens[k:] for k in range(words)], strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in joined), np.uint64, len(tokens) - words + 1)


def _majority(found: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Of 64-bit numbers, the one whose bits are set in over half of them, as eight bytes."""
    counts, total = np.zeros(BITS), len(found) if weights is None else weights.sum()
    for at in range(0, len(found), BLOCK):
        bits = np.unpackbits(found[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[at : at + BLOCK] @ bits
    return np.packbits(2 * counts > total, bitorder="little")


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned. A bit is set if it is set in over half the hashes of the text's shingles, repeats included; a text without words gives 0."""
    return int.from_bytes(_majority(hashes(words_of(text), words, seed)).tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """docs without the text, with fp: the fingerprint as a signed long. Rows stand alone; extra columns stay."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "fp")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, words) for x in b.column(len(kept)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(fps)], [*kept, "fp"])

    return docs.select(*kept, text).mapInArrow(run, schema)


def _masks(bits: int) -> np.ndarray:
    return np.array([0, *[1 << k for k in range(bits)]], np.uint64)


def _met(distinct: DataFrame, bits: int, choose: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """choose(value, number, begins) of each range of hashed variants, over those where different values of fp meet.

    Each value goes to itself and all values with one of its lowest bits changed. value: what came to a variant; number: 0 for the
    variant itself, or the changed bit's place and 1, which orders those at one variant; begins: true for the first of each variant. Variants travel in packed lists, by ranges
    of their hashes: sorted, as differences, each with its number, which tells the value that it comes from.
    """
    masks = _masks(bits)
    groups = max(12, distinct.count() * len(masks) // GROUP + 1)
    width = np.uint64((1 << 64) // groups)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(values), SLICE):
                spread = ((values[at : at + SLICE, None] ^ masks) * _MIX).ravel()  # one to one, as _MIX is odd
                order = np.argsort(spread, kind="stable")
                spread, which = spread[order], (order % len(masks)).astype(np.uint8)
                group = np.minimum(spread // width, groups - 1)
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                parts = [(int(group[x]), spread[x:y], which[x:y]) for x, y in zip(starts, [*starts[1:], len(group)], strict=True)]
                packed = [zstandard.compress(np.diff(v, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + w.tobytes(), 1) for _, v, w in parts]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, *_ in parts], pa.int64()), pa.array(packed, pa.binary())], ["part", "packed"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        spread, which = [], []
        for x in rows["packed"]:
            raw = np.frombuffer(zstandard.decompress(x), np.uint8)
            n = len(raw) // 9
            spread.append(np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).reshape(-1).view(np.uint64)))
            which.append(raw[8 * n :])
        v, w = np.concatenate(spread), np.concatenate(which)
        order = np.argsort(v, kind="stable")
        v, w = v[order], w[order]
        same = v[1:] == v[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        v, w = v[shared], w[shared]
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        return choose(((v * _UNMIX) ^ masks[w]).view(np.int64), w, np.concatenate([[True], v[1:] != v[:-1]])[: len(v)])

    dealt = distinct.select("fp").mapInArrow(deal, "part long, packed binary")
    return dealt.groupBy("part").applyInPandas(meet, schema)


def near_pairs(distinct: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """(a, b): pairs of the different values in fp that link all that differ in no more than radius of their lowest bits, though not each pair of them.

    Meet in the middle: each value goes to all variants within half the radius of it (itself and, for a radius of two,
    those with one bit changed); two values within the radius meet at one variant at least. At most 65 different values can
    stand at one variant, so no group is large however many copies there are; there each is paired with the first and with the one before it, as
    all of them are within the radius of each other. A larger radius is refused: the variants would be too many.
    """
    if radius not in (0, 2):
        raise ValueError("radius must be 0 or 2")
    if radius == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")

    def choose(value: np.ndarray, number: np.ndarray, begins: np.ndarray) -> pd.DataFrame:
        first = np.maximum.accumulate(np.where(begins, np.arange(len(value)), 0))
        later = np.flatnonzero(~begins)
        pairs = np.concatenate([np.stack([value[first[later]], value[later]]), np.stack([value[later - 1], value[later]])], 1)
        pairs = np.unique(np.sort(pairs, 0), axis=1)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    return _met(distinct, bits, choose, "a long, b long").distinct()


def nearest_crowds(distinct: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """(a, b): for each value a in fp that is within two bits of another, the first of those at its most crowded variant, or what follows it if it is the first.

    One row for each value, so a crowd of values that are all near each other costs no more rows than it has values. Ties: the larger b.
    """

    def choose(value: np.ndarray, number: np.ndarray, begins: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(begins)
        size = np.diff(starts, append=len(value))
        other = np.repeat(value[starts], size)
        other[starts] = value[starts + 1]  # at least two stand at each variant
        size = np.repeat(size, size)
        order = np.lexsort((other, size, value))
        value, size, other = value[order], size[order], other[order]
        last = np.concatenate([value[1:] != value[:-1], [True]])[: len(value)]
        return pd.DataFrame({"a": value[last], "size": size[last], "b": other[last]})

    met = _met(distinct, bits, choose, "a long, size long, b long")
    return met.groupBy("a").agg(F.max(F.struct("size", "b")).alias("m")).select("a", "m.b")


def near_groups(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """docs (doc_id, text and more) without the text, with fp and component_id: the least doc_id that links reach.

    Fingerprints are made distinct before anything is paired, so copies cost one fingerprint. A null doc_id counts for
    nothing in a component; a component of none but null ids has a null component_id. Repeated rows come back as often.
    """
    marked = cut(fingerprints(docs.drop("component_id"), words=words))
    owners = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected_components(cut(near_pairs(owners.select("fp"), radius)))
    named = owners.join(groups, owners.fp == groups.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "fp").select(*marked.columns, "component_id")


# --- texts of like words


def shingles(tokens: list[bytes], words: int = LIKE_WORDS) -> np.ndarray:
    """Sorted different hashes of the shingles."""
    return np.unique(hashes(tokens, words))


def key_of(found: np.ndarray) -> int:
    """What texts of equal shingles share: 0 for none."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def slots(found: np.ndarray) -> np.ndarray:
    """TABLES fingerprints of SLOT_BITS bits of a text's different shingles; each with its table's number above it.

    A bit is one of the least of the shingles' hashes under a factor of its own, so that it differs between two texts with half the chance that
    a shingle of either is not in both: a pair of a given similarity is met alike, whether edits are scattered, or text is added or cut at an end. (Votes of words or
    shingles drift with what is added.)
    """
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SHINGLES):
        least = np.minimum(least, (found[at : at + SHINGLES, None] * _ODD).min(0))
    bits = np.packbits((least * _MIX) >> np.uint64(63) == 1, bitorder="little")
    return bits.view("<u4").astype(np.int64) | np.arange(TABLES) << SLOT_BITS


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def ordered(found: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a text, of which two texts of a similarity of least or more share one: all but so many as both must have, the heavy ones (sorted, and the place of each) last.

    Any order that is the same for all texts would do; with what many texts have at the end, few texts meet at one shingle.
    """
    n, (values, places) = len(found), heavy
    if not n:
        return found
    if len(values):
        at = np.minimum(np.searchsorted(values, found), len(values) - 1)
        known = values[at] == found
        found = np.concatenate([found[~known], found[known][np.argsort(places[at[known]])]])
    return found[: n - math.ceil(least * n - 1e-9) + 1]


def parities(found: np.ndarray) -> np.ndarray:
    """PARITIES signed longs: each bit tells whether an odd number of the shingles has its place. Those of two texts differ in no more bits than there are shingles in one alone."""
    odd = np.bincount((found & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def heavy_shingles(docs: DataFrame, words: int = LIKE_WORDS) -> np.ndarray:
    """The shingles that more than SHARED in all texts have, rarer ones first, no more than MOST_HEAVY of them; judged by all shingles of one text in EVERY, chosen by a hash.

    They say only in which order a text's shingles are tried, so ones that are left out cost time, no pairs. A text's first shingles alone would not do: those that stand
    behind the first in one order are first in the next, when heavy ones have gone to the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(words_of(x), words) for x in b.column(0).to_pylist()]
            values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["shingle", "n"])

    small_batches(docs.sparkSession)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(EVERY)) == 0)
    counts = some.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > SHARED // EVERY)
    top = counts.orderBy(F.desc("n"), "shingle").limit(MOST_HEAVY).select("shingle").toPandas()["shingle"]
    return top.to_numpy(np.int64).view(np.uint64)[::-1]


def signatures(docs: DataFrame, least: float = LEAST, words: int = LIKE_WORDS) -> DataFrame:
    """(doc_id, text_key, key, n, odd, first) of each row of docs (doc_id, text): n is the number of its different shingles; see parities() and ordered()."""
    last = heavy_shingles(docs, words)
    places = np.argsort(last)
    heavy = docs.sparkSession.sparkContext.broadcast((last[places], places))
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("text_key long, key long, n long, odd array<long>, first array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for b in batches:
            found = [shingles(words_of(x), words) for x in b.column(2).to_pylist()]
            odd, first = [parities(f) for f in found], [ordered(f, heavy.value, least).view(np.int64) for f in found]
            keys, n = _signed([key_of(f) for f in found]), [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys), pa.array(n, pa.int64()), pa.array(odd, longs), pa.array(first, longs)], schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def sets(docs: DataFrame, wanted: DataFrame, words: int = LIKE_WORDS) -> DataFrame:
    """(block, key, shingles) of the texts of docs whose text_key is in wanted (text_key, block): a row for each row of wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(words_of(x), words) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed([key_of(f) for f in found])), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], ["block", "key", "shingles"])

    keys = cut(wanted)
    keys = F.broadcast(keys) if keys.count() <= MOST_SENT else keys
    some = docs.select("text", F.xxhash64("text").alias("text_key")).join(keys, "text_key").dropDuplicates(["text_key"])
    return some.select("block", "text").mapInArrow(run, "block long, key long, shingles array<long>")


def candidates(owners: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b), a < b: all pairs of keys of owners (key, n, odd, first) that can be that similar, by a shingle that is among the first of both, by sizes, by how many shingles can follow it, and by parities.

    An equality join on shingles: of any number of texts that share one, no task holds them all, and only what passes is written. A pair that has
    met at the shingle before, if that is the same in both, is not written again.
    """
    rows = owners.select("key", "n", "odd", "first", F.posexplode("first").alias("at", "shingle")).withColumn("before", F.get("first", F.col("at") - 1))
    side = lambda c: rows.select("shingle", F.col("key").alias(c), F.col("before").alias(f"before_{c}"), F.col("n").alias(f"n_{c}"), F.col("at").alias(f"at_{c}"), *[F.col("odd")[k].alias(f"odd{k}_{c}") for k in range(PARITIES)])
    total = F.col("n_a") + F.col("n_b")
    differ = sum((F.bit_count(F.col(f"odd{k}_a").bitwiseXOR(F.col(f"odd{k}_b"))) for k in range(PARITIES)), F.lit(0))
    can = (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-6) & (differ <= total * ((1 - least) / (1 + least)) + 1e-6)
    can = can & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= total * (least / (1 + least)) - 1e-6)
    again = F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False))
    return side("a").hint("merge").join(side("b"), "shingle").where(F.col("a") < F.col("b")).where(can & ~again).select("a", "b").distinct()


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Those of the pairs that join what the ones before don't."""
    lead, out = {}, []

    def top(x: int) -> int:
        while (up := lead.get(x, x)) != x:
            lead[x] = x = lead.get(up, up)
        return x

    for x, y in zip(a, b, strict=True):
        if (one := top(x)) != (two := top(y)):
            lead[one] = two
            out.append((x, y))
    return out


def verified(pairs: DataFrame, owners: DataFrame, docs: DataFrame, least: float, words: int) -> DataFrame:
    """Of the pairs (a, b) of keys, those whose texts are that similar by their whole sets of shingles, less such as others of two blocks link already.

    Keys are put in an order in which those that are paired stand together, and sets travel in blocks of some keys: a crowd, all of whose pairs are to be read, costs
    a row for each pair of its blocks.
    """
    both = pairs.union(pairs.select("b", "a"))
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    label = both.join(label, both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
    places = cut(numbered(label, ["label", "node"], "number").select("node", F.shiftright("number", BLOCK_BITS).alias("block")))
    place = lambda c: places.select(F.col("node").alias(c), F.col("block").alias(f"block_{c}"))
    work = pairs.join(place("a"), "a").join(place("b"), "b").groupBy("block_a", "block_b").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    whole = sets(docs, owners.join(places, owners.key == places.node).select("text_key", "block"), words)
    blocks = cut(whole.groupBy("block").agg(F.collect_list(F.struct("key", "shingles")).alias("sets")))
    held = lambda c: blocks.select(F.col("block").alias(f"block_{c}"), F.col("sets").alias(f"sets_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = {}
                for rows in (batch.column(c)[k].values for c in ("sets_a", "sets_b")):
                    if rows is None:  # of the block that both keys are in
                        continue
                    lists = rows.field("shingles")
                    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                    own.update((x, values[i:j]) for x, i, j in zip(rows.field("key").to_pylist(), ends, ends[1:], strict=False))
                a, b = (batch.column(c)[k].values.to_numpy() for c in "ab")
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                linked = np.zeros(len(a), bool)
                for i, j in zip(starts := np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])), [*starts[1:], len(a)], strict=True):
                    one, others = own[int(a[i])].view(np.uint64), [own[x].view(np.uint64) for x in b[i:j].tolist()]
                    sizes = np.array([len(x) for x in others])
                    rest = np.concatenate(others)
                    same = np.add.reduceat(one[np.minimum(np.searchsorted(one, rest), len(one) - 1)] == rest, np.cumsum(sizes) - sizes, dtype=np.int64)
                    linked[i:j] = same >= least * (len(one) + sizes - same) - 1e-9
                pairs = _forest(a[linked].tolist(), b[linked].tolist())
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    small_batches(docs.sparkSession, 16)
    work = cut(work)
    one = work.where("block_a = block_b").join(held("a"), "block_a").withColumn("sets_b", F.lit(None).cast(blocks.schema["sets"].dataType))
    two = work.where("block_a != block_b").join(held("a"), "block_a").withColumn("sets_a", F.filter("sets_a", lambda x: F.array_contains("a", x["key"]))).join(held("b"), "block_b")
    return one.select("a", "b", "sets_a", "sets_b").union(two.select("a", "b", "sets_a", "sets_b")).mapInArrow(run, "a long, b long")


def like_pairs(owners: DataFrame, docs: DataFrame, least: float = LEAST, words: int = LIKE_WORDS) -> DataFrame:
    """(a, b): pairs of keys of owners (key, text_key, n, odd, first) whose texts are that similar; they link all that are, though not each pair of them.

    No pair goes unread, however many texts share a shingle or are like each other. In a crowd of different texts that are all alike the pairs are many by nature: they are compared
    where they meet, and those that parities can't tell apart are written, as two numbers each, and read by whole sets.
    """
    return verified(cut(candidates(owners, least)), owners, docs, least, words)


def like_groups(docs: DataFrame, least: float = LEAST, words: int = LIKE_WORDS) -> DataFrame:
    """doc_id, text_key and component of each row of docs (doc_id, text): the group of texts that links of a Jaccard similarity of at least least join.

    Texts of equal shingles are one before anything is paired; those without a word are one group. Repeated rows come back as
    often. Exact: all similar pairs are linked, and nothing that isn't similar. An empty table gives an empty one; a null text counts as one without a word.
    """
    marked = cut(signatures(docs, least, words))
    owners = cut(marked.groupBy("key").agg(*[F.first(c).alias(c) for c in ("text_key", "n", "odd", "first")]))
    groups = connected_components(cut(like_pairs(owners, docs, least, words)))
    named = owners.select("key").join(groups.hint("merge"), owners.key == groups.node, "left").select("key", F.coalesce("component", "key").alias("component"))
    return marked.select("doc_id", "text_key", "key").join(named.hint("merge"), "key").select("doc_id", "text_key", "component")


def near_unique(docs: DataFrame, least: float = LEAST, words: int = LIKE_WORDS) -> DataFrame:
    """The rows of docs that are the first of their group by doc_id and a hash of the text, and those without a doc_id; see like_groups().

    Rows alike in doc_id and text are one document, and stay or go together.
    """
    groups = like_groups(docs.select("doc_id", "text"), least, words)
    first = groups.where("doc_id is not null").withColumn("own", F.struct("doc_id", "text_key"))
    lead = first.groupBy("component").agg(F.min("own").alias("lead"))
    one, two = fresh(docs, 2)
    others = first.join(cut(lead).hint("merge"), "component").where("own != lead").select(F.col("doc_id").alias(one), F.col("text_key").alias(two)).distinct()
    return docs.join(others, (docs.doc_id == F.col(one)) & (F.xxhash64(docs.text) == F.col(two)), "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
