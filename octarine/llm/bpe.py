"""Byte-level BPE: merges taken from a queue of rank buckets under a hierarchical bitmap."""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from octarine.llm.common import give_back, small_batches, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Entries of a worker's cache of words, some 200 bytes each. What is dropped is computed again.
CACHE = 600_000
#: Bytes of pre-tokens above which one is merged alone, and characters of texts whose new pre-tokens are merged at once.
LONG, TEXTS = 256, 12 << 20


class RankMerger:
    """Merges a pre-token's bytes with a queue of (rank, position) entries under a hierarchical bitmap.

    A bucket for each rank in use holds the linked-list positions whose pair has that rank. A bit for each rank says
    that its bucket is not empty (low: words of 256 bits), and a bit for each word that it is not 0 (top), so two
    find-first-set steps give the least rank however many entries there are. Entries whose pair has changed since
    are skipped when they come up. Vocabularies of up to 65,536 ranks keep both levels within 256 bits. Between two
    pre-tokens the queue is empty, so its words are used again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) > 0xFFFF:
            raise ValueError("ranks go up to 65,535")
        self.one = [ranks[bytes([k])] for k in range(256)]
        #: left << 16 | right: the rank that the pair merges into
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 16 | right] = rank
        self.low = [0] * 256
        self.buckets: dict[int, int | list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Of all neighbours, the pair of the least rank is merged, the leftmost first, until none has a rank."""
        one, rank_of, low, buckets = self.one, self.pairs.get, self.low, self.buckets
        ids = [one[b] for b in piece]
        n, top = len(ids), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [rank_of(a << 16 | b, -1) for a, b in zip(ids, ids[1:], strict=False)]  # of the pair that starts here; -1: none
        rank_at.append(-1)
        fresh = [(r, k) for k, r in enumerate(rank_at) if r >= 0]
        while True:
            for rank, k in fresh:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = k
                    j = rank >> 8
                    low[j] |= 1 << (rank & 255)
                    top |= 1 << j
                elif type(bucket) is int:
                    buckets[rank] = [bucket, k] if bucket < k else [k, bucket]
                else:
                    heappush(bucket, k)
            if not top:
                return [x for x in ids if x >= 0]
            j = (top & -top).bit_length() - 1
            word = low[j]
            bit = word & -word
            rank = j << 8 | (bit.bit_length() - 1)
            k = buckets[rank]
            if type(k) is list:
                bucket, k = k, heappop(k)
                last = not bucket
            else:
                last = True
            if last:
                del buckets[rank]
                low[j] = word = word ^ bit
                if not word:
                    top ^= 1 << j
            fresh = ()
            if rank_at[k] != rank:  # stale: merged away, or another pair by now
                continue
            ids[k] = rank
            gone = after[k]
            after[k] = right = after[gone]
            rank_at[gone] = ids[gone] = new = -1
            if right < n:
                before[right] = k
                new = rank_of(rank << 16 | ids[right], -1)
            rank_at[k] = new
            left = before[k]
            if left >= 0:
                rank_at[left] = other = rank_of(ids[left] << 16 | rank, -1)
                if other >= 0:
                    fresh = ((other, left), (new, k)) if new >= 0 else ((other, left),)
                elif new >= 0:
                    fresh = ((new, k),)
            elif new >= 0:
                fresh = ((new, k),)


class RankBatch:
    """RankMerger for many short pre-tokens at once, with the same queue over all of their positions.

    A step takes the bucket of the least rank, skips what is stale, merges the leftmost pair of it in each
    pre-token with array operations, and puts the rest of the bucket back. A pre-token's least rank is no less than
    the queue's, so each is merged as it would be alone.
    """

    def __init__(self, merger: RankMerger):
        self.one = np.array(merger.one, np.int32)
        keys = np.array(sorted(merger.pairs), np.int64)
        ranks = np.array([merger.pairs[k] for k in keys.tolist()], np.int32)
        back = np.argsort(keys & 0xFFFF, kind="stable")
        self.right, self.right_rank = (keys & 0xFFFF).astype(np.int32), ranks
        self.left, self.left_rank = (keys[back] >> 16).astype(np.int32), ranks[back]
        ends = np.arange(0x10001)
        self.right_at = np.searchsorted(keys >> 16, ends).tolist()
        self.left_at = np.searchsorted(keys[back] & 0xFFFF, ends).tolist()
        of_two = [merger.pairs.get(a << 16 | b, -1) for a in merger.one for b in merger.one]
        self.of_two = np.array(of_two, np.int32)

    @staticmethod
    def _find(known: np.ndarray, ranks: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(wanted), -1, np.int32)
        at = known.searchsorted(wanted)
        at[at == len(known)] = 0
        return np.where(known[at] == wanted, ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each, as 16-bit numbers."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n, lengths = len(raw), np.fromiter(map(len, pieces), np.int64, len(pieces))
        last = np.cumsum(lengths) - 1
        own = np.repeat(np.arange(len(pieces)), lengths)
        ids = np.append(self.one[raw], np.int32(-1))  # n stands for nothing
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[last] = n
        before[last - lengths + 1] = n
        rank_at = np.full(n + 1, -1, np.int32)
        rank_at[: n - 1] = self.of_two[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        rank_at[last] = -1
        buckets: dict[int, list[np.ndarray]] = {}
        low, top = [0] * 256, 0

        def push(at: np.ndarray, ranks: np.ndarray, top: int) -> int:
            order = ranks.argsort(kind="stable")
            at, ranks = at[order], ranks[order]
            starts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()]
            for a, b, rank in zip(starts, [*starts[1:], len(at)], ranks[starts].tolist(), strict=True):
                if (bucket := buckets.get(rank)) is not None:
                    bucket.append(at[a:b])
                else:
                    buckets[rank] = [at[a:b]]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
            return top

        first = np.flatnonzero(rank_at >= 0)
        if len(first):
            top = push(first, rank_at[first], top)
        while top:
            j = (top & -top).bit_length() - 1
            word = low[j]
            rank = j << 8 | ((word & -word).bit_length() - 1)
            got = buckets.pop(rank)
            low[j] = word = word & (word - 1)
            if not word:
                top &= top - 1
            k = got[0] if len(got) == 1 else np.concatenate(got)
            k = k[rank_at[k] == rank]
            if len(k) > 1:
                k.sort()
                piece = own[k]
                ahead = np.empty(len(k), bool)
                ahead[0] = True
                np.not_equal(piece[1:], piece[:-1], out=ahead[1:])
                if not ahead.all():
                    buckets[rank] = [k[~ahead]]
                    low[j] |= 1 << (rank & 255)
                    top |= 1 << j
                    k = k[ahead]
            elif not len(k):
                continue
            gone = after[k]
            right, left = after[gone], before[k]
            ids[k] = rank
            ids[gone] = rank_at[gone] = -1
            after[k] = right
            before[right] = k
            a, b = self.right_at[rank], self.right_at[rank + 1]
            new = self._find(self.right[a:b], self.right_rank[a:b], ids[right])
            a, b = self.left_at[rank], self.left_at[rank + 1]
            other = self._find(self.left[a:b], self.left_rank[a:b], ids[left])
            rank_at[k], rank_at[left] = new, other
            rank_at[n] = -1
            some, more = new >= 0, other >= 0
            if some.any() or more.any():
                top = push(np.concatenate([k[some], left[more]]), np.concatenate([new[some], other[more]]), top)
        left = ids[:n] >= 0
        ends = np.cumsum(2 * np.bincount(own[left], minlength=len(pieces))).tolist()
        flat = ids[:n][left].astype("<u2").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class _Cache(dict):
    """A dict that computes what it lacks. turn() drops what was not used since the turn before, if it has grown full."""

    def __init__(self, compute, most: int):
        self.compute, self.most, self.old = compute, most // 2, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= 2 * self.most:
            self.turn()
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()

    def lacks(self, keys: Iterable[str]) -> list[str]:
        """Those that are not here; what the turn before left is taken over."""
        self.update({k: old for k in keys if k not in self and (old := self.old.get(k)) is not None})
        return [k for k in keys if k not in self]


class Codec:
    """Text to ids and ids to bytes, by a file of ranks and the pattern that cuts texts into pre-tokens."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, cache: int = CACHE):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = list(map(str, range(len(self.tokens))))
        cut = regex.compile(pattern)
        self.find = cut.findall if not cut.groups else lambda text: [m.group() for m in cut.finditer(text)]
        #: Whether single spaces are known to begin a match.
        self.spaced = pattern == public_tokenizers.PATTERN
        self.merger = RankMerger(self.ranks)
        self.batch = RankBatch(self.merger)
        #: What stands between two spaces, as if a space stood before it; and pre-tokens of no space and letters.
        self.words = _Cache(self._encode_word, cache)
        self.marks = _Cache(self._encode_piece, cache // 8)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.merger.merge(piece)

    def _encode_piece(self, piece: str) -> bytes:
        return np.array(self.merge(piece.encode("utf-8", "replace")), "<u2").tobytes()

    def _encode_word(self, word: str) -> bytes:
        return self._encode_piece(" " + word) if word.isalpha() else self._joined(self.find(" " + word))  # letters alone are one match

    def _piece(self, piece: str) -> bytes:
        return self.words[piece[1:]] if piece[0] == " " and piece[1:].isalpha() else self.marks[piece]

    def _joined(self, found: list[str]) -> bytes:
        return b"".join(map(self._piece, found))

    def _cut(self, text: str) -> list[str] | None:
        """The text cut at its spaces; None if one stands at an end or beside other white space, or the pattern is not the default one.

        That one starts a new match at every single space between two other characters, so that what stands between
        them can be looked up as a whole.
        """
        if not self.spaced or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or not text.replace("\n", "").isprintable():
            return None
        return text.split(" ")

    def learn(self, texts: list[str | None]) -> None:
        """Merges the pre-tokens of these texts that are new to the caches, all at once."""
        self.words.turn()
        self.marks.turn()
        words: set[str] = set()
        found: list[str] = []
        for text in texts:
            if (parts := self._cut(text or "")) is None:
                found += self.find(text)
            else:
                found += self.find(parts[0])
                words.update(parts)
        words = set(self.words.lacks(words))
        cut = {w: self.find(" " + w) for w in words if not w.isalpha()}
        words.difference_update(cut)
        marks: set[str] = set()
        for p in chain(found, chain.from_iterable(cut.values())):
            if p[0] == " " and p[1:].isalpha():
                words.add(p[1:])
            else:
                marks.add(p)
        for keys, cache, before in ((words, self.words, " "), (marks, self.marks, "")):
            raw = {k: x for k in cache.lacks(keys) if len(x := (before + k).encode("utf-8", "replace")) <= LONG and x not in self.ranks}
            if raw:
                cache.update(zip(raw, self.batch.merge(list(raw.values())), strict=True))
        self.words.update({w: self._joined(parts) for w, parts in cut.items()})

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        found = self._cut(text)
        if found is None:
            packed = self._joined(self.find(text))
        else:
            packed = b"".join([self._joined(self.find(found[0])), *map(self.words.__getitem__, found[1:])])
        return np.frombuffer(packed, "<u2").tolist()

    def digest(self, ids: Iterable[int]) -> str:
        """SHA-256 of the decimal ids, joined by commas."""
        return hashlib.sha256(",".join(map(self.names.__getitem__, ids)).encode()).hexdigest()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Without the collector of cycles, which would walk the caches again and again; nothing here makes any."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def gathered(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[tuple[pa.RecordBatch, list[str | None]]]]:
    """The batches with their texts, by TEXTS characters: the new pre-tokens of so many are merged at once."""
    held, size = [], 0
    for b in batches:
        texts = b.column(at).to_pylist()
        held.append((b, texts))
        size += sum(len(x) for x in texts if x)
        if size >= TEXTS:
            yield held
            held, size = [], 0
    yield held


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """docs without the text, with ids (array of int). A null text counts as empty, and has no ids.

    Rows stand alone: repeated rows and extra columns stay. Lone surrogates can't occur in a column of strings. The
    file of ranks is read on the executors, where the tokenizers are installed; path is a parameter.
    """
    kept = [c for c in docs.columns if c not in (text, "ids")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for held in gathered(batches, len(kept)):
            with _no_cycles():
                own.learn([x for _, texts in held for x in texts])
            for b, texts in held:
                ids = pa.array([own.encode(x) for x in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], ids], [*kept, "ids"])

    small_batches(docs.sparkSession)
    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """encoded without the ids, with text: their bytes as UTF-8, � for what isn't; null ids count as none."""
    kept = [c for c in encoded.columns if c not in (ids, "text")]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            texts = [own.decode(x or ()).decode("utf-8", "replace") for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, "text"])

    small_batches(encoded.sparkSession)
    return encoded.select(*kept, ids).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 (of the bytes that the ids decode to).

    encode() and decode() of each text within one pass, so that the ids of a large corpus need not leave the worker.
    """
    kept = [c for c in docs.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for held in gathered(batches, len(kept)):
            with _no_cycles():
                own.learn([x for _, texts in held for x in texts])
            for b, texts in held:
                counts, digests, decoded = [], [], []
                for x in texts:
                    ids = own.encode(x)
                    counts.append(len(ids))
                    digests.append(own.digest(ids))
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], [*kept, *[f.name for f in added]])
            give_back()

    small_batches(docs.sparkSession)
    return docs.select(*kept, text).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
