"""Benchmark decontamination: greedy string tiling of documents with benchmark items, from seeds of shared words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octarine.llm.common import small_batches, table

#: Words of the shortest tile; an item of fewer words is one tile.
TILE = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
#: Bytes of items that are held at once; a larger benchmark is taken in blocks, with a pass over the documents for each.
BLOCK_BYTES = 16 << 20
_BASE, _MOD = 1_000_003, (1 << 61) - 1
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(29))
#: Upper case to lower case, and ASCII that is no letter or digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case; words are what stands between other ASCII characters than letters and digits."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _windows(run: list[int], size: int) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of each window of the run, by Karp and Rabin."""
    if len(run) < size:
        return
    lead, h = pow(_BASE, size - 1, _MOD), 0
    for x in run[:size]:
        h = (h * _BASE + x) % _MOD
    yield 0, h
    for k in range(size, len(run)):
        h = ((h - run[k - size] * lead) * _BASE + run[k]) % _MOD
        yield k - size + 1, h


def _free(marked: bytearray) -> Iterator[tuple[int, int]]:
    """The unmarked stretches."""
    end = 0
    while (start := marked.find(0, end)) >= 0:
        end = marked.find(1, start)
        end = len(marked) if end < 0 else end
        yield start, end


def tiles(item: list[int], text: list[int], shortest: int = TILE) -> list[tuple[int, int, int]]:
    """(start in the item, start in the text, length) of non-overlapping common stretches, the longest first.

    Running Karp-Rabin greedy string tiling: windows of a size that starts large are met by their rolling hashes,
    verified and grown; the longest of what is unmarked on both sides is marked, again and again, and then the size
    is halved, down to the shortest tile. Ties: the earliest in the item, then in the text. It ends where all of the item is marked.
    """
    found: list[tuple[int, int, int]] = []
    marked_item, marked_text, left = bytearray(len(item)), bytearray(len(text)), len(item)
    size = max(shortest, min(len(item), len(text)))
    while True:
        seen = defaultdict(list)
        for a, b in _free(marked_item):
            for k, h in _windows(item[a:b], size):
                seen[h].append(a + k)
        matches = []
        for a, b in _free(marked_text) if seen else ():
            for k, h in _windows(text[a:b], size):
                for p in seen.get(h, ()):
                    t = a + k
                    if p and t and item[p - 1] == text[t - 1] and not marked_item[p - 1] and not marked_text[t - 1]:
                        continue  # the same stretch was met a word earlier
                    if item[p : p + size] != text[t : t + size]:
                        continue
                    n = size
                    while p + n < len(item) and t + n < len(text) and not marked_item[p + n] and not marked_text[t + n] and item[p + n] == text[t + n]:
                        n += 1
                    matches.append((-n, p, t))
        heapify(matches)
        while matches and left:
            n, p, t = heappop(matches)
            n = -n
            one, two = marked_item[p : p + n], marked_text[t : t + n]
            if 1 in one or 1 in two:  # what is left of it waits its turn
                for a, b in _free(bytearray(x | y for x, y in zip(one, two, strict=True))):
                    if b - a >= size:
                        heappush(matches, (a - b, p + a, t + a))
                continue
            found.append((p, t, n))
            marked_item[p : p + n] = marked_text[t : t + n] = b"\1" * n
            left -= n
        if size == shortest or not left:
            return found
        size = max(shortest, size // 2)


@dataclass
class Index:
    """The items of one block: word numbers, and by tile size the hash of every window with the items it is in."""

    ids: list[int]
    items: list[list[int]]
    vocabulary: dict[bytes, int]
    seeds: dict[int, tuple[np.ndarray, list[list[int]]]]


def index(items: tuple[tuple[int, str], ...], tile: int = TILE) -> Index:
    vocabulary: dict[bytes, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)] for _, text in items]
    found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    for k, x in enumerate(coded):
        if size := min(tile, len(x)):
            for h in _hashes(np.array(x, np.int64), np.arange(len(x) - size + 1), size).tolist():
                found[size][h].add(k)
    seeds = {size: (np.array(sorted(own), np.uint64), [sorted(own[h]) for h in sorted(own)]) for size, own in found.items()}
    return Index([i for i, _ in items], coded, vocabulary, seeds)


def _hashes(ids: np.ndarray, at: np.ndarray, tile: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(tile):
        h = (h ^ ids[at + k].astype(np.uint64)) * _ODD[0]
        h ^= h >> _ODD[1]
    return h


def contaminations(text: str | None, known: Index, coverage: float = COVERAGE) -> list[tuple[int, int, int, float]]:
    """(item_id, tiles, words covered, share covered) of each item that the whole text covers by the given share at least."""
    tokens = words(text)
    ids = np.fromiter(map(known.vocabulary.get, tokens, repeat(0)), np.int64, len(tokens))
    out = []
    for size in known.seeds:
        out += [(known.ids[k], *x) for k, x in _covered(ids, known, size, coverage)]
    return out


def _covered(ids: np.ndarray, known: Index, size: int, coverage: float) -> Iterator[tuple[int, tuple[int, int, float]]]:
    """Items whose tiles have this size at least, with (tiles, words covered, share covered)."""
    if len(ids) < size:
        return
    seeds, owners = known.seeds[size]
    inside = ids > 0
    run = inside[: len(ids) - size + 1].copy()
    for k in range(1, size):
        run &= inside[k : len(ids) - size + 1 + k]
    at = np.flatnonzero(run)
    if not len(at):
        return
    h = _hashes(ids, at, size)
    place = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
    hit = seeds[place] == h
    starts = defaultdict(list)
    for a, p in zip(at[hit].tolist(), place[hit].tolist(), strict=True):
        for k in owners[p]:
            starts[k].append(a)
    for k in sorted(starts):
        part, last, strange = [], -1, 0  # the words of the seeds; between stretches a number that no word has
        for a in starts[k]:
            if a > last and part:
                strange -= 1
                part.append(strange)
            part.extend(ids[max(a, last) : a + size].tolist())
            last = a + size
        item = known.items[k]
        if len(item) * coverage > len(part):
            continue
        got = tiles(item, part, size)
        covered = sum(n for _, _, n in got)
        if covered >= coverage * len(item):
            yield k, (len(got), covered, covered / len(item))


@lru_cache(2)
def _held(items: tuple[tuple[int, str], ...], tile: int) -> Index:
    return index(items, tile)


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items (item_id, text) in blocks of about so many bytes; what the driver and a worker hold is one block. A null text has no words."""
    some = benchmark.where("text is not null").select("item_id", "text").distinct()
    total = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // most) + 1
    for k in range(n):
        part = some.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        if got := tuple(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1]))):
            yield got


def pairs(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_words, coverage): each document with each item that its tiles cover enough of.

    The order of an item's parts in the document does not matter. Every row of docs is judged alone over its whole text: a repeated
    row gives its pairs again, a null or short text none; other columns are ignored. An empty benchmark gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("n_tiles", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("coverage", T.DoubleType())])
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = _held(held.value, tile)
            for b in batches:
                found = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in contaminations(t, known, coverage)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, (b.schema.field(0).type, _arrow(schema[1].dataType), pa.int64(), pa.int64(), pa.float64()), strict=True)], schema.names)

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, that cover no item by the given share."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for block in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = _held(held.value, tile)
            for b in batches:
                yield b.filter(pa.array([not contaminations(t, known, coverage) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
