"""Suffix-array dedup: byte strings that earlier documents hold too, from the interval trees of sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octarine.llm.common import cut, give_back, small_batches, table

#: Bytes of a string that counts as repeated, and of the anchors within it: SPAN windows of ANCHOR bytes are in LENGTH bytes.
LENGTH, ANCHOR = 50, 16
SPAN = LENGTH - ANCHOR + 1
#: Bytes of context kept before an anchor, and from it on.
LEFT, RIGHT = LENGTH - ANCHOR, LENGTH
#: Bytes of text in a block of documents, of text for each group of anchors, and of text worked on at once.
BLOCK_BYTES, GROUP_BYTES, SLICE = 6 << 20, 24 << 20, 1 << 19
#: Contexts whose suffix array is built at once.
CONTEXTS = 20_000
#: Where a null doc_id stands: after all others.
LAST = np.iinfo(np.int64).max
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _pack(x: np.ndarray) -> bytes:
    """By planes of bytes, as sorted or small numbers differ in few of them."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), 1) if len(x) else b""


def _unpack(x: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(size, -1).T).reshape(-1).view(kind) if x else np.zeros(0, kind)


def blocks(docs: DataFrame, size_of: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_ids, lengths, raw): documents (doc_id, text) as UTF-8 bytes, some megabytes to a row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, size = TaskContext.get().partitionId() << 32, [], [], 0
        names = ["block", "doc_ids", "lengths", "raw"]

        def done() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_pack(np.array(ids, np.int64))], pa.binary()), pa.array([_pack(lengths)], pa.binary()), pa.array([zstandard.compress(b"".join(parts), 3)], pa.binary())], names)

        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(LAST if d is None else d)
                parts.append((text or "").encode("utf-8", "replace"))
                size += len(parts[-1])
                if size >= size_of:
                    yield done()
                    number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield done()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, doc_ids binary, lengths binary, raw binary")


def _words(raw: np.ndarray, at: int, n: int) -> np.ndarray:
    """The eight bytes from each of n places on."""
    return np.lib.stride_tricks.as_strided(raw[at:].view(np.uint8), (n, 8), (1, 1)).copy().view("<u8").reshape(-1) if n > 0 else np.zeros(0, np.uint64)


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """best over x[i : i + size] for each i, by doubling."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(raw: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 48-bit hashes of the anchors of documents that stand one after another in raw.

    An anchor is the ANCHOR bytes of the least hash (all, where there is a tie) in some string of LENGTH bytes of one document. Which
    ones a string has depends on its bytes alone, so wherever it occurs it has the same, at the same distance.
    """
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.zeros(len(raw) + 1, np.int32)  # strings of LENGTH bytes start at these places
    long_ = ends - starts >= LENGTH
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, ends[long_] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    places, hashes = [], []
    for a in range(0, len(raw) - ANCHOR + 1, SLICE):
        lo = max(0, a - SPAN + 1)  # strings that an anchor from a on may be the least of start here
        n = min(len(raw) - ANCHOR + 1, a + SLICE + SPAN - 1) - lo
        one, two = _words(raw, lo, n), _words(raw, lo + 8, n)
        h = (one * _ODD[0]) ^ (two * _ODD[1])
        h = (h ^ (h >> np.uint64(29))) * _ODD[2]
        small = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = _sliding(small, SPAN, np.minimum)
        least[~inside[lo : lo + len(least)]] = 0
        # of the strings that hold a place, the one whose least hash is the most
        most = _sliding(np.concatenate([np.zeros(SPAN - 1, np.uint32), least, np.zeros(SPAN - 1, np.uint32)]), SPAN, np.maximum)[: len(small)]
        found = np.flatnonzero(most == small)
        found = found[(found + lo >= a) & (found + lo < a + SLICE)]
        places.append(found + lo)
        own = h[found]  # the least of many, so mixed again to be spread evenly
        hashes.append(((own ^ (own >> np.uint64(32))) * _ODD[0]) >> np.uint64(16))
    return np.concatenate(places), np.concatenate(hashes)


class Block:
    """A block's documents and anchors."""

    def __init__(self, doc_ids: bytes, lengths: bytes, raw: bytes):
        self.doc_ids, self.lengths = _unpack(doc_ids, "<i8"), _unpack(lengths, "<i8")
        self.raw = np.frombuffer(zstandard.decompress(raw), np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.places, self.hashes = anchors(self.raw, self.ends, self.starts)

    def classes(self, elsewhere: np.ndarray) -> Classes | None:
        """The anchors that other blocks or other documents here have too; elsewhere: sorted hashes of the former."""
        if not len(self.places):
            return None
        order = np.argsort(self.hashes, kind="stable")
        h, at = self.hashes[order], self.places[order]
        doc = np.searchsorted(self.ends, at, side="right")
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        keep = several[group]
        if len(elsewhere):
            place = np.minimum(np.searchsorted(elsewhere, h), len(elsewhere) - 1)
            keep |= elsewhere[place] == h
        return Classes(self, at[keep], h[keep], doc[keep]) if keep.any() else None


class Classes:
    """Anchor places in classes of equal hash and context, which ends where the document does."""

    def __init__(self, block: Block, at: np.ndarray, h: np.ndarray, doc: np.ndarray):
        left, right = np.minimum(LEFT, at - block.starts[doc]), np.minimum(RIGHT, block.ends[doc] - at)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), block.raw, np.zeros(RIGHT, np.uint8)])
        columns, step = np.arange(LEFT + RIGHT), 1 << 15

        def contexts(rows: np.ndarray) -> np.ndarray:
            part = padded[at[rows, None] + columns]
            part[columns < LEFT - left[rows, None]] = 0
            part[columns >= LEFT + right[rows, None]] = 0
            return part

        pieces = [np.arange(a, min(a + step, len(at))) for a in range(0, len(at), step)]
        digest = np.concatenate([digests(contexts(k), left[k], right[k]) for k in pieces])
        order = np.lexsort((digest, h))
        h, digest = h[order], digest[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (digest[1:] != digest[:-1])])
        first = np.flatnonzero(new)
        #: By occurrence: its class, place, and the id of its document.
        self.of, self.at, self.doc = np.cumsum(new) - 1, at[order], block.doc_ids[doc[order]]
        #: By class.
        some = order[first]
        self.h, self.left, self.right = h[first], left[some], right[some]
        self.context = np.concatenate([contexts(some[a : a + step]) for a in range(0, len(some), step)])
        self.least = np.minimum.reduceat(self.doc, first)


def digests(context: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hashes of contexts with their lengths."""
    words = np.zeros((len(context), (LEFT + RIGHT + 7) // 8 * 8), np.uint8)
    words[:, : LEFT + RIGHT] = context
    h = (left.astype(np.uint64) << np.uint64(8) | right.astype(np.uint64)) * _ODD[0]
    for w in words.view("<u8").T:
        h = (h ^ w) * _ODD[1]
        h ^= h >> np.uint64(31)
        h *= _ODD[2]
        h ^= h >> np.uint64(29)
    return h


def _intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(common prefix, that of the interval around it, first, last) of each interval of a suffix array, children first.

    The stack scan over an enhanced suffix array; lcp[k] is the common prefix of the suffixes k and k + 1.
    """
    stack: list[tuple[int, int]] = []
    for k, x in enumerate([*lcp, -1]):
        first = k
        while stack and stack[-1][0] > x:
            high, first = stack.pop()
            yield high, max(x, stack[-1][0] if stack else -1), first, k
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def repeats(left: list[bytes], docs: list[int], lcp: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each suffix of one anchor, in their order: (least, most, doc) ranges of how many bytes after the anchor's start a string of LENGTH bytes goes on, and the least document that has that string.

    left holds the bytes before the anchor, the nearest first. An interval's suffixes share its prefix; where they
    share the bytes before it as well, they are one group of a repeat with all its occurrences, else the bytes to the
    left tell them apart, and each of the groups is one.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for high, around, a, b in _intervals(lcp):
        low = max(around + 1, ANCHOR)
        if high < low:
            continue
        members = range(a, b + 1)
        same = min(map(len, (left[k] for k in members)))
        some = left[a][:same]
        for k in members:
            while not left[k].startswith(some):
                some = some[:-1]
        split = max(low, min(high + 1, LENGTH - len(some)))  # from here on the left sides agree
        if split <= high:
            doc = min(docs[a : b + 1])
            for k in members:
                out[k].append((split, high, doc))
        for r in range(low, split):
            need, least = LENGTH - r, {}
            for k in members:
                if len(x := left[k]) >= need:
                    x = x[:need]
                    if (d := least.get(x)) is None or docs[k] < d:
                        least[x] = docs[k]
            for k in members:
                if len(x := left[k]) >= need:
                    out[k].append((r, r, least[x[:need]]))
    return out


def _lcp(context: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common prefixes of the right sides of neighbouring rows."""
    differ = context[1:, LEFT:] != context[:-1, LEFT:]
    first = np.where(differ.any(1), differ.argmax(1), RIGHT)
    return np.minimum(first, np.minimum(right[1:], right[:-1]))


def _resolve(h: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, least, most, doc) of repeats() for contexts of one group of anchors, where doc is less than the row's own."""
    digest = digests(context, left, right)
    order = np.lexsort((docs, digest, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (digest[order][1:] != digest[order][:-1])])
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    some = order[new]  # one row for each context: that of its least document
    words = np.zeros((len(some), 56), np.uint8)
    words[:, :RIGHT] = context[some, LEFT:]
    words[:, 55] = right[some]
    keys = words.view(">u8").T
    array = np.lexsort((*keys[::-1], h[some]))  # the suffix array
    rows = some[array]
    hs, ds = h[rows], docs[rows]
    ctx, ll, rl = context[rows], left[rows], right[rows]
    starts = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
    ends = np.append(starts[1:], len(hs))
    whole = [[] for _ in range(4)]  # contexts that are all their anchor has: each string in them is one repeat
    alone = np.flatnonzero(ends - starts == 1)
    at = starts[alone]
    ok = ll[at] + rl[at] >= LENGTH
    at = at[ok]
    for x, y in zip(whole, (at, LENGTH - ll[at], rl[at], ds[at]), strict=True):
        x.append(y.astype(np.int64))
    if len(hs) > 1:
        lcp = _lcp(ctx, rl).tolist()
        backward = np.ascontiguousarray(ctx[:, :LEFT][:, ::-1])
        got: tuple[list, list, list, list] = ([], [], [], [])
        for k in np.flatnonzero(ends - starts > 1).tolist():
            a, b = int(starts[k]), int(ends[k])
            lefts = [backward[i, : ll[i]].tobytes() for i in range(a, b)]
            single = [(i, LENGTH - int(ll[i]), int(rl[i])) for i in range(a, b)]
            found = repeats(lefts, ds[a:b].tolist(), lcp[a : b - 1])
            for (i, low, high), ranges in zip(single, found, strict=True):
                if low <= high:
                    got[0].append(i), got[1].append(max(low, ANCHOR)), got[2].append(high), got[3].append(int(ds[i]))
                for low, high, doc in ranges:
                    got[0].append(i), got[1].append(low), got[2].append(high), got[3].append(doc)
        for x, y in zip(whole, got, strict=True):
            x.append(np.array(y, np.int64))
    place, low, high, doc = (np.concatenate(x) for x in whole)
    # back from the suffix array to all rows of a context
    context_of = array[place]
    order = np.argsort(context_of, kind="stable")
    context_of, low, high, doc = context_of[order], low[order], high[order], doc[order]
    begin, end = np.searchsorted(context_of, of), np.searchsorted(context_of, of, side="right")
    n = end - begin
    row = np.repeat(np.arange(len(h)), n)
    pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    less = doc[pick] < docs[row]
    row, pick = row[less], pick[less]
    return row, low[pick], high[pick], doc[pick]


def _by_ranges(h: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """_resolve() for some thousands of contexts at a time, cut between anchors; the result is in the order of the rows."""
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    parts, a = [], 0
    while a < len(h):
        b = min(len(h), a + CONTEXTS)
        b = int(np.searchsorted(sorted_h, sorted_h[b - 1], side="right"))
        pick = order[a:b]
        row, low, high, doc = _resolve(h[pick], *[c[pick] for c in columns])
        parts.append((pick[row].astype(np.uint32), low.astype(np.uint8), high.astype(np.uint8), doc))
        a = b
    row, low, high, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], low[order], high[order], doc[order]


def covered(classes: Classes, found: tuple[np.ndarray, ...], size: int) -> np.ndarray:
    """Which bytes of a block strings with an earlier copy cover; found: (class, least, most, doc), as from repeats()."""
    edges = np.zeros(size + 1, np.int32)

    def add(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        np.add.at(edges, at + low - LENGTH, 1)
        np.add.at(edges, at + high, -1)

    own = (classes.doc > classes.least[classes.of]) & (classes.left + classes.right >= LENGTH)[classes.of]
    of = classes.of[own]
    add(classes.at[own], LENGTH - classes.left[of], classes.right[of])
    first = np.searchsorted(classes.of, np.arange(len(classes.h) + 1))
    k, low, high, doc = found
    n = first[k + 1] - first[k]
    pick = np.repeat(np.arange(len(k)), n)
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k], n)
    later = classes.doc[row] > doc[pick]
    row, pick = row[later], pick[later]
    add(classes.at[row], low[pick], high[pick])
    return np.cumsum(edges[:-1]) > 0


def _listed(blocks_: DataFrame, groups: int) -> DataFrame:
    """(block, hashes): of each block's anchors, those that other blocks have too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *parts in zip(*b.columns, strict=True):
                h = np.unique(Block(*[x.as_py() for x in parts]).hashes)
                bounds = np.searchsorted(h, [(g << 48) // groups for g in range(groups)]).tolist()
                some = [(g, x) for g, x in enumerate(np.split(h, bounds[1:])) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in some], pa.int64()), pa.array([block.as_py()] * len(some), pa.int64()), pa.array([_pack(x) for _, x in some], pa.binary())], ["part", "block", "hashes"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x, "<u8") for x in rows["hashes"]]
        h = np.sort(np.concatenate(parts))
        twice = np.unique(h[1:][h[1:] == h[:-1]])
        kept = [x[np.isin(x, twice, assume_unique=True)] for x in parts]
        return pd.DataFrame({"block": rows["block"], "hashes": [_pack(x) for x in kept]})[[len(x) > 0 for x in kept]]

    dealt = blocks_.mapInArrow(deal, "part long, block long, hashes binary")
    return dealt.groupBy("part").applyInPandas(meet, "block long, hashes binary")


_FOUND = (("k", "<u4"), ("low", "u1"), ("high", "u1"), ("doc", "<i8"))
_SENT = (("h", "<u8"), ("k", "<u4"), ("left", "u1"), ("right", "u1"), ("doc", "<i8"))


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, least_groups: int = 12) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs (doc_id, text): the removed runs of bytes and what is left.

    A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Texts are
    UTF-8, whole, and judged as they come in; a null text is empty; a null doc_id is greater than all others. Strings don't cross
    documents. Rows of one doc_id don't remove each other's bytes; extra columns are ignored.

    Blocks of documents find their anchors; a first exchange tells each block which of them other blocks have. Of
    those, each block sends one context for each class of equal ones, however many copies it holds. A task gets the
    contexts of a range of anchor hashes, sorts them into a suffix array, and from its interval tree, with the
    bytes to the left, finds each repeat's group and the least document in it. The blocks then cover their bytes.
    A string in every document comes to one task once from a block, not once from a document.
    """
    made = cut(blocks(docs, block_bytes))
    total = made.select(F.sum(F.length("raw"))).first()[0] or 0
    groups = max(least_groups, int(total * 2.5 // GROUP_BYTES))
    listed = cut(_listed(made, groups)).select("block", "hashes", F.lit(None).cast("binary").alias("found"))
    own = made.select(F.col("block").alias("own"), "doc_ids", "lengths", "raw")

    def send(key: tuple, lists: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            classes = Block(row.doc_ids, row.lengths, row.raw).classes(_known(lists))
            if classes is None:
                continue
            part = (classes.h.astype(object) * groups >> 48).astype(np.int64) if groups > 1 << 15 else (classes.h * np.uint64(groups) >> np.uint64(48)).astype(np.int64)
            k = np.arange(len(classes.h))
            for g in np.unique(part).tolist():
                a, b = np.searchsorted(part, [g, g + 1])
                columns = (classes.h, k, classes.left, classes.right, classes.least)
                packed = [_pack(c[a:b].astype(t)) for c, (_, t) in zip(columns, _SENT, strict=True)]
                out.append((g, row.own, *packed, zstandard.compress(classes.context[a:b].tobytes(), 1)))
        give_back()
        return pd.DataFrame(out, columns=["part", "block", *[n for n, _ in _SENT], "context"])

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        h, k, left, right, doc = (np.concatenate([_unpack(x, t) for x in rows[n]]) for n, t in _SENT)
        sizes = [len(_unpack(x, "u1")) for x in rows["left"]]
        context = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8).reshape(-1, LEFT + RIGHT) for x in rows["context"]])
        row, low, high, least = _by_ranges(h, context, left.astype(np.int64), right.astype(np.int64), doc)
        ends = np.searchsorted(row, np.cumsum([0, *sizes])).tolist()
        packed = []
        for a, b in zip(ends, ends[1:], strict=False):
            values = (k[row[a:b]], low[a:b], high[a:b], least[a:b])
            packed.append(_joined([_pack(v.astype(t)) for v, (_, t) in zip(values, _FOUND, strict=True)]) if b > a else None)
        del h, k, left, right, doc, context, row, low, high, least
        give_back()
        return pd.DataFrame({"block": rows["block"], "found": packed})[[x is not None for x in packed]]

    def finish(key: tuple, told: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            block = Block(row.doc_ids, row.lengths, row.raw)
            classes = block.classes(_known(told[told["hashes"].notna()]))
            gone = np.zeros(len(block.raw), bool)
            if classes is not None:
                parts = [_parted(x) for x in told["found"] if x is not None]
                found = tuple(np.concatenate([_unpack(p[c], t) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c, (_, t) in enumerate(_FOUND))
                gone = covered(classes, found, len(block.raw))
            for d, a, b in zip(block.doc_ids.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True):
                mask = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist() if mask.any() else []
                kept = block.raw[a:b][~mask].tobytes() if edges else block.raw[a:b].tobytes()
                out.append((d if d != LAST else None, b - a, edges[::2], edges[1::2], kept))
        give_back()
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "starts", "ends", "kept"]).astype({"doc_id": "Int64"})

    fields = ", ".join(f"{n} binary" for n, _ in _SENT)
    sent = listed.groupBy("block").cogroup(own.groupBy("own")).applyInPandas(send, f"part long, block long, {fields}, context binary")
    found = sent.groupBy("part").applyInPandas(resolve, "block long, found binary").select("block", F.lit(None).cast("binary").alias("hashes"), "found")
    told = listed.unionByName(found)
    done = told.groupBy("block").cogroup(own.groupBy("own")).applyInPandas(finish, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    spans = F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return done.select("doc_id", "n_bytes", spans.alias("spans"), "kept")


def _known(lists: pd.DataFrame) -> np.ndarray:
    return np.sort(np.concatenate([_unpack(x, "<u8") for x in lists["hashes"]])) if len(lists) else np.zeros(0, np.uint64)


def _joined(parts: list[bytes]) -> bytes:
    return np.array(list(map(len, parts)), "<i8").tobytes() + b"".join(parts)


def _parted(x: bytes) -> list[bytes]:
    sizes = np.frombuffer(x[: 8 * len(_FOUND)], "<i8").tolist()
    at = np.cumsum([8 * len(_FOUND), *sizes]).tolist()
    return [x[a:b] for a, b in zip(at, at[1:], strict=False)]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
