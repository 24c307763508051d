"""Tokens of two tokenizers side by side: both cut a text at some of the same places, and the tokens between two such places belong together."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from octarine.llm.bpe import _Cache, _no_cycles
from octarine.llm.common import checkpoint_dir, give_back, small_batches, table

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Entries of a worker's cache of chunks; what is dropped is computed again. Characters of the texts of one block.
CACHE, BLOCK = 250_000, 6 << 20
#: Bytes of blocks that a task holds while it writes or reads them.
HELD = 16 << 20
#: Bits of a pair's code that hold the first tokenizer's id.
LOW = 17


def byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: itself where that is seen, else the next one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligned(NamedTuple):
    """A text's tokens by both: their numbers, the groups as text, and the links as packed codes of id pairs."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    text: str
    codes: bytes


class Aligner:
    """Both tokenizers, and a cache of what stands between two spaces."""

    def __init__(self, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task is one thread
        self.a, self.b = Tokenizer.from_file(byte_bpe), SentencePieceProcessor(model_file=piece_bpe)
        self.a.encode_special_tokens = True
        byte_of, names = byte_characters(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.a_bytes[k] = bytes(map(byte_of.__getitem__, name))
        pieces = map(self.b.id_to_piece, range(self.b.vocab_size()))
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.names = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        with open(byte_bpe, encoding="utf-8") as file:
            told = json.load(file)
        #: Whether single spaces are known to begin a token of both: a pattern of words with the space before them, and pieces that have a space in front or are all spaces.
        pre = told.get("pre_tokenizer") or {}
        inner = any(" " in p.lstrip(b" ").decode("utf-8", "replace") for k, p in enumerate(self.b_bytes) if not self.b.is_byte(k))
        plain = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.spaced = plain and not inner and self.b.encode("a") == self.b.encode(["a"])[0] and self.b.id_to_piece(self.b.encode("a")[0]).startswith("▁")
        self.chunks = _Cache(lambda c: self._align([c])[0], cache)

    def _aligned(self, text: str, a: list[int], b: list[int]) -> Aligned | None:
        """None where the bytes of the tokens are not those of a space and the text."""
        wanted = (" " + text).encode()
        if b"".join([self.a_bytes[k] for k in a]) != wanted or b"".join([self.b_bytes[k] for k in b]) != wanted:
            return None
        names, n_a, n_b = self.names, len(a), len(b)
        if n_a == 1 or n_b == 1:  # one group, in which all overlap
            told = f"{','.join([names[t] for t in a])}|{','.join([names[t] for t in b])}"
            return Aligned(n_a, n_b, 1, n_a * n_b, told, array("q", [v << LOW | u for u in a for v in b]).tobytes())
        # both side by side: the token that ends first is followed by its next, and a group ends where both do
        a_sizes, b_sizes, told, codes = self.a_sizes, self.b_sizes, [], []
        i = j = i_from = j_from = 0
        lead = a_sizes[a[0]] - b_sizes[b[0]]
        while True:
            codes.append(b[j] << LOW | a[i])
            if lead > 0:
                j += 1
                lead -= b_sizes[b[j]]
            elif lead < 0:
                i += 1
                lead += a_sizes[a[i]]
            else:
                i, j = i + 1, j + 1
                if i - i_from == 1 and j - j_from == 1:
                    told.append(f"{names[a[i_from]]}|{names[b[j_from]]}")
                else:
                    told.append(f"{','.join([names[t] for t in a[i_from:i]])}|{','.join([names[t] for t in b[j_from:j]])}")
                if i == n_a or j == n_b:
                    break
                i_from, j_from = i, j
                lead = a_sizes[a[i]] - b_sizes[b[j]]
        return Aligned(n_a, n_b, len(told), len(codes), ";".join(told), array("q", codes).tobytes())

    def _align(self, texts: list[str]) -> list[Aligned | None]:
        """Each text with a space before it."""
        ones = self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)
        return [self._aligned(text, one.ids, b) for text, one, b in zip(texts, ones, self.b.encode(texts, num_threads=1), strict=True)]

    def cut(self, text: str) -> list[str] | None:
        """The text cut at its spaces, each of which begins a token of both and so ends a group; None where that is not so for all."""
        if not self.spaced or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or "▁" in text or not text.replace("\n", "").isprintable():
            return None
        return text.split(" ")

    def learn(self, texts: Iterable[str | None]) -> None:
        """Aligns the chunks of these texts that are new to the cache."""
        self.chunks.turn()
        found: set[str] = set()
        for text in texts:
            if text:
                found.update(self.cut(text) or ())
        new = self.chunks.lacks(found)
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            self.chunks.update(zip(some, self._align(some), strict=True))

    def parts(self, text: str | None) -> list[str] | list[Aligned]:
        """What the text consists of: chunks of the cache, or one alignment of the whole. Nothing if that has no tokens; a chunk may have none, and then the text has none either."""
        if not text:
            return []
        if (found := self.cut(text)) is not None:
            return found
        return [whole] if (whole := self._align([text])[0]) else []

    def groups(self, text: str | None) -> str:
        """'a1,a2|b1;a3|b2,b3': ids of both by groups, in order."""
        met = [p if isinstance(p, Aligned) else self.chunks[p] for p in self.parts(text)]
        return "" if None in met else ";".join([m.text for m in met])


@lru_cache(2)
def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(byte_bpe, piece_bpe)


def gathered(batches: Iterator[pa.RecordBatch], at: int, size: int = BLOCK) -> Iterator[tuple[list[pa.RecordBatch], list[str | None]]]:
    """Batches together until their texts have so many characters."""
    held, texts, n = [], [], 0
    for b in batches:
        more = b.column(at).to_pylist()
        held.append(b)
        texts += more
        n += sum(len(x) for x in more if x)
        if n >= size:
            yield held, texts
            held, texts, n = [], [], 0
    if held:
        yield held, texts


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, text: str = "text") -> DataFrame:
    """docs without the text, with groups: an array of (a, b), the ids of both tokenizers that cover the same bytes of a space and the text.

    Null and empty texts, and those that either tokenizer does not give back byte by byte, have none. Repeated rows and extra columns stay, but for one named
    groups, which is replaced; an empty table gives an empty one. Texts are aligned whole, however long.
    """
    kept = [c for c in docs.columns if c not in (text, "groups")]
    group = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in "ab"])
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("groups", T.ArrayType(group))])
    arrow = pa.list_(pa.struct([(c, pa.list_(pa.int32())) for c in "ab"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_bpe, piece_bpe)
        for held, texts in gathered(batches, len(kept)):
            own.learn(texts)
            at = 0
            for b in held:
                told = [own.groups(x) for x in texts[at : at + b.num_rows]]
                at += b.num_rows
                rows = [[{c: list(map(int, side.split(","))) for c, side in zip("ab", g.split("|"), strict=True)} for g in x.split(";")] if x else [] for x in told]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(rows, arrow)], [*kept, "groups"])

    small_batches(docs.sparkSession)
    return docs.select(*kept, text).mapInArrow(run, schema)


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


#: What a block of texts keeps: a row's id and figures, its chunks by number, each chunk's links by the number of their pair; and its pairs, with how often each is linked.
BLOCKS = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, chunks binary, chunk_ends binary, linked binary, link_ends binary, pairs array<long>, counts array<long>"


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values from one end to the next."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[ends] - run[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0, np.int64)


#: Stands for a chunk without tokens.
NOTHING = Aligned(0, 0, 0, 0, "", b"")


def _block(own: Aligner, number: int, ids: list[int | None], texts: list[str | None]) -> dict:
    chunk_no = _Numbers()
    own.learn(texts)
    docs = [list(map(chunk_no.__getitem__, own.parts(x))) for x in texts]
    met = [p if isinstance(p, Aligned) else own.chunks[p] for p in chunk_no]
    if None in met:
        bad = {k for k, m in enumerate(met) if m is None}
        docs, met = [[] if bad.intersection(d) else d for d in docs], [m or NOTHING for m in met]
    told = [m.text for m in met]
    digests = [hashlib.sha256(";".join(map(told.__getitem__, d)).encode()).hexdigest() if d else "" for d in docs]
    at, ends = np.fromiter(chain.from_iterable(docs), np.int32), np.cumsum([len(d) for d in docs], dtype=np.int64)
    per_chunk = np.array([m[:4] for m in met], np.int64).reshape(-1, 4).T
    times = np.bincount(at, minlength=len(met))
    pairs, linked = np.unique(np.frombuffer(b"".join([m.codes for m in met]), np.int64), return_inverse=True)
    counts = np.bincount(linked, np.repeat(times, per_chunk[3]), len(pairs)).astype(np.int64)
    figures = [_sums(c[at], ends) for c in per_chunk]
    return dict(zip([c.split()[0] for c in BLOCKS.split(", ")], [number, ids, *figures, digests, at.tobytes(), ends.tobytes(), linked.astype(np.int32).tobytes(), np.cumsum(per_chunk[3]).tobytes(), pairs, counts], strict=True))


def _blocks(docs: DataFrame, byte_bpe: str, piece_bpe: str, id: str, text: str) -> DataFrame:
    """A row for each block of texts of a task."""
    arrow = pa.schema([(c, pa.list_(pa.int64()) if t == "array<long>" else pa.list_(pa.string()) if t == "array<string>" else pa.binary() if t == "binary" else pa.int64()) for c, t in (x.split() for x in BLOCKS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = aligner(byte_bpe, piece_bpe), TaskContext.get().partitionId()
        for k, (held, texts) in enumerate(gathered(batches, 1)):
            ids = [x for b in held for x in b.column(0).to_pylist()]
            with _no_cycles():
                made = _block(own, part << 32 | k, ids, texts)
            yield pa.RecordBatch.from_pylist([made], arrow)
            give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, BLOCKS)


def link_figures(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of docs, by the links of the whole corpus.

    n_links: pairs of tokens that overlap; an id pair's count: links of all texts that hold it; n_best: links whose pair has its b id's highest count, ties
    included; count_sum: the counts of all links. groups_sha256: of 'a1,a2|b1;a3|b2,b3', '' without tokens. Null and empty texts, and those that
    either tokenizer does not give back, have no tokens and zeros. A null id, repeated ids and repeated rows stand; other columns are left out; no rows give none.

    A block of texts is one row with its distinct pairs, so that the exchange grows with a block's vocabulary, not with its tokens. Pairs
    of a common token have a row in each block, summed before they are exchanged; the table of counts is bounded by the vocabularies. Blocks are written to the
    shared checkpoint folder, so that their numbers hold if an executor is lost. A block is some megabytes, and a writer looks at its size after a hundred rows only, a reader takes
    thousands at once: so row groups are of HELD bytes, looked at after each row, and a block meets its counts alone.
    """
    spark, folder = docs.sparkSession, f"{checkpoint_dir(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
    held = {"parquet.block.size": HELD, "parquet.column.statistics.enabled": False} | {f"parquet.{x}.size.row.check.{m}": 1 for x in ("block", "page") for m in ("min", "max")}
    _blocks(docs, byte_bpe, piece_bpe, id, text).write.options(**held).parquet(f"{folder}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    rows = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "pair")).select("block", "at", F.col("pair.pairs").alias("pair"), F.col("pair.counts").alias("n"))
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", LOW)))
    counts.withColumn("best", F.col("count") == highest).write.parquet(f"{folder}/counts")
    counts = spark.read.schema("pair long, count long, best boolean").parquet(f"{folder}/counts")
    out = T._parse_datatype_string(f"{id} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        at = told["at"].to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = told["count"].to_numpy(), told["best"].to_numpy()
        one = lambda c, kind: np.frombuffer(block[c][0].as_py(), kind)
        linked, chunks, link_ends, ends = one("linked", np.int32), one("chunks", np.int32), one("link_ends", np.int64), one("chunk_ends", np.int64)
        sums = [pa.array(_sums(_sums(v[linked], link_ends)[chunks], ends)) for v in (best, count)]
        kept = [block[c][0].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "digests")]
        return pa.Table.from_arrays([*kept[:5], *sums, kept[5]], out.names)

    small_batches(spark)
    told = rows.join(counts, "pair").select(F.col("block").alias("of"), "at", "count", "best")
    return blocks.drop("pairs", "counts").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, out)


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by both tokenizers aligned, with the figures of its links; texts without tokens have zeros."""
    return link_figures(table(spark, sf_dir, "documents"))
