"""Language identification: cosine with several clustered centroids per language of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octarine.llm.common import remainder, small_batches, table

#: Buckets of hashed n-grams.
BUCKETS = 1 << 12
#: Lengths in bytes of the n-grams.
GRAMS = (2, 3, 4)
#: About how many labelled texts per language centroids are clustered from: those whose hash is in a share of the range.
MOST_TEXTS = 600
CENTROIDS = 4
#: Languages that one model can hold, as every task has all centroids; more are an error.
MOST_LANGUAGES = 1000
#: A text is rejected if its cosine is below this share of the median that the clustered texts of its language have at its size.
#: Random letters have under half of it, and texts of the language seldom less than two thirds.
REJECT_SHARE = 0.6
#: Classes of texts' sizes, two for each doubling, and of how many texts of like size the median is taken.
SIZES, LIKE = 2 * 12 + 1, 60
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def counts(text: str | None) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text: UTF-8, ASCII letters in lower case, other ASCII as one space."""
    raw = b" " + b" ".join((text or "").encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    found = np.zeros(BUCKETS, np.int64)
    longest = max(GRAMS)
    for at in range(0, len(raw), BLOCK):
        part = np.frombuffer(raw, np.uint8, offset=at)[: BLOCK + longest - 1].astype(np.uint32)
        mixed = np.zeros(len(part), np.uint32)
        for k in range(longest):
            if len(part) <= k:
                break
            mixed = mixed[: len(part) - k] + part[k:] * _MIX[k]
            if k + 1 in GRAMS:
                own = mixed[:BLOCK]
                found += np.bincount((own ^ (own >> 15)) * _MIX[0] >> 20, minlength=BUCKETS)
    return found


def vector(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vector of (1 + log count) times idf; zeros if no n-gram has weight."""
    v = np.where(found > 0, 1 + np.log(np.maximum(found, 1)), 0) * idf
    norm = np.sqrt((v * v).sum())
    return (v / norm if norm > 0 else v).astype(np.float32)


def _size(found: np.ndarray) -> int:
    """How many different buckets a text has: a cosine grows with the root of it, however often the text repeats itself."""
    return max(1, int((found > 0).sum()))


def _size_class(size: np.ndarray) -> np.ndarray:
    return np.minimum(SIZES - 1, 2 * np.log2(size)).astype(np.int64)


def thresholds(cosine: np.ndarray, size: np.ndarray) -> np.ndarray:
    """By size class, the least cosine over the root of the size that is not rejected.

    It comes from the LIKE texts nearest in size at least, so a class with few texts shares those of its neighbours.
    Almost half of them can be junk. Without a text nothing is rejected.
    """
    least = np.zeros(SIZES)
    if len(size) == 0:
        return least
    each, at = cosine / np.sqrt(size), np.log2(size)
    for k in range(SIZES):
        away = np.abs(at - (k + 0.5) / 2)
        like = each[away <= max(0.25, np.sort(away)[min(LIKE, len(away)) - 1])]
        least[k] = REJECT_SHARE * np.median(like)
    return least


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row each
    of: np.ndarray  # the language of each centroid
    least: np.ndarray  # thresholds() of each language

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, cosine with its nearest centroid, and whether that is too far: for a text without a letter und, 0 and True."""
        found = [counts(x) if has_letter(x) else None for x in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        x = np.stack([np.zeros(BUCKETS, np.float32) if f is None else vector(f, self.idf) for f in found])
        near = x @ self.centroids.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(best)), best], 0, 1).astype(np.float64)
        names, far = [], []
        for f, b, s in zip(found, best, score, strict=True):
            k = self.of[b]
            names.append(UNKNOWN if f is None else self.languages[k])
            far.append(f is None or bool(s < self.least[k, _size_class(_size(f))] * np.sqrt(_size(f))))
        return names, np.where([f is None for f in found], 0.0, score), far


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the rows farthest from those chosen before; at most k unit centroids."""
    chosen = [int((x @ x.sum(0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centers = x[chosen]
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else centers[j] for j in range(len(centers))])
        centers = (sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-9)).astype(np.float32)
    return centers


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of the texts with a letter, and how many of them each bucket occurs in: over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                if has_letter(x):
                    df[:-1] += counts(x) > 0
                    n += 1
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1, dtype=np.int32)), pa.array(df)], ["bucket", "df"])

    got = np.zeros(BUCKETS + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        got[r.bucket] = r.df
    return int(got[-1]), got[:-1]


def fit(docs: DataFrame, most: int = MOST_TEXTS, centroids: int = CENTROIDS) -> Model:
    """A model of docs (text, lang): rows with a null in either are left out.

    Document frequencies are those of all rows. The centroids of a language come from about so many of its different
    texts: those with a hash below a bound, set by a sketch of how many there are. Each language is clustered by a task of its own, and the driver gets its centroids and thresholds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    n, df = document_frequencies(known)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 0.05, 0.0)
    hashed = known.withColumn("h", F.xxhash64("text"))
    shares = hashed.groupBy("lang").agg((F.lit(float(most)) / F.approx_count_distinct("h")).alias("share")).limit(MOST_LANGUAGES + 1).collect()
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would not fit a task")
    share = spark.createDataFrame(shares, "lang string, share double")
    some = hashed.join(F.broadcast(share), "lang").where(F.shiftrightunsigned("h", 1) < F.col("share") * float(1 << 63))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, counts(x)) for k, x in enumerate(b.column(2).to_pylist()) if has_letter(x)]
            rows = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array([zstandard.compress(f.astype("<i4").tobytes(), 1) for _, f in found], pa.binary())], ["lang", "h", "counts"])

    # counts of a fixed size, not texts of any, are what one task clusters
    vectors = some.select("lang", "h", "text").mapInArrow(counted, "lang string, h long, counts binary").dropDuplicates(["lang", "h"])
    schema = "lang string, centers array<binary>, least array<double>"

    def grouped(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(zstandard.decompress(x), "<i4") for x in rows.sort_values("h")["counts"]]
        x = np.stack([vector(f, idf) for f in found])
        centers, size = cluster(x, centroids), np.array([_size(f) for f in found])
        # each half is judged by centroids of the other, as texts are nearer to their own
        halves = [(x[k::2], x[1 - k :: 2], size[k::2]) for k in range(2)] if len(x) > 1 else []
        cosine = [(one @ cluster(other, centroids).T).max(1) for one, other, _ in halves]
        least = thresholds(np.concatenate([np.zeros(0), *cosine]), np.concatenate([np.zeros(0), *[n for _, _, n in halves]]))
        return pd.DataFrame({"lang": [key[0]], "centers": [[c.astype("<f4").tobytes() for c in centers]], "least": [least.tolist()]})

    got = sorted(vectors.groupBy("lang").applyInPandas(grouped, schema).collect(), key=lambda r: r.lang)
    centers = [np.frombuffer(c, "<f4") for r in got for c in r.centers]
    of = [k for k, r in enumerate(got) for _ in r.centers]
    return Model([r.lang for r in got], idf, np.array(centers, np.float32).reshape(-1, BUCKETS), np.array(of, np.int64), np.array([r.least for r in got]).reshape(-1, SIZES))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred (und: a null text, or one without a letter), score (0 to 1) and rejected (too far from every centroid).

    The prediction sees the text alone. Rows stand alone: repeated rows and extra columns stay. The model, of a size
    set by its languages and buckets, goes to the tasks with the function.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at = kept.index("text")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, far = held.value.predict(b.column(at).to_pylist()) if b.num_rows else ([], np.zeros(0), [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], [*kept, *[f.name for f in added]])

    return docs.select(*kept).mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + added))


def known_part(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.where(remainder(F.col("doc_id"), 4) != 2).select("text", "lang")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(known_part(docs)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
