"""Clustering around centroids: exact dot products are kept for each vector, and changed by what a centroid changed."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octarine.llm.common import checkpoint_dir, fresh, small_batches, table

SIZE, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Components from -BOUND to BOUND: then dot products and squared distances of up to 64 of them fit a long.
BOUND = 1 << 27
RESULTS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def whole_vectors(vectors: DataFrame, name: str, size: int = SIZE, scale: int = SCALE, embedding: str = "embedding") -> DataFrame:
    """Rows whose embedding has just size components, none null or non-finite, with name: floor(scale * x) of each as a long. A component over BOUND is an error."""
    some = F.coalesce((F.size(embedding) == size) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(embedding, lambda x: F.when(F.abs(x.cast("double") * scale) > BOUND, F.raise_error(F.lit(f"a component is over {BOUND} / {scale}")).cast("bigint")).otherwise(F.floor(x.cast("double") * scale)))
    return vectors.where(some).withColumn(name, whole)


def first_centroids(kept: DataFrame, q: str, k: int = K, size: int = SIZE, id: str = "vec_id") -> np.ndarray:
    """The k vectors of least sha256 of '1:<id>' in their order; a null id comes last, equal ids by their components. Without vectors: one of zeros."""
    key = F.sha2(F.concat(F.lit("1:"), F.col(id).cast("string")), 256)
    rows = kept.select(key.alias("key"), F.col(q).alias("q")).orderBy(F.asc_nulls_last("key"), "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64) if rows else np.zeros((1, size), np.int64)


def nearest(products: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's centroid of least squared distance, the first of equal ones, and that distance."""
    all_ = norms[:, None] - 2 * products + (centroids * centroids).sum(1)
    best = all_.argmin(1)
    return best, all_[np.arange(len(best)), best]


def changed(products: np.ndarray, q: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The products with the new centroids: each column changes by the vectors' products with the components that its centroid changed."""
    products = products.copy()
    for k, step in enumerate(new - old):
        at = np.flatnonzero(step)
        if len(at):
            products[:, k] += q[:, at] @ step[at]
    return products


def _assigned(state: DataFrame, names: list[str], size: int, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """The rows with their products brought from the old centroids to the new ones (or made, if there are none), and the nearest of these."""
    q, norm, dots, cluster, distance = names
    kept = [c for c in state.columns if c not in names]
    held = [*kept, q] if old is None else [*kept, q, norm, dots]
    schema = T.StructType([*[state.schema[c] for c in kept], T.StructField(q, T.ArrayType(T.LongType())), T.StructField(norm, T.LongType()), T.StructField(dots, T.ArrayType(T.LongType())), T.StructField(cluster, T.IntegerType()), T.StructField(distance, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(len(kept)).flatten()
            own = flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
            if old is None:
                norms, products = (own * own).sum(1), own @ new.T
            else:
                norms = b.column(len(kept) + 1).to_numpy(zero_copy_only=False)
                products = changed(b.column(len(kept) + 2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(old)), own, old, new)
            best, far = nearest(products, norms, new)
            wide = pa.ListArray.from_arrays(pa.array(np.arange(0, products.size + 1, len(new)), pa.int32()), pa.array(products.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], b.column(len(kept)), pa.array(norms, pa.int64()), wide, pa.array(best, pa.int32()), pa.array(far, pa.int64())], schema.names)

    return state.select(*held).mapInArrow(run, schema)


def _means(state: DataFrame, q: str, cluster: str, old: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means, component by component; a cluster without vectors keeps its centroid. One row a centroid reaches the driver."""
    sums = [F.sum(F.get(q, F.lit(j))).alias(f"s{j}") for j in range(old.shape[1])]
    new = old.copy()
    for r in state.groupBy(F.col(cluster).alias("k")).agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[r["k"]] = [r[f"s{j}"] // r["n"] for j in range(old.shape[1])]
    return new


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vectors without the embedding, with cluster, distance (squared), cluster_inertia, inertia (its sums over the cluster and over all) and centroid_sha256.

    Vectors are whole numbers (see whole_vectors: rows that are null, of another size, or hold a null or a number that is not finite go), and so is all
    that follows. The matrix of products is made once, one row beside each vector; a round changes it by the components that a centroid changed, takes the nearest of each
    vector and replaces the centroids by the floors of the means; after the last round the nearest are taken once more. Ties go to the smaller number.
    Repeated rows are vectors of their own, with fewer than k vectors there are as many centroids, no vectors give no rows, and columns with the results' names are replaced.

    A round is one pass that reads the state before and writes its own to the shared checkpoint folder, in place of the one before that: two are there at a time. Only centroids
    and their sums reach the driver. No vector moves between tasks, so no cluster is too large for one.
    """
    spark = vectors.sparkSession
    names = fresh(vectors, 5)
    q, norm, dots, at, distance = names
    kept = whole_vectors(vectors, q, size, scale, embedding).drop(*[c for c in vectors.columns if c in RESULTS and c != id], embedding)
    old, new = None, first_centroids(kept, q, k, size, id)
    folder = f"{checkpoint_dir(spark)}/centroids-{uuid.uuid4().hex}"
    small_batches(spark, 8192)
    state = kept
    for r in range(rounds + 1):
        done = _assigned(state, names, size, old, new)
        path = f"{folder}/{r % 2}"
        done.write.mode("overwrite").parquet(path)
        state = spark.read.schema(done.schema).parquet(path)
        if r < rounds:
            old, new = new, _means(state, q, at, new)
    sums = {r["k"]: r["d"] for r in state.groupBy(F.col(at).alias("k")).agg(F.sum(distance).alias("d")).collect()}
    rows = [(c, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, new[c].tolist())).encode()).hexdigest()) for c in sorted(sums)]
    told = spark.createDataFrame(rows, f"`{names[0]}k` int, cluster_inertia long, inertia long, centroid_sha256 string")
    own = [c for c in kept.columns if c != q]
    met = state.join(F.broadcast(told), F.col(at) == F.col(f"{names[0]}k"))  # k rows
    return met.select(*own, F.col(at).alias("cluster"), F.col(distance).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding of 64 finite components in its cluster of 16, after three rounds; others have no row."""
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql(rounds: int = ROUNDS) -> str:
    parts = [
        f"v as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) q from embeddings where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {SIZE})",
        f"c0 as materialized (select row_number() over (order by sha256('1:' || vec_id) nulls last, q) - 1 k, q c from v qualify k < {K})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select rid, arg_min(k, (d, k)) k, min(d) d from (select rid, k, list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c) d from v, c{r}) group by rid)")
        if r < rounds:
            parts.append(f"m{r} as (select k, list(m order by j) c from (select k, j, floor(sum(q[j]) / count(*)) m from a{r} join v using (rid), range(1, {SIZE + 1}) t(j) group by k, j) group by k)")
            parts.append(f"c{r + 1} as materialized (select k, coalesce(m{r}.c, c{r}.c) c from c{r} left join m{r} using (k))")
    return f"with {', '.join(parts)} select vec_id, k::int cluster, d::bigint distance, sum(d) over (partition by k)::bigint cluster_inertia, sum(d) over ()::bigint inertia, sha256(array_to_string(list_transform(c, lambda x: x::bigint), ',')) centroid_sha256 from a{rounds} join v using (rid) join c{rounds} using (k)"


OP11_SQL = _sql()
