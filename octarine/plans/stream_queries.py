"""Queries over streams that many tasks write and read, closed-loop trees and models over all layers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octarine.functions.lineage import checkpoint_folder, cut, placed
from octarine.operators import bitstream, closedtree, coding, entropy, ntree, quantize, rangestream
from octarine.plans import views as V
from octarine.sources import pointfiles, sink

QUERIES: dict = {}
SQL: dict = {}
#: Bytes of a chunk and symbols of a piece here: small, so that small tables have several.
CHUNK, PIECE, RADIUS = 4096, 5000, 0.05


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """All frames' codes as one frame's."""
    return cut(quantize.encode(V.line_points(spark, d), V.BITS, order="morton").select(F.lit(0).alias("frame"), "code").distinct())


_ONE = f"{V.MCODES}, one as (select distinct 0::int frame, code from m)"
_HALVES = f"with {_ONE}, h as (select frame, l layer, code >> cast(24 - l as int) parent, count(*) n, sum((code >> cast(23 - l as int)) & 1)::bigint minor from one, range(24) r(l) group by all), w as (select *, length(bin(n)) width from h)"
_TREE = f"with {_ONE}, s as (select frame, l layer, code >> cast(24 - 3 * l as int) parent, cast(bit_or(1::bigint << ((code >> cast(21 - 3 * l as int)) & 7)::int) as bigint) flag from one, range(8) r(l) group by all)"


@query(f"{_HALVES}, b as (select frame, string_agg(right(repeat('0', width::int) || bin(minor), width::int), '' order by layer, parent) bits from w group by frame), k as (select frame, unnest(range(0, (length(bits) + {8 * CHUNK} - 1) // {8 * CHUNK})) chunk, bits from b), c as (select frame, chunk, substring(bits, (chunk * {8 * CHUNK} + 1)::int, {8 * CHUNK}) bits from k) select frame, chunk::bigint chunk, ((length(bits) + 7) // 8)::bigint bytes, sha256(unbin(rpad(bits, ((length(bits) + 7) // 8 * 8)::int, '0'))) digest from c")
def stream_chunks(spark, d):
    """The whole table as one frame, its counts in words of their own widths: the bytes of every chunk."""
    symbols = ntree.counter_symbols(ntree.halves(_codes(spark, d), V.WIDTH)).withColumnRenamed("symbol", "flag")
    stream, _ = bitstream.write(symbols, chunk=CHUNK, piece=PIECE)
    return stream.select("frame", "chunk", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query(f"{_HALVES}, l as (select frame, layer, count(*) n, sum(width) bits from w group by all) select frame, layer::int layer, n, bits::bigint bits, coalesce(sum(bits) over (partition by frame order by layer rows between unbounded preceding and 1 preceding), 0)::bigint start from l")
def stream_layers(spark, d):
    """Where the layers of such a stream begin."""
    symbols = ntree.counter_symbols(ntree.halves(_codes(spark, d), V.WIDTH)).withColumnRenamed("symbol", "flag")
    return bitstream.write(symbols, chunk=CHUNK, piece=PIECE)[1]


@query(f"{_TREE} select frame, layer::int layer, parent, flag from s")
def stream_tree(spark, d):
    """Occupancy flags of the whole table as one frame, through a stream and back."""
    stream, _ = bitstream.write(ntree.symbols(_codes(spark, d), [3], V.WIDTH).withColumn("width", F.lit(8)), chunk=CHUNK, piece=PIECE)
    return bitstream.read_tree(cut(stream), [3], V.WIDTH, chunk=CHUNK)


# ---- models over all layers


@query(f"{_TREE} select frame, layer::int layer, parent, flag from s")
def layered_range_round_trip(spark, d):
    """All layers' flags in one stream of interleaved coders, by each layer's own frequencies, and back."""
    tree = cut(ntree.symbols(_codes(spark, d), [3], V.WIDTH).select("frame", "layer", "parent", "flag"))
    models = cut(rangestream.tables(tree))
    coded = rangestream.write(tree.join(models, ["frame", "layer", "flag"]), chunk=PIECE)
    read = rangestream.read(coded, models, tree.groupBy("frame", "layer").agg(F.count(F.lit(1)).alias("n")), chunk=PIECE)
    places = placed(tree.select("frame", "layer", "parent"), ["layer", "parent"])
    return places.join(read.drop("layer"), ["frame", "k"]).select("frame", "layer", "parent", "flag")


@query(f"{_TREE}, c as (select frame, layer, flag, count(*) n from s group by all), g as (select *, sum(n) over (partition by frame, layer) total from c) select frame, sum(n)::bigint n, round(sum(-n * log2(n / total)), 3) least_bits, true within_a_hundredth from g group by frame")
def layered_range_sizes(spark, d):
    """The entropy by layer, and whether the stream is within one percent of it and its states."""
    tree = cut(ntree.symbols(_codes(spark, d), [3], V.WIDTH).select("frame", "layer", "parent", "flag"))
    least = entropy.entropy(tree, ["frame", "layer"]).groupBy("frame").agg(F.sum("n").alias("n"), F.sum("bits").alias("least"))
    coded = rangestream.write(tree.join(rangestream.tables(tree), ["frame", "layer", "flag"]), chunk=rangestream.CHUNK)
    size = coded.groupBy("frame").agg(F.sum("bits").alias("bits"), F.count(F.lit(1)).alias("chunks"))
    fits = (F.col("bits") >= F.col("least")) & (F.col("bits") <= 1.01 * F.col("least") + 192 * F.col("chunks"))
    return least.join(size, "frame").select("frame", "n", F.round("least", 3).alias("least_bits"), fits.alias("within_a_hundredth"))


_RANGES = "c as (select frame, layer, flag, count(*) n from s group by all), g as (select *, sum(n) over w total, count(*) over w kinds, row_number() over (partition by frame, layer order by n desc, flag) k from c window w as (partition by frame, layer)), z as (select *, floor(n * (65536 - kinds) / total)::int + 1 size0 from g), y as (select *, size0 + case when k = 1 then 65536 - sum(size0) over (partition by frame, layer) else 0 end size from z)"


@query(f"{_TREE}, {_RANGES} select frame, layer::int layer, flag, coalesce(sum(size) over (partition by frame, layer order by flag rows between unbounded preceding and 1 preceding), 0)::int low, size::int size from y")
def layered_range_tables(spark, d):
    return rangestream.tables(ntree.symbols(_codes(spark, d), [3], V.WIDTH))


@query(f"{_TREE} select frame, layer::int layer, parent, flag from s")
def model_range_round_trip(spark, d):
    """Flags by weights at each place, which a model gives from what the decoder knows (the layer and the parent), over all layers, and back."""
    tree = cut(ntree.symbols(_codes(spark, d), [3], V.WIDTH).select("frame", "layer", "parent", "flag"))
    near = lambda k: (1.0 + F.pmod(F.col("parent") * 31 + F.col("layer") * 7 + k * k, F.lit(13))) / (1.0 + F.bit_count(k))
    models = tree.select("frame", "layer", "parent", F.transform(F.sequence(F.lit(1), F.lit(255)), near).alias("weights"))
    coded = rangestream.write_by(tree.join(models, ["frame", "layer", "parent"]), chunk=PIECE)
    return rangestream.read_by(coded, models, chunk=PIECE)


# ---- trees split near their means


def _closed_sql(layers: int, radius: float = RADIUS) -> str:
    """CTEs of all layers: p<k> points, t<k> nodes with their boxes and cuts, o all nodes, f their flags."""
    axes = "xyz"
    split = lambda j: f"((split >> {j}) & 1 = 1)"
    parts = [V.EP, "p0 as materialized (select frame, 1::bigint node, x, y, z from ep where isfinite(x) and isfinite(y) and isfinite(z))"]
    for k in range(layers):
        parts.append(f"s{k} as materialized (select frame, node, count(*) n, " + ", ".join(f"min({a}) l{a}, max({a}) m{a}, avg({a}) v{a}" for a in axes) + f" from p{k} group by all)")
        if k == 0:
            parts.append("b0 as (select *, " + ", ".join(f"l{a} lo_{a}, m{a} hi_{a}" for a in axes) + " from s0)")
        else:
            low = ", ".join(f"case when {split(j)} and (s.node >> {j}) & 1 = 1 then t.pos_{a} else t.lo_{a} end lo_{a}, case when {split(j)} and (s.node >> {j}) & 1 = 0 then t.pos_{a} else t.hi_{a} end hi_{a}" for j, a in enumerate(axes))
            parts.append(f"b{k} as (select s.*, {low} from s{k} s join t{k - 1} t on s.frame = t.frame and s.node >> 3 = t.node)")
        parts.append(f"g{k} as (select *, " + ", ".join(f"(lo_{a} + hi_{a}) / 2 mid_{a}, (hi_{a} - lo_{a}) / 8 unit_{a}" for a in axes) + ", " + " + ".join(f"(case when (hi_{a} - lo_{a}) / 2 > {radius} then {1 << j}::bigint else 0 end)" for j, a in enumerate(axes)) + f" split from b{k})")
        parts.append(f"q{k} as (select *, " + ", ".join(f"(case when {split(j)} then least(2, greatest(-2, floor((v{a} - mid_{a}) / unit_{a} + 0.5))) else 0 end)::int q_{a}" for j, a in enumerate(axes)) + f" from g{k})")
        parts.append(f"r{k} as (select *, " + ", ".join(f"mid_{a} + q_{a} * unit_{a} pos_{a}" for a in axes) + f" from q{k})")
        parts.append(f"t{k} as materialized (select *, {k} layer, bit_count(split)::int dims, " + " or ".join(f"({split(j)} and greatest(m{a} - pos_{a}, pos_{a} - l{a}) > {radius})" for j, a in enumerate(axes)) + f" far from r{k})")
        child = " + ".join(f"({split(j)} and p.{a} >= t.pos_{a})::int * {1 << j}" for j, a in enumerate(axes))
        parts.append(f"p{k + 1} as materialized (select p.frame, (p.node << 3) + {child} node, p.x, p.y, p.z from p{k} p join t{k} t on p.frame = t.frame and p.node = t.node where far)")
    columns = "frame, layer, node, n, split, dims, " + ", ".join(f"q_{a}, pos_{a}" for a in axes)
    parts.append("a as materialized (" + " union all ".join(f"select {columns} from t{k}" for k in range(layers)) + ")")
    parts.append("f as (select frame, layer - 1 layer, node >> 3 node, bit_or(1::bigint << (node & 7)::int)::bigint flag from a where layer > 0 group by all)")
    parts.append("o as materialized (select a.*, coalesce(f.flag, 0) flag from a left join f using (frame, layer, node))")
    return "with " + ", ".join(parts)


_CLOSED = _closed_sql(20)


@query(f"{_CLOSED} select frame, layer::int layer, node, split, dims, flag, n, q_x, q_y, q_z, round(pos_x, 9) pos_x, round(pos_y, 9) pos_y, round(pos_z, 9) pos_z from o")
def closed_mean_tree(spark, d):
    """Trees cut near the means of their nodes, at steps that are written."""
    got = closedtree.encode(V.vectors(spark, d), RADIUS)[1]
    return got.select("frame", "layer", "node", "split", "dims", "flag", "n", "q_x", "q_y", "q_z", *[F.round(f"pos_{a}", 9).alias(f"pos_{a}") for a in "xyz"])


def _closed(spark, d):
    points = V.vectors(spark, d)
    roots, symbols = closedtree.encode(points, RADIUS)
    symbols = cut(symbols)
    stream, layers = closedtree.write(symbols, chunk=512)
    return points, symbols, closedtree.decode(cut(stream), roots, RADIUS, chunk=512), layers


@query(f"{_CLOSED} select frame, node, round(pos_x, 9) x, round(pos_y, 9) y, round(pos_z, 9) z from o where flag = 0")
def closed_mean_decode(spark, d):
    """The leaves of such trees, from their bit streams."""
    return _closed(spark, d)[2].select("frame", "node", *[F.round(a, 9).alias(a) for a in "xyz"])


@query(f"{_CLOSED}, e as (select frame, count(*) leaves, sum(n)::bigint points from o where flag = 0 group by 1), b as (select frame, sum(case when dims > 0 then 3 * dims + (1 << dims) else 0 end)::bigint bits from o group by 1) select frame, points, leaves, bits, true within_radius from e join b using (frame)")
def closed_mean_error(spark, d):
    """Points, decoded leaves and bits of each frame, and whether every point is within the radius of its leaf on each axis."""
    points, symbols, found, layers = _closed(spark, d)
    got = closedtree.errors(points, found, symbols).join(bitstream.sizes(layers).select("frame", "bits"), "frame")
    return got.select("frame", "points", "leaves", "bits", (F.col("worst") <= RADIUS + 1e-12).alias("within_radius"))


_GUESS = "c as (select *, (split << 3) + (node & 7) context from o where dims > 0), k as (select frame, context, layer, flag, count(*) m, sum(q_x) sx, sum(q_y) sy, sum(q_z) sz from c group by all), g as (select t.frame, t.context, t.layer, k.flag, sum(k.m) m, sum(sx) sx, sum(sy) sy, sum(sz) sz from (select distinct frame, context, layer from k) t join k on k.frame = t.frame and k.context = t.context and k.layer < t.layer group by all), b as (select frame, context, layer, sum(m) seen, arg_max(flag, (m, -flag)) guess, floor(sum(sx) / sum(m) + 0.5) gx, floor(sum(sy) / sum(m) + 0.5) gy, floor(sum(sz) / sum(m) + 0.5) gz from g group by all)"
_EVERY = "(select sum(1::bigint << j::int) from range(8) r(j) where (j & ~c.split) = 0)"


@query(f"{_CLOSED}, {_GUESS} select c.frame, c.layer::int layer, c.node, c.context, coalesce(b.seen, 0)::bigint seen, coalesce(b.guess, {_EVERY})::bigint flag_guess, c.flag = coalesce(b.guess, {_EVERY}) hit, (c.q_x - coalesce(gx, 0))::int rest_x, (c.q_y - coalesce(gy, 0))::int rest_y, (c.q_z - coalesce(gz, 0))::int rest_z, round(-log2((coalesce(g.m, 0) + 1) / (coalesce(b.seen, 0) + pow(2.0, pow(2.0, c.dims)))), 6) cost from c left join b on b.frame = c.frame and b.context = c.context and b.layer = c.layer left join g on g.frame = c.frame and g.context = c.context and g.layer = c.layer and g.flag = c.flag")
def foretold_symbols(spark, d):
    """What tables of the layers above foretell of a node's flag and cut, and what is left."""
    got = closedtree.predicted(cut(closedtree.encode(V.vectors(spark, d), RADIUS)[1]))
    return got.select("frame", "layer", "node", "context", "seen", "flag_guess", "hit", "rest_x", "rest_y", "rest_z", F.round("cost", 6).alias("cost"))


# ---- codes through chunked streams, points through files


def _chunk_round_trip(spark: SparkSession, d: str, dims: list[int]) -> DataFrame:
    codes = _codes(spark, d)
    flags, tails, _ = coding.write_streams(*coding.symbols(codes, dims, V.WIDTH, True), chunk=CHUNK)
    frames = codes.groupBy("frame").agg(F.count(F.lit(1)).alias("out_points"))
    return coding.read_streams(cut(flags), cut(tails), frames, dims, V.WIDTH, True, chunk=CHUNK)


@query(f"with {_ONE} select frame, code from one")
def occupancy_chunk_round_trip(spark, d):
    """The whole table's codes as one frame: occupancy flags and tails through chunked streams and back."""
    return _chunk_round_trip(spark, d, [3])


@query(f"with {_ONE} select frame, code from one")
def mixed_chunk_round_trip(spark, d):
    """The same by a layer of counts, one of counts with an overflow, and flags of six dimensions."""
    return _chunk_round_trip(spark, d, [0, -1, 6])


@query(f"{_HALVES} select frame, count(*) n, sum(width)::bigint flag_bits, 0::bigint payload_bits from w group by frame")
def chunk_stream_sizes(spark, d):
    """What counts of all layers take in chunked streams."""
    return coding.write_streams(*coding.symbols(_codes(spark, d), [0], V.WIDTH), chunk=CHUNK)[2]


@query(f"with {V.EP} select frame::varchar frame, row_number() over (partition by frame order by point_id) - 1 point_id, x, y, z from ep")
def file_round_trip(spark, d):
    """Points written as PLY files, a file for each frame, and read again."""
    folder = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    sink.write(V.vectors(spark, d), folder, "ply")
    name = F.regexp_replace(F.element_at(F.split("frame", "/"), -1), "[.]ply$", "")
    return pointfiles.read(spark, folder, keep=3).select(name.alias("frame"), "point_id", *"xyz")
