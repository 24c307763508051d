"""Queries over codes, trees and their symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octarine.functions import bits as B
from octarine.functions.lineage import cut, numbered, spread
from octarine.operators import coding, dyntree, entropy, ntree, quantize, reports
from octarine.plans import views as V

QUERIES: dict = {}
SQL: dict = {}
WIDE = V.WIDTH


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _codes(spark: SparkSession, d: str, order: str = "packed") -> DataFrame:
    return quantize.encode(V.line_points(spark, d), V.BITS, order=order).select("frame", "code").distinct()


def _cut_codes(spark: SparkSession, d: str, order: str = "packed") -> DataFrame:
    """The codes written once, for queries that read them several times."""
    return cut(_codes(spark, d, order))


def _tree(spark: SparkSession, d: str, dims=(3,)) -> DataFrame:
    return ntree.symbols(_codes(spark, d, "morton"), dims, WIDE)


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """Bit counts of the packed codes by frame."""
    return quantize.bit_counts(_codes(spark, d), WIDE, ["frame"])


_BITS = f"with {V.CODES}, o as (select frame, k bit, cast(sum((code >> cast(k as int)) & 1) as bigint) ones, count(*) n from c, range(24) r(k) group by all)"
_TREE = f"with {V.MCODES}, {V.TOKENS}, s as (select frame, layer, parent, cast(bit_or(1::bigint << child::int) as bigint) flag, count(distinct child) children, count(*) n from t group by all)"
_HALVES = f"with {V.MCODES}, {V.BINARY}, h as (select frame, layer, parent, count(*) n, cast(sum(child) as bigint) minor from b group by all)"
_BITLEN = "length(bin(n))"


@query(f"with {V.LP} select frame, count(*) n, " + ", ".join(f"-min({a}) offset_{a}, case when max(abs({a})) = 0 then 1.0 else max(abs({a})) end scale_{a}" for a in "xyz") + " from lp group by frame")
def quantize_stats(spark, d):
    return quantize.frame_stats(V.line_points(spark, d))


@query(f"with {V.CODES} select frame, code from c")
def serialize_codes(spark, d):
    return _codes(spark, d)


@query(f"with {V.CODES} select frame, code, code & 255 qx, (code >> 8) & 255 qy, (code >> 16) & 255 qz from c")
def deserialize_codes(spark, d):
    return quantize.decode(_codes(spark, d), V.BITS)


_REAL = ", ".join(f"(q{a} * (s{a} / 127.5) - o{a} + (s{a} / 127.5) / 2) - {a} e{a}, s{a} / 127.5 c{a}" for a in "xyz")


@query(f"with {V.LP}, {V.STATS}, w as (select frame, lp.x, lp.y, lp.z, " + ", ".join(f"cast(trunc(({a} + o{a}) * (127.5 / s{a})) as bigint) q{a}, o{a}, s{a}" for a in "xyz") + f" from lp join st on frame = f), r as (select frame, {_REAL} from w) select frame, " + ", ".join(f"round(max(abs(e{a})), 6) err_{a}, bool_and(abs(e{a}) <= c{a} / 2 + 1e-9) ok_{a}" for a in "xyz") + " from r group by frame")
def realize_error(spark, d):
    q = quantize.realize(quantize.quantize(V.line_points(spark, d), V.BITS), V.BITS)
    err = lambda a: F.abs(F.col(f"r{a}") - F.col(a))
    return q.groupBy("frame").agg(*[x for a in "xyz" for x in (F.round(F.max(err(a)), 6).alias(f"err_{a}"), F.bool_and(err(a) <= F.col(f"scale_{a}") / 127.5 / 2 + 1e-9).alias(f"ok_{a}"))])


@query(f"with {V.EP}, w as (select frame, " + ", ".join(f"min({a}) l{a}, max({a}) h{a}" for a in "xyz") + " from ep group by frame) select point_id, " + ", ".join(f"round(({a} - l{a}) / nullif(h{a} - l{a}, 0), 9) n{a}" for a in "xyz") + " from ep join w using (frame)")
def min_max_normalize(spark, d):
    return quantize.min_max(V.vectors(spark, d), "xyz").select("point_id", *[F.round(f"n{a}", 9).alias(f"n{a}") for a in "xyz"])


@query(f"{_BITS} select frame, cast(bit as int) bit, ones, n from o")
def bit_popularity(spark, d):
    return _ordered(spark, d)


@query(f"{_BITS}, r as (select frame, bit, row_number() over (partition by frame order by ones, bit) - 1 k, case when 2 * ones > n then 1::bigint << bit::int else 0 end w from o), g as (select frame, list(bit order by k) p, cast(sum(w) as bigint) pattern from r group by frame) select frame, array_to_string(p, ',') p, pattern from g")
def bit_sort(spark, d):
    return quantize.bit_order(_ordered(spark, d), ["frame"]).select("frame", F.array_join(F.col("p").cast("array<string>"), ",").alias("p"), "pattern")


@query(f"{_BITS}, r as (select frame, bit, row_number() over (partition by frame order by greatest(ones, n - ones) desc, bit) - 1 k from o) select frame, array_to_string(list(bit order by k), ',') p from r group by frame")
def bit_sort_absolute(spark, d):
    got = quantize.bit_order(_ordered(spark, d), ["frame"], absolute=True, reverse=True)
    return got.select("frame", F.array_join(F.col("p").cast("array<string>"), ",").alias("p"))


@query(f"{_BITS}, r as (select frame, bit, row_number() over (partition by frame order by ones, bit) - 1 k from o) select c.frame, c.code, cast(sum(((c.code >> bit::int) & 1) << k::int) as bigint) sorted_code, true round_trip from c join r on r.frame = c.frame group by all")
def bit_sorted_codes(spark, d):
    codes, order = _codes(spark, d), quantize.bit_order(_ordered(spark, d), ["frame"]).select("frame", "p")
    met = spread(codes, order, "frame")
    new = B.total([F.shiftleft(F.call_function("shiftrightunsigned", F.col("code"), F.get("p", F.lit(j)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")), j) for j in range(WIDE)])
    out = met.withColumn("sorted_code", new)
    return out.select("frame", "code", "sorted_code", (B.permute_by(F.col("sorted_code"), F.col("p"), WIDE) == F.col("code")).alias("round_trip"))


@query(f"{_BITS} select frame, cast(sum(case when 2 * ones > n then 1::bigint << bit::int else 0 end) as bigint) pattern from o group by frame")
def majority_pattern(spark, d):
    return quantize.bit_order(_ordered(spark, d), ["frame"]).select("frame", "pattern")


@query(f"{_BITS} select frame, cast(arg_max(bit, (greatest(ones, n - ones), -bit)) as int) bit, max(greatest(ones, n - ones)) skew from o group by frame")
def most_skewed_bit(spark, d):
    w = F.greatest(F.col("ones"), F.col("n") - F.col("ones"))
    return _ordered(spark, d).groupBy("frame").agg(F.max_by("bit", F.struct(w.alias("w"), (-F.col("bit")).alias("b"))).alias("bit"), F.max(w).alias("skew"))


@query(f"with {V.CODES} select frame, code, cast((select sum(((code >> i::int) & 1) << (23 - i)::int) from range(24) r(i)) as bigint) rev, true involution from c")
def bit_reverse(spark, d):
    got = _codes(spark, d).withColumn("rev", B.reverse(F.col("code"), WIDE))
    return got.withColumn("involution", B.reverse(F.col("rev"), WIDE) == F.col("code"))


@query(f"with {V.CODES} select frame, code, cast((select sum(((code >> i::int) & 1) << (3 * (i % 8) + i // 8)::int) from range(24) r(i)) as bigint) morton from c")
def bit_permute(spark, d):
    return _codes(spark, d).withColumn("morton", B.permute(F.col("code"), B.morton(V.BITS)))


@query(f"with {V.CODES} select frame, code, code & 4095 a, code | 1 o, xor(code, code >> 1) gray, bit_count(code)::bigint ones, ~code inv from c")
def bit_algebra(spark, d):
    c = F.col("code")
    return _codes(spark, d).select("frame", "code", c.bitwiseAND(4095).alias("a"), c.bitwiseOR(1).alias("o"), c.bitwiseXOR(F.shiftright(c, 1)).alias("gray"), F.bit_count(c).cast("bigint").alias("ones"), F.bitwise_not(c).alias("inv"))


@query(f"with {V.CODES}, k as (select frame, code, row_number() over (partition by frame order by code) - 1 i from c) select frame, i // 48 word, b plane, cast(sum(((code >> (23 - b)::int) & 1) << (47 - i % 48)::int) as bigint) bits from k, range(24) r(b) group by all")
def bit_transpose(spark, d):
    return quantize.bit_planes(_codes(spark, d), WIDE).drop("n")


@query(f"with {V.CODES}, k as (select frame, code, row_number() over (partition by frame order by code) - 1 i from c) select frame, i // 48 word, i % 48 as \"at\", code from k")
def bit_transpose_back(spark, d):
    """Codes from their bit planes."""
    return quantize.from_planes(quantize.bit_planes(_codes(spark, d), WIDE), WIDE)


_FIXED = ", ".join(f"floor(({a} + {o}) * (127.5 / {s}))::bigint q{a}" for a, o, s in (("x", 1.0, 60.0), ("y", 10.0, 120000.0), ("z", 0.5, 1.0)))


@query(f"with {V.LP}, q as (select frame, {_FIXED} from lp), u as (select distinct frame, qx, qy, qz from q) select frame, round(qx * (60.0 / 127.5) - 1.0 + (60.0 / 127.5) / 2, 6) x, round(qy * (120000.0 / 127.5) - 10.0 + (120000.0 / 127.5) / 2, 6) y, round(qz * (1.0 / 127.5) - 0.5 + (1.0 / 127.5) / 2, 6) z from u")
def fixed_scale_round_trip(spark, d):
    """Points through compress() and expand() in a box that is given for all frames, with bits sorted by how skewed they are."""
    from octarine.plans import codec

    cfg = codec.Config(bits=V.BITS, sort_bits=True, sort_absolute=True, sort_reverse=True, offset=(1.0, 10.0, 0.5), scale=(60.0, 120000.0, 1.0))
    back = codec.expand(cut(codec.compress(V.line_points(spark, d), cfg)), cfg)
    return back.select("frame", *[F.round(a, 6).alias(a) for a in "xyz"])


@query(f"{_TREE} select frame, layer::int layer, 3 dim, parent, flag, children, n from s")
def occupancy_tree(spark, d):
    return _tree(spark, d)


@query(f"with {V.MCODES}, {V.TOKENS} select frame, layer::int layer, parent, child, count(*) n from t group by all")
def layer_histogram(spark, d):
    return ntree.histogram(_codes(spark, d, "morton"), [3], WIDE)


def _bpp_sql(dim: int) -> str:
    n = WIDE // dim
    return f"select {dim} dim, frame, count(*) * {1 << dim} bits from (select distinct frame, l, code >> cast({WIDE} - {dim} * l as int) p from m, range({n}) r(l)) group by frame"


@query(f"with {V.MCODES}, s as ({' union all '.join(map(_bpp_sql, (1, 2, 3)))}), p as (select frame, count(*) inp from lp group by frame), u as (select frame, count(*) outp from m group by frame) select s.dim, s.frame, s.bits::bigint bits, inp inp_points, outp out_points, round(bits / inp, 9) bpp_in, round(bits / outp, 9) bpp_out from s join p using (frame) join u using (frame)")
def tree_bpp(spark, d):
    codes = _cut_codes(spark, d, "morton")
    cost = None
    for dim in (1, 2, 3):
        own = ntree.bit_cost(ntree.symbols(codes, [dim], WIDE)).withColumn("dim", F.lit(dim))
        cost = own if cost is None else cost.unionByName(own)
    sizes = V.line_points(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("inp_points")).join(codes.groupBy("frame").agg(F.count(F.lit(1)).alias("out_points")), "frame")
    heads = cost.join(sizes, "frame").withColumns({"flag_bits": F.col("bits"), "payload_bits": F.lit(0), "archive_bits": F.lit(None).cast("bigint")})
    got = reports.bits_per_point(heads)
    return got.select("dim", "frame", "bits", "inp_points", "out_points", F.round("bpp_in", 9).alias("bpp_in"), F.round("bpp_out", 9).alias("bpp_out"))


@query(f"with {V.MCODES}, s as ({' union all '.join(map(_bpp_sql, (1, 2, 3)))}), p as (select frame, count(*) inp from lp group by frame) select dim || ',false' gid, round(avg(bits / inp), 9) \"avg\", round(min(bits / inp), 9) \"min\", round(max(bits / inp), 9) \"max\" from s join p using (frame) group by 1")
def bpp_by_configuration(spark, d):
    got = reports.by_configuration(tree_bpp(spark, d), ["dim", "missing"], "bpp_in")
    return got.select("gid", *[F.round(c, 9).alias(c) for c in ("avg", "min", "max")])


@query(f"with {V.MCODES} select frame, code from m")
def tree_decode(spark, d):
    return ntree.decode(cut(_tree(spark, d)), [3], WIDE)


@query(f"with {V.MCODES}, t as (select frame, l layer, code >> cast(24 - u as int) parent, (code >> cast(24 - u - w as int)) & ((1 << w) - 1) child from m, (values (0, 0, 1), (1, 1, 2), (2, 3, 3), (3, 6, 6), (4, 12, 6), (5, 18, 6)) r(l, u, w)) select frame, layer, parent, cast(bit_or(case when child < 32 then 1::bigint << child::int else 0 end) as bigint) low, cast(bit_or(case when child >= 32 then 1::bigint << (child - 32)::int else 0 end) as bigint) high, count(distinct child) children, count(*) n from t group by all")
def uneven_layers(spark, d):
    got = ntree.symbols(_codes(spark, d, "morton"), [1, 2, 3, 6], WIDE)
    # a flag of 64 bits uses the sign: SQL has its halves
    return got.select("frame", "layer", "parent", F.col("flag").bitwiseAND(F.lit((1 << 32) - 1)).alias("low"), F.call_function("shiftrightunsigned", F.col("flag"), F.lit(32)).alias("high"), "children", "n")


@query(f"{_HALVES} select frame, layer::int layer, parent, n, minor, n - minor major, minor symbol, {_BITLEN} width from h")
def counter_symbols(spark, d):
    return ntree.counter_symbols(ntree.halves(_codes(spark, d, "morton"), WIDE)).withColumn("width", F.col("width").cast("bigint"))


_B = "greatest(length(bin(n)) - 1, 0)"


@query(f"{_HALVES}, w as (select *, n - minor major, {_B} b, (1::bigint << {_B}::int) - 1 cap from h) select frame, layer::int layer, parent, n, minor, major, case when n = 1 or minor < cap then minor when major >= cap and n % 2 = 1 then (cap * (cap + 1) + least(major, cap)) * 2 + (minor > major)::bigint else cap * (cap + 1) + least(major, cap) end symbol, case when n = 1 then 1 when minor < cap then b when major >= cap and n % 2 = 1 then 2 * b + 1 else 2 * b end::bigint width from w")
def overflow_symbols(spark, d):
    return ntree.overflow_symbols(ntree.halves(_codes(spark, d, "morton"), WIDE)).withColumn("width", F.col("width").cast("bigint"))


@query(f"with {V.MCODES}, {V.TOKENS}, s as (select frame, layer, parent, child, min(code) code from t group by all having count(*) = 1), f as (select frame, code, min(layer) layer from s group by all) select frame, code, layer::int layer, (21 - 3 * layer)::bigint tail_bits, code & ((1::bigint << (21 - 3 * layer)::int) - 1) tail from f")
def payload_bits(spark, d):
    return ntree.payload(_codes(spark, d, "morton"), [3], WIDE).withColumn("tail_bits", F.col("tail_bits").cast("bigint"))


@query(f"{_TREE}, d as (select frame, row_number() over (order by frame) frame_no from (select distinct frame from lp)), f as (select frame_no, layer, parent, flag, lag(flag) over w flag0, lag(frame_no) over w frame0 from s join d using (frame) window w as (partition by layer, parent order by frame_no)) select frame_no::bigint frame_no, layer::int layer, parent, flag, xor(flag, case when frame0 = frame_no - 1 then flag0 else 0 end) delta from f")
def differential_tree(spark, d):
    tree = _tree(spark, d)
    frames = V.line_points(spark, d).select("frame").distinct()
    numbers = numbered(frames, ["frame"], "frame_no").withColumn("frame_no", F.col("frame_no") + 1)
    return ntree.differential(tree.join(numbers, "frame").select("frame_no", "layer", "parent", "flag"))


@query(f"{_TREE}, k as (select frame, flag, count(*) n from s group by all), g as (select *, sum(n) over (partition by frame) total from k) select frame, sum(n)::bigint n, round(sum(-n * log2(n / total)), 4) bits, round(sum(-n * log2(n / total)) / sum(n), 6) bits_per_symbol from g group by frame")
def symbol_entropy(spark, d):
    got = entropy.entropy(_tree(spark, d), ["frame"])
    return got.select("frame", "n", F.round("bits", 4).alias("bits"), F.round("bits_per_symbol", 6).alias("bits_per_symbol"))


@query(f"{_TREE}, k as (select frame, layer, flag, count(*) n from s group by all), g as (select *, sum(n) over (partition by frame, layer) total, sum(n) over (partition by frame, layer order by flag) run from k) select frame, layer::int layer, flag, floor((run - n) / total * 65535)::bigint low, floor(run / total * 65535)::bigint high from g")
def symbol_cdf(spark, d):
    return entropy.cdf(_tree(spark, d), ["frame", "layer"])


@query(f"{_TREE} select frame, layer::int layer, parent, flag, 256::bigint alphabet, true fits from s")
def alphabet_narrowing(spark, d):
    return entropy.narrowed(_tree(spark, d)).select("frame", "layer", "parent", "flag", "alphabet", "fits")


@query(f"{_TREE} select frame, count(*) n, (8 * count(*))::bigint bits, count(*)::bigint bytes from s group by frame")
def bit_streams(spark, d):
    written = entropy.streams(_tree(spark, d).withColumn("width", F.lit(8)))
    return written.select("frame", "n", "bits", F.octet_length("stream").cast("bigint").alias("bytes"))


@query(f"{_TREE} select frame, layer::int layer, parent, flag from s")
def bit_stream_decode(spark, d):
    return entropy.read_streams(entropy.streams(_tree(spark, d).withColumn("width", F.lit(8))), [3], WIDE)


@query(f"{_TREE} select frame, layer::int layer, parent, coalesce(sum(8) over (partition by frame order by layer, parent rows between unbounded preceding and 1 preceding), 0)::bigint start from s")
def symbol_positions(spark, d):
    return ntree.running_position(_tree(spark, d)).select("frame", "layer", "parent", "start")


def _permutation_sql(keep: int) -> tuple[str, str]:
    """CTEs of all layers of a tree of chosen bits, and of the choices; keep: the least number of codes in a node that is split."""
    parts = ["p0 as materialized (select frame, code, 1::bigint node, 0::bigint used from c)"]
    for k in range(WIDE):
        parts += [
            f"b{k} as (select frame, node, bit_count(used)::int layer, k::int k, count(*) n, sum((code >> k::int) & 1)::bigint ones from p{k}, range({WIDE}) r(k) where (used >> k::int) & 1 = 0 group by all having count(*) >= {keep})",
            f"c{k} as materialized (select frame, node, layer, arg_max(k, (greatest(ones, n - ones), -k)) choice, any_value(n) n, arg_max(ones, (greatest(ones, n - ones), -k)) ones from b{k} group by all)",
            f"p{k + 1} as materialized (select p.frame, p.code, node * 2 + ((p.code >> z.choice) & 1) node, used | (1::bigint << z.choice) used, z.choice, z.n, z.ones from p{k} p join c{k} z using (frame, node))",
        ]
    return ", ".join(parts), " union all ".join(f"select * from c{k}" for k in range(WIDE))


_CHOSEN, _CHOICES = _permutation_sql(2)
_ALL, _ = _permutation_sql(1)
_SKEWS = " union all ".join(f"select frame, code, choice, 2 * ones - n s from p{k + 1}" for k in range(WIDE))


@query(f"with {V.CODES}, {_CHOSEN} select frame, layer, node, choice, n, ones from ({_CHOICES})")
def permutation_tree(spark, d):
    return ntree.permutation(_cut_codes(spark, d), WIDE)


@query(f"with {V.CODES}, {_ALL}, e as ({_SKEWS}), t as (select frame, count(*) total from c group by 1) select frame, code, string_agg(round((s / total) * 1e6)::bigint::varchar, ',' order by choice) e from e join t using (frame) group by all")
def entropy_map(spark, d):
    """The skews in millionths, by bit."""
    got = entropy.bit_entropy(_cut_codes(spark, d), WIDE, WIDE)
    return got.select("frame", "code", F.array_join(F.transform("e", lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",").alias("e"))


def _radius_sql(radius: float, layers: int) -> str:
    """CTEs of all layers of trees of shared boxes: p<k> the points in their nodes (less the node's middle c), n<k> the nodes, d<k> the leaves."""
    ks = range(3)
    sides = ", ".join(f"struct_pack(s := -(max({a}) - min({a})) / 2 - {radius} / 2, axis := {k}, mid := (min({a}) + max({a})) / 2)" for k, a in enumerate("xyz"))
    own = ", ".join(f"b{k}, a{k}, o{k}, c{k}, p{k}" for k in ks)
    parts = [
        V.EP,
        f"bx as (select frame f, list_sort([{sides}]) s from ep group by frame)",
        "p0 as materialized (select frame, 1::bigint node, " + ", ".join(f"-s[{k + 1}].s b{k}, s[{k + 1}].axis a{k}, s[{k + 1}].mid o{k}, 0.0::double c{k}, [x, y, z][s[{k + 1}].axis + 1] - s[{k + 1}].mid p{k}" for k in ks) + " from ep join bx on frame = f)",
    ]
    for j in range(layers):
        dims = " + ".join(f"(b{k} > {radius})::int" for k in ks)
        child = " + ".join(f"(b{k} > {radius} and p{k} >= 0)::int * {1 << k}" for k in ks)
        parts.append(f"q{j} as materialized (select frame, node, {own}, {dims} dims, {child} child from p{j})")
        parts.append(f"n{j} as materialized (select frame, node, max(dims) dims, bool_or(greatest({', '.join(f'abs(p{k})' for k in ks)}) > {radius}) keep, bit_or(1::bigint << child)::bigint flag, count(*) n from q{j} where dims > 0 group by all)")
        parts.append(f"d{j} as (select distinct q.frame, q.node, {', '.join(f'a{k}, o{k}, c{k}' for k in ks)} from q{j} q left join n{j} n on n.frame = q.frame and n.node = q.node where n.node is null or not n.keep)")
        half = lambda k: f"case when b{k} > {radius} then b{k} / 2 else b{k} end"
        moved = lambda k: f"case when b{k} > {radius} then p{k} + case when p{k} >= 0 then -(b{k} / 2) else b{k} / 2 end else p{k} end"
        middle = lambda k: f"case when b{k} > {radius} then c{k} + case when p{k} >= 0 then b{k} / 2 else -(b{k} / 2) end else c{k} end"
        parts.append(f"p{j + 1} as materialized (select q.frame, (q.node << q.dims) | q.child node, " + ", ".join(f"{half(k)} b{k}, a{k}, o{k}, {middle(k)} c{k}, {moved(k)} p{k}" for k in ks) + f" from q{j} q join n{j} n on n.frame = q.frame and n.node = q.node where n.keep)")
    return "with " + ", ".join(parts)


_RADIUS = _radius_sql(0.05, 10)
_SYMBOLS = " union all ".join(f"select frame, {j} layer, node, dims, case when keep then flag else 0 end::bigint flag, n from n{j}" for j in range(10))
_LEAVES = " union all ".join(f"select * from d{j}" for j in range(10))


@query(f"{_RADIUS} select * from ({_SYMBOLS})")
def radius_tree(spark, d):
    return dyntree.encode(V.vectors(spark, d), 0.05)[1]


@query(f"{_RADIUS} select frame, " + ", ".join("round(" + " + ".join(f"case when a{k} = {j} then c{k} + o{k} else 0.0 end" for k in range(3)) + f", 9) {a}" for j, a in enumerate("xyz")) + f" from ({_LEAVES})")
def radius_tree_decode(spark, d):
    points = V.vectors(spark, d)
    back = dyntree.decode(*dyntree.encode(points, 0.05), 0.05)
    return back.select("frame", *[F.round(a, 9).alias(a) for a in "xyz"])


def _mean_sql(radius: float, layers: int, split: bool = False) -> str:
    axes = list(zip("xyz", ("hx", "hy", "hz"), ("mx", "my", "mz"), strict=True))
    dims = " + ".join(f"({h} > {radius})::int" for _, h, _ in axes)
    child = " + ".join(f"({h} > {radius} and {a} >= {m})::int * {1 << j}" for j, (a, h, m) in enumerate(axes))
    own = "frame, node, n, mx, my, mz, hx, hy, hz"
    parts = [V.EP, "p0 as materialized (select frame, 1::bigint node, x, y, z from ep)"]
    for k in range(layers):
        parts += [
            f"m{k} as materialized (select frame, node, count(*) n, " + ", ".join(f"avg({a}) {m}" for a, _, m in axes) + f" from p{k} group by all)",
            f"s{k} as materialized (select frame, node, " + ", ".join(f"max(abs({a} - {m})) {h}" for a, h, m in axes) + f" from p{k} join m{k} using (frame, node) group by all)",
            f"q{k} as materialized (select {own}, x, y, z, {dims} dims, {child} child from p{k} join m{k} using (frame, node) join s{k} using (frame, node))",
            f"o{k} as (select {own}, dims, {k} layer, cast(bit_or(case when dims > 0 then 1::bigint << child else 0 end) as bigint) flag from q{k} group by {own}, dims)",
            f"p{k + 1} as materialized (select frame, (node << 3) + child node, x, y, z from q{k} where dims > 0)",
        ]
    rows = " union all ".join(f"select * from o{k}" for k in range(layers))
    if split:
        mask = " + ".join(f"({h} > {radius})::bigint * {1 << j}" for j, (_, h, _) in enumerate(axes))
        return f"with {', '.join(parts)} select frame, layer, node, dims, ({mask})::bigint split, flag from ({rows})"
    return f"with {', '.join(parts)} select frame, layer, node, dims, flag, n, " + ", ".join(f"round({m}, 6) mean_{a}, round({h}, 6) box_{a}" for a, h, m in axes) + f" from ({rows})"


@query(_mean_sql(0.05, 20))
def mean_split_tree(spark, d):
    got = dyntree.mean_split(V.vectors(spark, d), 0.05)
    return got.select("frame", "layer", "node", "dims", "flag", "n", *[F.round(f"{p}_{a}", 6).alias(f"{p}_{a}") for p in ("mean", "box") for a in "xyz"])


def _round_trip(spark, d, dims, order="packed", payload=False, sort=False):
    """Codes through bit streams and back."""
    codes = _cut_codes(spark, d, order)
    sizes = codes.groupBy("frame").agg(F.count(F.lit(1)).alias("out_points"))
    back = codes
    if sort:
        bits = cut(quantize.bit_order(quantize.bit_counts(codes, WIDE, ["frame"]), ["frame"]))
        back = coding.sorted_bits(codes, bits, WIDE)
    written = coding.write(*coding.symbols(back, dims, WIDE, payload))
    read = coding.read(written.join(sizes, "frame"), dims, WIDE, payload)
    return coding.unsorted_bits(read, bits, WIDE) if sort else read


@query(f"with {V.MCODES} select frame, code from m")
def occupancy_payload_round_trip(spark, d):
    return _round_trip(spark, d, [3], "morton", payload=True)


@query(f"with {V.CODES} select frame, code from c")
def counter_round_trip(spark, d):
    return _round_trip(spark, d, [0])


@query(f"with {V.CODES} select frame, code from c")
def overflow_payload_round_trip(spark, d):
    return _round_trip(spark, d, [-1], payload=True)


@query(f"with {V.CODES} select frame, code from c")
def mixed_round_trip(spark, d):
    """Counts in the first layers, then flags of growing dimensions; bits sorted by frame."""
    return _round_trip(spark, d, [0, 0, -1, 1, 2, 4], payload=True, sort=True)


@query(f"with {V.CODES} select frame, code from c")
def permutation_round_trip(spark, d):
    codes = _cut_codes(spark, d)
    return coding.decode_permutation(*coding.symbols(codes, [-2], WIDE), WIDE)


@query(f"{_TREE}, d as (select frame, row_number() over (order by frame) frame_no from (select distinct frame from lp)) select frame_no::bigint frame_no, layer::int layer, parent, flag from s join d using (frame)")
def differential_round_trip(spark, d):
    return coding.undo_differences(differential_tree(spark, d).drop("flag")).select("frame_no", "layer", "parent", "flag")


@query(f"{_HALVES}, w as (select frame, sum(length(bin(n)))::bigint flag_bits, count(*) n from h group by 1) select frame, n, flag_bits, ((flag_bits + 7) // 8)::bigint bytes from w")
def counter_stream_sizes(spark, d):
    written = coding.write(*coding.symbols(_codes(spark, d, "morton"), [0], WIDE))
    return written.select("frame", "n", "flag_bits", F.octet_length("flags").cast("bigint").alias("bytes"))


_CELL = ", ".join(f"round(q{a} * (s{a} / 127.5) - o{a} + (s{a} / 127.5) / 2, 6) {a}" for a in "xyz")


@query(f"with {V.LP}, {V.STATS}, {V.Q}, u as (select distinct frame, qx, qy, qz from q) select frame, {_CELL} from u join st on frame = f")
def point_round_trip(spark, d):
    """Points through compress() and expand()."""
    from octarine.plans import codec

    cfg = codec.Config(bits=V.BITS, payload=True, sort_bits=True, archive=True)
    back = codec.expand(cut(codec.compress(V.line_points(spark, d), cfg)), cfg)
    return back.select("frame", *[F.round(a, 6).alias(a) for a in "xyz"])


@query(f"with {V.LP} select chunk::bigint chunk, count(*) frames, sum(n)::bigint inp_points from (select frame, count(*) n, (row_number() over (order by frame) - 1) // 2 chunk from lp group by 1) group by 1")
def chunk_round_trip(spark, d):
    """Two frames to a chunk, coded as one cloud with the place as a fourth axis: the frames that come back."""
    from octarine.plans import codec

    cfg = codec.Config(bits=V.BITS, chunk=2, chunk_bits=2)
    made = cut(codec.compress(V.line_points(spark, d), cfg))
    back = codec.expand(made, cfg).select("frame").distinct()
    own = made.select(F.col("frame").alias("chunk"), "inp_points", F.explode("frames.name").alias("frame"))
    return own.join(back, "frame").groupBy("chunk", "inp_points").agg(F.count(F.lit(1)).alias("frames")).select("chunk", "frames", "inp_points")


@query(_mean_sql(0.05, 20, split=True))
def mean_stream_round_trip(spark, d):
    """The mean-split trees' flags through bit streams and back."""
    written = dyntree.mean_streams(dyntree.mean_split(V.vectors(spark, d), 0.05), 0.05)
    return dyntree.read_mean_streams(written)


@query(f"with {V.EP} select frame, bool_or(greatest(abs(x), abs(y), abs(z)) > 0.3) keep, count(*) n from ep group by frame")
def leaf_prune(spark, d):
    return dyntree.prune(V.vectors(spark, d), 0.3)


@query(f"with {V.EP} select frame, array_to_string(list(k order by e desc, k), ',') axes, round(max(e), 9) widest from (select frame, k, e from (select frame, max(x) - min(x) ex, max(y) - min(y) ey, max(z) - min(z) ez from ep group by frame), (values (0), (1), (2)) r(k), lateral (select case k when 0 then ex when 1 then ey else ez end e)) group by frame")
def axis_order(spark, d):
    box = dyntree.boxes(V.vectors(spark, d), 0.0)
    return box.select("frame", F.concat_ws(",", *[F.col(f"axis_{k}").cast("string") for k in range(3)]).alias("axes"), F.round(F.col("box_0") * 2, 9).alias("widest"))
