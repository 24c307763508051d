"""Queries over scan order, aggregations of reports, coders and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from octarine.operators import entropy, reports, scans, sequences
from octarine.plans import views as V

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _signal(spark, d, shift: float = 0.0):
    return V.signal(spark, d).withColumn("y", F.col("y") - shift)


_SHIFTED = f"with {V.VP}, s as (select frame, point_id, y - 50 y from vp), r as (select *, (lag(y) over w < 0 and y >= 0)::int t from s window w as (partition by frame order by point_id)), g as (select frame, point_id, y, coalesce(sum(t) over (partition by frame order by point_id), 0)::bigint ring from r)"


@query(f"{_SHIFTED} select frame, point_id, ring from g")
def scan_ring(spark, d):
    return sequences.scan_rings(_signal(spark, d, 50)).select("frame", "point_id", "ring")


@query(f"{_SHIFTED}, m as (select frame, ring, sum(round(y * 1e9)::decimal(28, 0))::double / count(y) / 1e9 mean from g group by all) select frame, ring, round(mean, 6) mean, row_number() over (partition by frame order by mean, ring)::int rank from m")
def ring_rank(spark, d):
    """Rings in the order of their exact mean; ties: the lower ring."""
    ranked = sequences.rank_rings(sequences.scan_rings(_signal(spark, d, 50)), "y")
    return ranked.select("frame", "ring", (F.round(F.col("mean") * 1e6) / 1e6).alias("mean"), "rank")


@query(f"with {V.VP}, i as (select frame, point_id, trunc(y)::bigint v from vp) select frame, point_id, coalesce(sum(v) over (partition by frame order by point_id rows between unbounded preceding and 1 preceding), 0)::bigint before, sum(v) over (partition by frame order by point_id rows unbounded preceding)::bigint upto from i")
def running_sums(spark, d):
    v = V.signal(spark, d).withColumn("v", F.col("y").cast("bigint"))
    return sequences.running_sums(v, "v").select("frame", "point_id", "before", "upto")


@query(f"with {V.VP}, k as (select *, row_number() over (partition by frame order by point_id) - 1 k, count(*) over (partition by frame) n from vp) select a.frame, a.point_id, round(max(b.y) filter (b.k = (a.k - 2 + a.n) % a.n), 6) b2, round(max(b.y) filter (b.k = (a.k - 1 + a.n) % a.n), 6) b1, round(max(b.y) filter (b.k = (a.k + 1) % a.n), 6) a1, round(max(b.y) filter (b.k = (a.k + 2) % a.n), 6) a2 from k a join k b on a.frame = b.frame and b.k in ((a.k - 2 + a.n) % a.n, (a.k - 1 + a.n) % a.n, (a.k + 1) % a.n, (a.k + 2) % a.n) group by all")
def roll_neighbours(spark, d):
    got = sequences.neighbours(V.signal(spark, d), "y", 4)
    return got.select("frame", "point_id", *[F.round(F.col("around")[j], 6).alias(n) for j, n in enumerate(("b2", "b1", "a1", "a2"))])


@query(f"with {V.VP}, k as (select *, (row_number() over (partition by frame order by point_id) - 1) // 64 block from vp) select frame, point_id, block, round(y - first_value(y) over (partition by frame, block order by point_id), 6) dy from k")
def chunk_delta(spark, d):
    return sequences.blocks(V.signal(spark, d), 64, ["y"]).select("frame", "point_id", "block", F.round("dy", 6).alias("dy"))


@query("select p_name name, (row_number() over (order by p_name, p_partkey) - 1) // 16 chunk, (row_number() over (order by p_name, p_partkey) - 1) % 16 slot from part")
def frame_chunks(spark, d):
    parts = V.table(spark, d, "part").select("p_name", "p_partkey").withColumn("name", F.struct("p_name", "p_partkey"))
    return sequences.chunks(parts, 16).select(F.col("p_name").alias("name"), "chunk", F.col("slot").cast("bigint").alias("slot"))


@query(f"with {V.VP} select frame, point_id, round(list_sum(list(y) over w), 6) total, (count(*) over w)::bigint n from vp window w as (partition by frame order by point_id rows between 4 preceding and current row)")
def sliding_batches(spark, d):
    got = sequences.batches(V.signal(spark, d), "y", 5, pad=-1.0)
    inner = F.filter("window", lambda x: x >= 0)
    return got.select("frame", "point_id", F.round(F.aggregate(inner, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size(inner).cast("bigint").alias("n"))


@query(f"with {V.VP} select frame, point_id, round(y - lag(y) over (partition by frame order by point_id), 6) delta from vp")
def value_deltas(spark, d):
    return sequences.deltas(V.signal(spark, d), "y").select("frame", "point_id", F.round("delta", 6).alias("delta"))


@query(f"with {V.VP}, m as (select *, y > 200 mark from vp) select frame, point_id, first_value(case when mark then y end ignore nulls) over (partition by frame order by point_id rows between 1 following and unbounded following) next_value from m")
def next_keypoint(spark, d):
    return sequences.next_marked(V.signal(spark, d).withColumn("mark", F.col("y") > 200), "mark", "y").select("frame", "point_id", "next_value")


@query(f"with recursive {V.VP}, k as (select *, row_number() over (partition by frame order by point_id) k from vp), e as (select frame, k, point_id, y smoothed, y * 0.9 + y * (1 - 0.9) state from k where k = 1 union all select k.frame, k.k, k.point_id, e.state, e.state * 0.9 + k.y * (1 - 0.9) from e join k on k.frame = e.frame and k.k = e.k + 1) select frame, point_id, round(smoothed, 6) smoothed from e")
def ewma(spark, d):
    return sequences.smooth(V.signal(spark, d), "y").select("frame", "point_id", F.round("smoothed", 6).alias("smoothed"))


_EO = f"{V.EP}, k as (select *, row_number() over (partition by frame order by point_id) k, count(*) over (partition by frame) n, lag(x) over w px, lag(y) over w py, lag(z) over w pz from ep window w as (partition by frame order by point_id))"
_WAY = "(k.px - e.kx) * (k.px - e.kx) + (k.py - e.ky) * (k.py - e.ky) + (k.pz - e.kz) * (k.pz - e.kz)"
_STEP = "(k.x - k.px) * (k.x - k.px) + (k.y - k.py) * (k.y - k.py) + (k.z - k.pz) * (k.z - k.pz)"
_DOT = "(k.px - e.kx) * (k.x - k.px) + (k.py - e.ky) * (k.y - k.py) + (k.pz - e.kz) * (k.z - k.pz)"


@query(f"with recursive {_EO}, e as (select frame, k, x kx, y ky, z kz, false turn from k where k = 1 union all select frame, k, case when turn then px else kx end, case when turn then py else ky end, case when turn then pz else kz end, turn from (select k.frame, k.k, k.px, k.py, k.pz, e.kx, e.ky, e.kz, k.k > 2 and w > 0 and s > 0 and t * t / (w * s) < 1 - pow(exp(-w), 4) turn from e join k on k.frame = e.frame and k.k = e.k + 1, lateral (select {_WAY} w, {_STEP} s, {_DOT} t))) select k.frame, k.point_id, k.k = 1 or k.k = k.n or coalesce(t.turn, false) keypoint from k left join e t on t.frame = k.frame and t.k = k.k + 1")
def scan_keypoints(spark, d):
    return sequences.keypoints(V.vectors(spark, d)).select("frame", "point_id", "keypoint")


def _corner_sql(rounds: int, tolerance: float) -> str:
    """Rounds over all open segments: g<r> segments, m<r> the farthest point of each that is too far."""
    axes = "xyz"
    parts = [V.EP, "k as materialized (select *, row_number() over (partition by frame order by point_id) - 1 k, count(*) over (partition by frame) - 1 n from ep)", "g0 as materialized (select frame, 0::bigint a, max(n) b from k group by 1 having max(n) > 1)"]
    for r in range(rounds):
        way = {c: f"(q.{c} - p.{c})" for c in axes}
        off = {c: f"(i.{c} - p.{c})" for c in axes}
        n, d = (" + ".join(f"{x[c]} * {way[c]}" for c in axes) for x in (way, off))
        e = " + ".join(f"({off[c]} - t * {way[c]}) * ({off[c]} - t * {way[c]})" for c in axes)
        parts.append(f"e{r} as (select g.frame, g.a, g.b, i.k, {e} e from g{r} g join k p on p.frame = g.frame and p.k = g.a join k q on q.frame = g.frame and q.k = g.b join k i on i.frame = g.frame and i.k > g.a and i.k < g.b, lateral (select {n} way2, {d} along), lateral (select case when way2 > 0 then least(1.0, greatest(0.0, along / way2)) else 0.0 end t))")
        parts.append(f"m{r} as materialized (select frame, a, b, arg_max(k, (e, -k)) m from e{r} group by all having max(e) > {tolerance} * {tolerance})")
        parts.append(f"g{r + 1} as materialized (select frame, a, m b from m{r} union all select frame, m, b from m{r})")
    all_ = " union all ".join(f"select frame, m from m{r}" for r in range(rounds))
    return f"with {', '.join(parts)}, c as ({all_}) select k.frame, k.point_id, k.k = 0 or k.k = k.n or c.m is not null corner from k left join c on c.frame = k.frame and c.m = k.k"


@query(_corner_sql(40, 0.2))
def polyline_corners(spark, d):
    return sequences.simplify(V.vectors(spark, d), 0.2).select("frame", "point_id", "corner")


@query(f"with {V.VP} select frame, round(sum(y), 4) sum, max(y) \"max\", round(avg(y), 6) mean from vp group by frame")
def segment_stats(spark, d):
    got = reports.segment_stats(V.signal(spark, d), ["frame"], "y")
    return got.select("frame", F.round("sum", 4).alias("sum"), "max", F.round("mean", 6).alias("mean"))


@query(f"with {V.VP} select frame, arg_max(point_id, (y, -point_id)) point_id, max(y) y from vp group by frame")
def farthest_per_segment(spark, d):
    return reports.farthest(V.signal(spark, d), ["frame"], "y", "point_id")


@query(f"with {V.VP} select frame, round(quantile_cont(y, 0), 6) lo, round(quantile_cont(y, 0.25), 6) q1, round(quantile_cont(y, 0.5), 6) mid, round(quantile_cont(y, 0.75), 6) q3, round(quantile_cont(y, 1), 6) hi from vp group by frame")
def five_numbers(spark, d):
    got = reports.five_numbers(V.signal(spark, d), ["frame"], "y")
    return got.select("frame", *[F.round(c, 6).alias(c) for c in ("lo", "q1", "mid", "q3", "hi")])


@query(f"with {V.VP} select frame, trunc(y / 10)::bigint symbol, count(*) n from vp group by all")
def distinct_counts(spark, d):
    return _symbols(spark, d).groupBy("frame", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag codec, round(sum(l_quantity) / count(*), 6) bpp, round(max(l_extendedprice), 6) psnr from lineitem where l_linestatus = 'F' group by 1")
def rate_distortion(spark, d):
    rows = V.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("codec"), F.col("l_linestatus").alias("precision")).agg(F.round(F.sum("l_quantity") / F.count(F.lit(1)), 6).alias("bpp"), F.round(F.max("l_extendedprice"), 6).alias("psnr"))
    return reports.rate_distortion(rows, "F")


def _symbols(spark, d):
    return V.signal(spark, d).withColumn("symbol", (F.col("y") / 10).cast("bigint")).select("frame", "point_id", "symbol")


@query(f"with {V.VP}, s as (select frame, point_id, trunc(y / 10)::bigint symbol from vp), c as (select *, count(*) over (partition by frame, symbol order by point_id rows between unbounded preceding and 1 preceding) seen, count(*) over (partition by frame order by point_id rows between unbounded preceding and 1 preceding) total from s) select frame, point_id, symbol, round(-log2((seen + 1) / (total + 64)), 6) as \"cost\" from c")
def adaptive_cost(spark, d):
    got = entropy.adaptive_cost(_symbols(spark, d), 64, ["frame"], "point_id", "symbol")
    return got.select("frame", "point_id", "symbol", F.round("cost", 6).alias("cost"))


@query(f"with {V.VP} select frame, row_number() over (partition by frame order by point_id) - 1 k, trunc(y / 10)::bigint symbol from vp")
def range_round_trip(spark, d):
    """What comes back from the range coder's streams."""
    return entropy.range_decoded(entropy.range_coded(_symbols(spark, d)))


@query(f"with recursive {V.VP}, s as (select frame, row_number() over (partition by frame order by point_id) k, point_id, trunc(y / 10)::bigint symbol from vp), e as (select frame, k, point_id, symbol, list_transform(range(64), lambda i: 1.0::double) counts from s where k = 1 union all select s.frame, s.k, s.point_id, s.symbol, list_transform(e.counts, lambda c, i: c * 0.98 + (i - 1 = e.symbol)::int) from e join s on s.frame = e.frame and s.k = e.k + 1) select frame, point_id, symbol, round(-log2(counts[symbol + 1] / list_sum(counts)), 6) as \"cost\" from e")
def fading_cost(spark, d):
    """Bits under counts that shrink with each symbol, as doubles; null for symbols of 64 and above, which have no count."""
    got = scans.stepped_cost(_symbols(spark, d), 64, 0.98)
    return got.select("frame", "point_id", "symbol", F.round("cost", 6).alias("cost"))
