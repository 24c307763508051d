"""Queries over geometry, neighbours, distortion and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from octarine.functions import geometry as G
from octarine.operators import learning, neighbours, quantize, reports, sequences
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


def _cols(prefix: str = "") -> list:
    return [F.col(prefix + a) for a in "xyz"]


def _rounded(names, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def _split(spark, d):
    """The even ids as samples, the odd ones as ground truth, in one frame."""
    e = V.vectors(spark, d).withColumn("frame", F.lit(0).cast("bigint"))
    return e.where("point_id % 2 = 0"), e.where("point_id % 2 = 1")


_TWO = f"{V.EP}, a as (select * from ep where point_id % 2 = 0), b as (select * from ep where point_id % 2 = 1)"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_XY = f"xy as (select b.point_id, min({_D}) dist from b, a group by 1), yx as (select a.point_id, min({_D}) dist from a, b group by 1), pk as (select max(m) peak from (select a.point_id, min({_D}) m from b a, b where a.point_id <> b.point_id group by 1))"


@query(f"with {V.EP} select point_id, round(atan2(x, y), 6) u, round(asin(z / sqrt(x * x + y * y + z * z)), 6) v, round(sqrt(x * x + y * y + z * z), 6) d from ep")
def spherical(spark, d):
    u, v, r = G.spherical(*_cols())
    return V.vectors(spark, d).select("point_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), F.round(r, 6).alias("d"))


@query(f"with {V.EP} select point_id, round(x, 6) x, round(y, 6) y, round(z, 6) z from ep")
def cartesian(spark, d):
    """Back from spherical coordinates."""
    u, v, r = G.spherical(*_cols())
    s = V.vectors(spark, d).select("point_id", u.alias("u"), v.alias("v"), r.alias("d"))
    x, y, z = G.cartesian(F.col("u"), F.col("v"), F.col("d"))
    return s.select("point_id", *[F.round(c, 6).alias(a) for a, c in zip("xyz", (x, y, z), strict=True)])


@query(f"with {V.EP} select point_id, round((z + 0.5) / (sqrt(x * x + y * y) * 2.0), 5) v from ep")
def cone(spark, d):
    return V.vectors(spark, d).select("point_id", F.round(G.spherical(*_cols(), z_off=0.5, d_off=2.0, mode="cone")[1], 5).alias("v"))


@query(f"with {V.EP}, w as (select frame, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz from ep group by frame) select point_id, round(x * x + y * y + z * z, 9) square, round(x / sqrt(x * x + y * y + z * z), 9) ux, round(x * y + y * z + z * x, 9) turned, round(x - (lx + hx) / 2, 9) cx from ep join w using (frame)")
def vector_ops(spark, d):
    e, v = V.vectors(spark, d), _cols()
    mid = e.groupBy("frame").agg(((F.min("x") + F.max("x")) / 2).alias("mx"))
    return e.join(mid, "frame").select("point_id", F.round(G.magnitude(v), 9).alias("square"), F.round(G.unit(v)[0], 9).alias("ux"), F.round(G.dot(v, [v[1], v[2], v[0]]), 9).alias("turned"), F.round(F.col("x") - F.col("mx"), 9).alias("cx"))


def _triangles(spark, d):
    """Three consecutive vectors make a triangle."""
    e = V.vectors(spark, d).withColumn("tri_id", F.floor(F.col("point_id") / 3))
    corner = lambda k: F.max(F.when(F.col("point_id") % 3 == k, F.struct("x", "y", "z")))
    return e.groupBy("tri_id").agg(corner(0).alias("a"), corner(1).alias("b"), corner(2).alias("c")).where("a is not null and b is not null and c is not null")


def _corners(t: str = "") -> list:
    return [[F.col(f"{t}{k}.{a}") for a in "xyz"] for k in "abc"]


_TRI = f"{V.EP}, t as (select point_id // 3 tri_id, " + ", ".join(f"max(case when point_id % 3 = {k} then {a} end) {p}{a}{'_' * (p + a == 'by')}" for k, p in enumerate("abc") for a in "xyz") + " from ep group by 1 having count(*) = 3), n as (select *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) nz from t)"


@query(f"with {_TRI} select tri_id, round(nx, 9) nx, round(ny, 9) ny, round(nz, 9) nz, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 9) area from n")
def face_normals(spark, d):
    n = G.face_normal(*_corners())
    return _triangles(spark, d).select("tri_id", *[F.round(c, 9).alias(f"n{a}") for a, c in zip("xyz", n, strict=True)], F.round(G.area(*_corners()), 9).alias("area"))


@query(f"with {_TRI} select tri_id, 0 edge, round((by_ - ay) * nz - (bz - az) * ny, 9) ex from n union all select tri_id, 1, round((cy - by_) * nz - (cz - bz) * ny, 9) from n union all select tri_id, 2, round((ay - cy) * nz - (az - cz) * ny, 9) from n")
def edge_normals(spark, d):
    edges = F.array(*[e[0] for e in G.edge_normals(*_corners())])
    return _triangles(spark, d).select("tri_id", F.posexplode(edges).alias("edge", "ex")).select("tri_id", "edge", F.round("ex", 9).alias("ex"))


def _faces(spark, d):
    """A fan of faces over the triangles' corners, each shared by the triangles that name it."""
    n = G.face_normal(*_corners())
    got = _triangles(spark, d).select("tri_id", *[c.alias(f"n{a}") for a, c in zip("xyz", n, strict=True)])
    return got.select((F.col("tri_id") % 50).alias("v0"), ((F.col("tri_id") + 1) % 50).alias("v1"), ((F.col("tri_id") + 7) % 50).alias("v2"), "nx", "ny", "nz")


_FACES = f"{_TRI}, f as (select tri_id % 50 v0, (tri_id + 1) % 50 v1, (tri_id + 7) % 50 v2, nx, ny, nz from n), k as (select unnest([v0, v1, v2]) vertex, nx, ny, nz from f), vn as (select vertex, sum(nx) nx, sum(ny) ny, sum(nz) nz from k group by 1)"


@query(f"with {_FACES} select vertex, round(nx, 6) nx, round(ny, 6) ny, round(nz, 6) nz from vn")
def vertex_normals(spark, d):
    return neighbours.vertex_normals(_faces(spark, d)).select("vertex", *_rounded(("nx", "ny", "nz")))


@query(f"with {_FACES} select k.vertex, bool_and(k.nx * vn.nx + k.ny * vn.ny + k.nz * vn.nz <= 0.9) keep from k join vn on k.vertex = vn.vertex group by 1")
def planar_mask(spark, d):
    faces = _faces(spark, d)
    return neighbours.planar(neighbours.vertex_normals(faces), faces)


@query(f"with {_TWO} select b.point_id, arg_min(a.point_id, ({_D}, a.point_id)) other_id, round(min({_D}), 9) dist from b, a group by 1")
def nn_distance(spark, d):
    sample, truth = _split(spark, d)
    return neighbours.nearest(truth, sample).select("point_id", "other_id", F.round("dist", 9).alias("dist"))


@query(f"with {_TWO}, r as (select a.point_id, b.point_id other_id, {_D} dist, row_number() over (partition by a.point_id order by {_D}, b.point_id) k from ep a join ep b on a.frame = b.frame) select point_id, k::int rank, other_id, round(dist, 9) dist from r where k <= 4")
def knn_k(spark, d):
    e = V.vectors(spark, d)
    return neighbours.nearest(e, e, 4).select("point_id", "rank", "other_id", F.round("dist", 9).alias("dist"))


@query(f"with {_TWO}, {_XY}, m as (select count(*) n, 100.0 * count(*) filter (dist <= 0.03) / count(*) acc, min(dist) lo, max(dist) hi, avg(dist * dist) mse, avg(dist) cd from xy), w as (select count(*) n, 100.0 * count(*) filter (dist <= 0.03) / count(*) acc, avg(dist * dist) mse, avg(dist) cd from yx) select m.n xy_points, w.n yx_points, round(m.acc::double, 6) xy_acc, round(w.acc::double, 6) yx_acc, round(m.lo, 6) xy_min, round(m.hi, 6) xy_max, round(m.mse, 9) xy_mse, round(w.mse, 9) yx_mse, round(peak, 6) peak, round((m.cd + w.cd) / 2, 6) sym_cd, round(10 * log10(peak * peak / m.mse), 4) xy_psnr, round(10 * log10(peak * peak / ((m.mse + w.mse) / 2)), 4) sym_psnr from m, w, pk")
def psnr_report(spark, d):
    got = neighbours.report(*_split(spark, d))
    return got.select("xy_points", "yx_points", *_rounded(("xy_acc", "yx_acc", "xy_min", "xy_max", "peak", "sym_cd")), *_rounded(("xy_mse", "yx_mse"), 9), *_rounded(("xy_psnr", "sym_psnr"), 4))


@query(f"with {_TWO}, {_XY}, m as (select t::double tau, 100.0 * count(*) filter (dist <= t) / count(*) acc from xy, (values (0.03), (0.06), (0.1)) r(t) group by 1) select tau, round(acc::double, 6) acc from m")
def accuracy_tau(spark, d):
    sample, truth = _split(spark, d)
    found = neighbours.nearest(truth, sample)
    taus = F.array(F.lit(0.03), F.lit(0.06), F.lit(0.1))
    return found.select("dist", F.explode(taus).alias("tau")).groupBy("tau").agg(F.round(100.0 * F.count_if(F.col("dist") <= F.col("tau")) / F.count(F.lit(1)), 6).alias("acc"))


@query(f"with {_TWO}, {_XY}, v as (select unnest([struct_pack(metric := 'dist', value := dist), struct_pack(metric := 'square', value := dist * dist)]) r from xy) select r.metric metric, round(min(r.value), 9) \"min\", round(max(r.value), 9) \"max\", round(avg(r.value), 9) mean from v group by 1")
def report_roll_up(spark, d):
    sample, truth = _split(spark, d)
    found = neighbours.nearest(truth, sample).withColumn("square", F.col("dist") * F.col("dist"))
    return reports.roll_up(found, ["dist", "square"]).select("metric", *_rounded(("min", "max", "mean"), 9))


@query()
def plane_distance(spark, d):
    sample, truth = _split(spark, d)
    return neighbours.plane_distance(neighbours.nearest(truth, sample), truth, sample, neighbours.plane_normals(sample))


def _primitive_sql() -> str:
    """Every point against every triangle: the foot in the plane where it is inside, else the nearest point of an edge."""
    dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
    minus = lambda a, b: [f"({x} - {y})" for x, y in zip(a, b, strict=True)]
    cross = lambda a, b: [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]
    v = {"a": ["ax", "ay", "az"], "b": ["bx", "by_", "bz"], "c": ["cx", "cy", "cz"], "p": ["x", "y", "z"], "n": ["nx", "ny", "nz"], "f": ["fx", "fy", "fz"]}
    edges = [("a", "b"), ("b", "c"), ("c", "a")]
    plane = f"g as (select *, {dot(minus(v['p'], v['a']), v['n'])} / nullif({dot(v['n'], v['n'])}, 0) t from ep, n)"
    foot = "h as (select *, " + ", ".join(f"{x} - t * n{x} f{x}" for x in "xyz") + ", " + ", ".join(f"least(1.0, greatest(0.0, coalesce({dot(minus(v['p'], v[a]), minus(v[b], v[a]))} / nullif({dot(minus(v[b], v[a]), minus(v[b], v[a]))}, 0), 0.0))) s{k}" for k, (a, b) in enumerate(edges)) + " from g)"
    inside = " and ".join(f"{dot(cross(minus(v[b], v[a]), minus(v['f'], v[a])), v['n'])} >= 0" for a, b in edges)
    on = [[f"({x} + s{k} * ({y} - {x}))" for x, y in zip(v[a], v[b], strict=True)] for k, (a, b) in enumerate(edges)]
    far = lambda q: dot(minus(v["p"], q), minus(v["p"], q))
    best = f"k as (select *, case when t is not null and {inside} then [{far(v['f'])}, {', '.join(v['f'])}] else list_min([{', '.join(f'[{far(q)}, ' + ', '.join(q) + ']' for q in on)}]) end w from h)"
    return f"with {_TRI}, {plane}, {foot}, {best}, m as (select point_id, min((w[1], tri_id)) r, arg_min(w, (w[1], tri_id)) w, arg_min(tri_id, (w[1], tri_id)) tri_id from k group by 1) select point_id, tri_id, round(w[1], 6) dist2, round(w[2], 6) px, round(w[3], 6) py, round(w[4], 6) pz from m"


@query(_primitive_sql())
def nearest_primitive(spark, d):
    got = neighbours.nearest_primitive(V.vectors(spark, d), _triangles(spark, d))
    return got.select("point_id", "tri_id", *_rounded(("dist2", "px", "py", "pz")))


@query(f"with {_TRI}, r as (select point_id ray_id, x ox, y oy, z oz, -2 * x dx, -2 * y dy, -2 * z dz from ep), g as (select *, bx - ax ux, by_ - ay uy, bz - az uz, cx - ax wx, cy - ay wy, cz - az wz, ox - ax sx, oy - ay sy, oz - az sz from r, n), h as (select *, dy * wz - dz * wy hx, dz * wx - dx * wz hy, dx * wy - dy * wx hz, sy * uz - sz * uy qx, sz * ux - sx * uz qy, sx * uy - sy * ux qz from g), k as (select *, ux * hx + uy * hy + uz * hz det from h), p as (select ray_id, tri_id, (sx * hx + sy * hy + sz * hz) / det u, (dx * qx + dy * qy + dz * qz) / det v, (wx * qx + wy * qy + wz * qz) / det t from k where det <> 0) select ray_id, tri_id, round(t, 6) t from p where u >= 0 and v >= 0 and u + v <= 1 and t between 0 and 1")
def raycast(spark, d):
    rays = V.vectors(spark, d).select(F.col("point_id").alias("ray_id"), F.struct("x", "y", "z").alias("p0"), F.struct(*[(-F.col(a)).alias(a) for a in "xyz"]).alias("p1"))
    return neighbours.raycast(rays, _triangles(spark, d)).select("ray_id", "tri_id", F.round("t", 6).alias("t"))


@query("select c_name sample, coalesce(s_name, (select max(s_name) from supplier)) truth from (select c_name, row_number() over (order by c_name) k from customer) left join (select s_name, row_number() over (order by s_name) k from supplier) using (k)")
def pair_frames(spark, d):
    name = lambda t, c: V.table(spark, d, t).select(F.col(c).alias("name"))
    return neighbours.pair_up(name("customer", "c_name"), name("supplier", "s_name"))


@query(f"with {V.EP} select point_id, x, y, z from ep where isfinite(x) and isfinite(y) and isfinite(z)")
def finite_filter(spark, d):
    return V.vectors(spark, d).where(G.finite(_cols())).select("point_id", *"xyz")


@query(f"with {V.LP} select frame, x, z, count(*) n from lp group by all")
def distinct_points(spark, d):
    return V.line_points(spark, d).groupBy("frame", "x", "z").agg(F.count(F.lit(1)).alias("n"))


@query()
def principal_axes(spark, d):
    return sequences.align(V.vectors(spark, d)).select("frame", "point_id", *[F.round(f"a{k}", 9).alias(f"a{k}") for k in range(3)])


@query(f"with {V.EP} select frame, point_id, round(x, 6) x, round(y, 6) y, round(z, 6) z from ep")
def principal_axes_back(spark, d):
    """The points from their principal axes."""
    aligned = sequences.align(V.vectors(spark, d), keep=True).drop(*"xyz")
    return sequences.unalign(aligned).select("frame", "point_id", *_rounded("xyz"))


@query(f"with {V.EP}, s as (select frame, point_id, atan2(x, y) u, asin(z / sqrt(x * x + y * y + z * z)) v, sqrt(x * x + y * y + z * z) d from ep), w as (select frame, " + ", ".join(f"min({a}) l{a}, max({a}) h{a}" for a in "uvd") + " from s group by 1) select frame, point_id, " + ", ".join(f"round(({a} - l{a}) / nullif(h{a} - l{a}, 0), 6) {a}" for a in "uvd") + " from s join w using (frame)")
def spherical_norm(spark, d):
    """Spherical coordinates from 0 to 1 in each frame."""
    s = V.vectors(spark, d).select("frame", "point_id", *[c.alias(n) for n, c in zip("uvd", G.spherical(*_cols()), strict=True)])
    return quantize.min_max(s, "uvd").select("frame", "point_id", *[F.round(f"n{a}", 6).alias(a) for a in "uvd"])


@query()
def augmented(spark, d):
    return sequences.augment(V.vectors(spark, d)).select("frame", "point_id", *"xyz")


@query("with e as (select vec_id, cast(unnest(embedding) as double) v, unnest(range(1, 65)) k from embeddings), m as (select vec_id, max(abs(v)) t from e group by 1) select e.vec_id, round(sum(v / t), 6) total, round(max(abs(v / t)), 6) top from e join m using (vec_id) group by 1")
def row_normalize(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", learning.row_normalize(F.col("embedding").cast("array<double>")).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max(F.transform("v", F.abs)), 6).alias("top"))


_SCORE = "sc as (select l.doc_id, l.quality::double y, least(0.99, greatest(0.01, d.n_chars / 5000.0))::double p from labels l join documents d using (doc_id))"


def _scores(spark, d):
    labels, docs = V.table(spark, d, "labels"), V.table(spark, d, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").cast("double").alias("y"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 5000.0)).alias("p"))


@query(f"with {_SCORE} select round(avg(-pow(1 - ((1 - y) - p * (1 - 2 * y)), 5) * ln((1 - y) - p * (1 - 2 * y))), 9) loss, round(0.7 * avg(-pow(1 - ((1 - y) - p * (1 - 2 * y)), 5) * ln((1 - y) - p * (1 - 2 * y))) + 0.3 * avg((p - y) * (p - y)), 9) combined from sc")
def focal_loss(spark, d):
    loss = learning.focal_loss(F.col("y"), F.col("p"))
    square = F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))
    return _scores(spark, d).agg(F.round(loss, 9).alias("loss"), F.round(learning.combined([(0.7, loss), (0.3, square)]), 9).alias("combined"))


@query(f"with {_SCORE} select round(avg(((p >= 0.5)::int = y::int)::double), 9) accuracy, round(sqrt(avg((p - y) * (p - y))), 9) rmse, round(avg(pow(ln(1 + p) - ln(1 + y), 2)), 9) msle from sc")
def score_metrics(spark, d):
    return _scores(spark, d).agg(*learning.metrics(F.col("y"), F.col("p"))).select(*_rounded(("accuracy", "rmse", "msle"), 9))


_NODES = f"with {V.MCODES}, nd as (select distinct frame, l::int layer, code >> cast(24 - 3 * l as int) node from m, range(8) r(l))"


def _nodes(spark, d):
    from octarine.operators import ntree

    codes = quantize.encode(V.line_points(spark, d), V.BITS, order="morton").select("frame", "code").distinct()
    return ntree.tokenize(codes, [3], V.WIDTH).select("frame", "layer", F.col("parent").alias("node")).distinct()


@query(f"{_NODES}, k as (select *, k, (node << 3) + k id from nd, range(8) r(k)), u as (select frame, layer, bit_or(id) used from k group by all) select k.frame, k.layer, k.node, k.k::int k, (select sum(((u.used >> j::int) & 1) - 2 * ((k.id >> j::int) & 1)) from range(24) q(j))::double total from k join u on u.frame = k.frame and u.layer = k.layer")
def child_bits(spark, d):
    got = learning.child_bits(_nodes(spark, d), 3, 24)
    return got.select("frame", "layer", "node", "k", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"{_NODES}, w as (select *, (node & 7)::double x, ((node >> 3) & 7)::double y, ((node >> 6) & 7)::double z from nd), p as (select *, lag(x) over q bx, lag(y) over q by_, lag(z) over q bz, lead(x) over q ax, lead(y) over q ay, lead(z) over q az from w window q as (partition by frame, layer order by node)) select frame, layer, node, round(exp(-(pow(bx - x, 2) + pow(by_ - y, 2) + pow(bz - z, 2))), 9) before, round(exp(-(pow(ax - x, 2) + pow(ay - y, 2) + pow(az - z, 2))), 9) \"after\" from p")
def pivots(spark, d):
    n = _nodes(spark, d).withColumns({a: F.shiftright("node", 3 * k).bitwiseAND(7).cast("double") for k, a in enumerate("xyz")})
    got = learning.pivots(n)
    return got.select("frame", "layer", "node", F.round(F.col("pivots")[0], 9).alias("before"), F.round(F.col("pivots")[1], 9).alias("after"))


_CIRCLE = f"{_NODES}, w as (select *, (node & 7)::double x, ((node >> 3) & 7)::double y, ((node >> 6) & 7)::double z, row_number() over (partition by frame, layer order by node) - 1 i, count(*) over (partition by frame, layer) n from nd), j as (select a.frame, a.layer, a.node, a.x, a.y, a.z, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz from w a join w b on b.frame = a.frame and b.layer = a.layer and b.i = (a.i - 1 + a.n) % a.n join w c on c.frame = a.frame and c.layer = a.layer and c.i = (a.i + 1) % a.n), o as (select *, x + case when k & 1 = 1 then 0.25 else -0.25 end ox, y + case when k & 2 = 2 then 0.25 else -0.25 end oy, z + case when k & 4 = 4 then 0.25 else -0.25 end oz from j, range(8) r(k))"


@query(f"{_CIRCLE} select frame, layer, node, k::int k, round(exp(-((ox - bx) * (ox - bx) + (oy - by_) * (oy - by_) + (oz - bz) * (oz - bz))), 9) before, round(exp(-((ox - cx) * (ox - cx) + (oy - cy) * (oy - cy) + (oz - cz) * (oz - cz))), 9) \"after\" from o")
def circular_pivots(spark, d):
    """The middles of children against the nodes around their parent, the last node being beside the first."""
    n = _nodes(spark, d).withColumns({a: F.shiftright("node", 3 * k).bitwiseAND(7).cast("double") for k, a in enumerate("xyz")} | {f"box_{a}": F.lit(0.5) for a in "xyz"})
    got = learning.circular_pivots(n)
    return got.select("frame", "layer", "node", "k", F.round(F.col("pivots")[0], 9).alias("before"), F.round(F.col("pivots")[1], 9).alias("after"))


@query(f"with {V.EP} select frame, point_id, row_number() over (partition by frame order by x, point_id)::int rank_x, row_number() over (partition by frame order by y, point_id)::int rank_y, row_number() over (partition by frame order by z, point_id)::int rank_z from ep")
def axis_ranks(spark, d):
    n = V.vectors(spark, d).withColumnRenamed("point_id", "node")
    return learning.ranks(n, by=["frame"]).select("frame", F.col("node").alias("point_id"), "rank_x", "rank_y", "rank_z")


@query("select vec_id, label::bigint label, (select sum((k = label)::int * (k + 1)) from range(10) r(k))::double place, (case when bit_count(label::bigint) is null then 0 else bit_count(label::bigint) + 1 end)::double bits from embeddings")
def one_hot_labels(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"))
    hot = F.aggregate(F.transform(learning.one_hot(F.col("label"), 10), lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    both = learning.labels(e.withColumn("flag", F.col("label")), 2)
    bits = both.select("vec_id", F.aggregate("label", F.lit(0.0), lambda a, x: a + x).alias("bits"))
    return e.select("vec_id", "label", hot.alias("place")).join(bits, "vec_id")
