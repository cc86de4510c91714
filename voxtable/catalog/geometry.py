"""Mesh, nearest-neighbour, fit and graph queries: embeddings as 3-D points and as a vertex grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.catalog import Registry
from voxtable.catalog.tables import GRID, grid, points, points_sql, r, table
from voxtable.operators import components, fits, geometry, nearest, ordered, shift
from voxtable.plans import experiments, verdicts
from voxtable.session import stored
from voxtable.sources import writers

REGISTRY = Registry()
query = REGISTRY.query

XYZ = ["x", "y", "z"]


def mesh(spark: SparkSession, folder: str, rule: str = "above_half") -> DataFrame:
    """Vertex grid i = vec_id, j = 0..15: x, y, z are the dimension planes 0-15, 16-31, 32-47, moved by the grid position."""
    g = grid(spark, folder)
    planes = [g.where(F.col("x").between(16 * k, 16 * k + 15)).select(F.col("y").alias("i"), (F.col("x") - 16 * k).cast("int").alias("j"), F.col("v").alias("v")) for k in range(3)]
    shifted = [p.withColumn("v", F.col("v") + b) for p, b in zip(planes, (F.col("i") * 0.1, F.col("j") * 0.1, F.lit(-0.45)))]
    return geometry.mesh_from_planes(*shifted, rule=rule)


MESH = """SELECT vec_id::INT AS i, j::INT AS j, embedding[j + 1]::DOUBLE + vec_id * 0.1 AS x, embedding[j + 17]::DOUBLE + j * 0.1 AS y, embedding[j + 33]::DOUBLE + -0.45 AS z FROM embeddings, range(16) t(j)"""
VALID = "x > -0.5 AND y > -0.5 AND z > -0.5"


@query(f"SELECT i, j, round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, round(z, 9) + 0.0 AS z, {VALID} AS valid FROM ({MESH})")
def mesh_planes_join(spark, folder):
    return mesh(spark, folder).select("i", "j", *[r(c, 9).alias(c) for c in XYZ], "valid")


@query(
    f"""SELECT count(*) FILTER (x > 0 AND y > 0 AND z > 0) AS positive, count(*) FILTER ({VALID}) AS above_half, count(*) FILTER (x > 0) AS finite_x,
 count(*) FILTER (x BETWEEN 0 AND 9 AND y BETWEEN 0 AND 1 AND z BETWEEN 0 AND 3) AS inside, count(*) FILTER ((x BETWEEN 0 AND 9 AND y BETWEEN 0 AND 1 AND z BETWEEN 0 AND 3) OR NOT ({VALID})) AS inside_or_invalid FROM ({MESH})"""
)
def validity_rules(spark, folder):
    m = mesh(spark, folder)
    shape = (10, 2, 4)
    return m.agg(
        F.count_if(geometry.validity("positive")).alias("positive"), F.count_if(geometry.validity("above_half")).alias("above_half"), F.count_if(geometry.validity("finite_x")).alias("finite_x"),
        F.count_if(geometry.inside_volume(shape)).alias("inside"), F.count_if(geometry.inside_volume(shape, valid="valid")).alias("inside_or_invalid"),
    )


@query(
    f"""WITH m AS (SELECT * FROM ({MESH}) WHERE {VALID}) SELECT a.i, a.j, round(least(a.z, b.z, c.z, d.z), 9) + 0.0 AS min_z, round(greatest(a.z, b.z, c.z, d.z), 9) + 0.0 AS max_z FROM m a JOIN m b ON b.i = a.i + 1 AND b.j = a.j JOIN m c ON c.i = a.i AND c.j = a.j + 1 JOIN m d ON d.i = a.i + 1 AND d.j = a.j + 1"""
)
def cell_all_corners(spark, folder):
    return geometry.cell_corners(mesh(spark, folder), [], ["z"]).select("i", "j", r("min_z", 9).alias("min_z"), r("max_z", 9).alias("max_z"))


@query(
    f"""WITH m AS (SELECT *, {VALID} AS valid FROM ({MESH})), b AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM m WHERE valid)
 SELECT (i - i0)::INT AS i, (j - j0)::INT AS j, round(CASE WHEN valid THEN x ELSE -1 END, 9) + 0.0 AS x, round(CASE WHEN valid THEN y ELSE -1 END, 9) + 0.0 AS y, round(CASE WHEN valid THEN z ELSE -1 END, 9) + 0.0 AS z, valid FROM m, b WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1"""
)
def cell_export(spark, folder):
    out = writers.export_mesh(mesh(spark, folder), [])
    return out.select("i", "j", *[r(c, 9).alias(c) for c in XYZ], "valid")


@query(f"SELECT count(*) AS nodes, round(min(x), 9) AS min_x, round(max(x), 9) AS max_x, round(min(z), 9) AS min_z, round(max(z), 9) AS max_z, count(*) * 16.0::DOUBLE AS area_vx2, 0.25::DOUBLE AS scale FROM ({MESH}) WHERE {VALID}")
def mesh_extent(spark, folder):
    out = writers.mesh_meta(mesh(spark, folder), [], 4.0)
    return out.select("nodes", *[r(c, 9).alias(c) for c in ("min_x", "max_x", "min_z", "max_z")], "area_vx2", "scale")


@query(f"SELECT (i - 8)::INT AS i, (j - 2)::INT AS j, round(x, 9) + 0.0 AS x FROM ({MESH}) WHERE i >= 8 AND i < 32 AND j >= 2 AND j < 14")
def submesh_window(spark, folder):
    out = writers.sub_mesh(mesh(spark, folder), 10, 30, 4, 12, 2, 10**9, 16)
    return out.select("i", "j", r("x", 9).alias("x"))


def _diff_sql(axis: str, other: str) -> str:
    w = f"(PARTITION BY {other} ORDER BY {axis})"
    return f"CASE WHEN lag({axis}) OVER {w} = {axis} - 1 THEN z - lag(z) OVER {w} END AS b_{axis}, CASE WHEN lead({axis}) OVER {w} = {axis} + 1 THEN lead(z) OVER {w} - z END AS f_{axis}"


@query(f"WITH m AS (SELECT * FROM ({MESH}) WHERE {VALID}), d AS (SELECT i, j, {_diff_sql('i', 'j')}, {_diff_sql('j', 'i')} FROM m) SELECT i, j, round(coalesce((b_i + f_i) / 2, b_i, f_i), 9) + 0.0 AS du_z, round(coalesce((b_j + f_j) / 2, b_j, f_j), 9) + 0.0 AS dv_z FROM d")
def grid_gradient(spark, folder):
    m = mesh(spark, folder).where("valid").select("i", "j", "z")
    return geometry.differences(m, [], ["z"]).select("i", "j", r("du_z", 9).alias("du_z"), r("dv_z", 9).alias("dv_z"))


def _ends_sql(c: str, axis: str, other: str) -> str:
    w = f"(PARTITION BY {other} ORDER BY {axis})"
    return f"CASE WHEN lag({c}) OVER {w} IS NULL THEN 2 * (lead({c}) OVER {w} - {c}) WHEN lead({c}) OVER {w} IS NULL THEN 2 * ({c} - lag({c}) OVER {w}) ELSE lead({c}) OVER {w} - lag({c}) OVER {w} END"


@query(
    f"""WITH d AS (SELECT i, j, {', '.join(f"{_ends_sql(c, 'j', 'i')} AS u{c}, {_ends_sql(c, 'i', 'j')} AS v{c}" for c in 'xyz')} FROM ({MESH})),
 n AS (SELECT i, j, uy * vz - uz * vy AS a, uz * vx - ux * vz AS b, ux * vy - uy * vx AS c FROM d)
 SELECT i, j, round(a / (sqrt(a * a + b * b + c * c) + 1e-9), 6) + 0.0 AS nx, round(b / (sqrt(a * a + b * b + c * c) + 1e-9), 6) + 0.0 AS ny, round(c / (sqrt(a * a + b * b + c * c) + 1e-9), 6) + 0.0 AS nz FROM n"""
)
def grid_normals(spark, folder):
    out = geometry.grid_normals(mesh(spark, folder), [])
    return out.select("i", "j", *[r(f"n{c}").alias(f"n{c}") for c in XYZ])


@query(
    f"""WITH m AS (SELECT * FROM ({MESH}) WHERE {VALID}), c AS (SELECT a.i, a.j, a.z AS z00, b.z AS z10, c.z AS z01, d.z AS z11 FROM m a JOIN m b ON b.i = a.i + 1 AND b.j = a.j JOIN m c ON c.i = a.i AND c.j = a.j + 1 JOIN m d ON d.i = a.i + 1 AND d.j = a.j + 1)
 SELECT i + p / 4.0::DOUBLE AS u, j + q / 4.0::DOUBLE AS v, 'cell' AS kind, round((1 - p / 4.0::DOUBLE) * (1 - q / 4.0::DOUBLE) * z00 + p / 4.0::DOUBLE * (1 - q / 4.0::DOUBLE) * z10 + (1 - p / 4.0::DOUBLE) * q / 4.0::DOUBLE * z01 + p / 4.0::DOUBLE * q / 4.0::DOUBLE * z11, 6) + 0.0 AS z FROM c, range(4) a(p), range(4) b(q)
 UNION ALL SELECT i::DOUBLE, j::DOUBLE, 'vertex', round(z, 6) + 0.0 FROM m"""
)
def densify_cells(spark, folder):
    out = geometry.densify_cells(mesh(spark, folder), [], 4, ["z"])
    return out.select("u", "v", "kind", r("z").alias("z"))


_WEIGHTS = "(VALUES " + ", ".join(f"({a}, {k}, {w!r}::DOUBLE)" for a, k, w in geometry.cubic_weights(2)) + ") w(a, k, w)"


@query(
    f"""WITH m AS MATERIALIZED (SELECT i, j, z FROM ({MESH})), e AS (SELECT max(i) AS il, max(j) AS jl FROM m),
 p AS MATERIALIZED (SELECT n.i * 2 + a AS v, m.j, sum(w * m.z) AS z FROM (SELECT range AS i FROM e, range(0, (il + 1)::BIGINT)) n, {_WEIGHTS}, e, m WHERE n.i < il AND m.i = least(greatest(n.i + k, 0), il) GROUP BY ALL)
 SELECT v::INT AS v, (n.j * 2 + a)::INT AS u, round(sum(w * p.z), 6) + 0.0 AS z FROM (SELECT range AS j FROM e, range(0, (jl + 1)::BIGINT)) n, {_WEIGHTS}, e, p WHERE n.j < jl AND p.j = least(greatest(n.j + k, 0), jl) GROUP BY ALL"""
)
def densify_cubic(spark, folder):
    """The mesh's z on a grid twice as fine, by the cubic spline through all nodes."""
    out = geometry.densify_cubic(mesh(spark, folder), [], 2, ["z"])
    return out.select("v", "u", r("z").alias("z"))


# a rotation of 30 degrees about z with a small shear, scale and translation
MATRIX = [[0.8, -0.5, 0.1, 12.0], [0.5, 0.9, 0.0, -7.5], [0.05, 0.0, 1.1, 3.25]]


@query(f"SELECT vec_id, " + ", ".join(f"round({row[0]} * x + {row[1]} * y + {row[2]} * z + {row[3]}, 6) + 0.0 AS a{c}" for row, c in zip(MATRIX, XYZ)) + f" FROM ({points_sql()})")
def affine_apply(spark, folder):
    p = points(spark, folder)
    return p.select("vec_id", *[r(c).alias(f"a{n}") for c, n in zip(geometry.affine_apply(MATRIX), XYZ)])


@query(f"SELECT vec_id, round(x, 6) + 0.0 AS bx, round(y, 6) + 0.0 AS by_, round(z, 6) + 0.0 AS bz FROM ({points_sql()})")
def affine_inverse(spark, folder):
    """The inverse of the applied map returns every point."""
    p = points(spark, folder)
    there = p.select("vec_id", *[c.alias(n) for c, n in zip(geometry.affine_apply(MATRIX), XYZ)])
    back = geometry.affine_apply(geometry.affine_invert(MATRIX))
    return there.select("vec_id", *[r(c).alias(n) for c, n in zip(back, ("bx", "by_", "bz"))])


@query(f"SELECT vec_id, round(x + 1.5, 6) + 0.0 AS cx, round(y - 2.0, 6) + 0.0 AS cy, round(z * 2, 6) + 0.0 AS cz FROM ({points_sql()})")
def affine_compose(spark, folder):
    """Composition of a map with the inverse of its shifted version, as used by refits."""
    shift_map = [[1, 0, 0, 1.5], [0, 1, 0, -2.0], [0, 0, 2, 0.0]]
    m = geometry.affine_compose(geometry.affine_compose(shift_map, geometry.affine_invert(MATRIX)), MATRIX)
    return points(spark, folder).select("vec_id", *[r(c).alias(n) for c, n in zip(geometry.affine_apply(m), ("cx", "cy", "cz"))])


@query("SELECT l_orderkey, l_linenumber, round_even((l_quantity - 0.25 + 0.5) * 2.4 - 0.5, 0)::INT AS iy, round_even((l_linenumber - -0.5 + 0.5) * 3 - 0.5, 0)::INT AS ix FROM lineitem")
def index_map(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select("l_orderkey", "l_linenumber", geometry.pixel_centre_index(F.col("l_quantity"), 2.4, 0.25).alias("iy"), geometry.pixel_centre_index(F.col("l_linenumber"), 3, -0.5).alias("ix"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Landmarks per label: moving = dimensions 0-2, fixed = dimensions 0-2 mapped plus a tenth of dimensions 3-5."""
    e = table(spark, folder, "embeddings")
    p = e.select("label", "vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(XYZ)], *[F.col("embedding")[3 + k].cast("double").alias(f"e{c}") for k, c in enumerate(XYZ)])
    mapped = geometry.affine_apply(MATRIX)
    return p.select("label", "vec_id", *XYZ, *[(m + 0.1 * F.col(f"e{c}")).alias(f"f{c}") for m, c in zip(mapped, XYZ)])


PAIRS1 = "SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[4]::DOUBLE AS f FROM embeddings"


def _pairs1(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[3].cast("double").alias("f"))


@query(f"SELECT label, count(*) AS n, round(regr_slope(f, x), 6) AS slope, round(regr_intercept(f, x), 6) AS intercept FROM ({PAIRS1}) GROUP BY label")
def affine_lsq(spark, folder):
    f = fits.fit_affine(_pairs1(spark, folder), ["label"], ["x"], ["f"])
    return f.select("label", "n", r("a_f_x").alias("slope"), r("t_f").alias("intercept"))


@query(
    f"""WITH p AS ({PAIRS1}), c AS (SELECT label, regr_slope(f, x) AS a, regr_intercept(f, x) AS b FROM p GROUP BY label), e AS (SELECT label, abs(f - a * x - b) AS e FROM p JOIN c USING (label)),
 l AS (SELECT q.label, q.vec_id, abs(any_value(q.f) - regr_slope(o.f, o.x) * any_value(q.x) - regr_intercept(o.f, o.x)) AS e FROM p q JOIN p o ON o.label = q.label AND o.vec_id <> q.vec_id GROUP BY ALL)
 SELECT e.label, count(*) AS n, round(sqrt(avg(e.e * e.e)), 6) AS rms, round(max(e.e), 6) AS max_res, round((SELECT sqrt(avg(l.e * l.e)) FROM l WHERE l.label = e.label), 6) AS loo_rms FROM e GROUP BY e.label"""
)
def loo_error(spark, folder):
    """Refit error and exact leave-one-out error of the one-dimensional fit (every left-out fit is redone in the SQL text)."""
    out = fits.landmark_errors(_pairs1(spark, folder), ["label"], ["x"], ["f"])
    return out.select("label", "n", r("rms").alias("rms"), r("max_res").alias("max_res"), r("loo_rms").alias("loo_rms"))


def _landmark_sql() -> str:
    """The 3-D fit per label by the inverse of the covariance; leverages give the leave-one-out errors."""
    fixed = ", ".join(f"{m[0]} * x + {m[1]} * y + {m[2]} * z + {m[3]} + 0.1 * e{c} AS f{c}, 0.1 * e{c} AS g{c}" for m, c in zip(MATRIX, XYZ))
    pairs = [(a, b) for k, a in enumerate(XYZ) for b in XYZ[k:]]
    moments = ", ".join([*(f"avg({c}) AS m{c}" for c in (*XYZ, "fx", "fy", "fz")), *(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in pairs), *(f"covar_pop({a}, f{d}) AS c{a}{d}" for a in XYZ for d in XYZ)])
    inverse = "(yy * zz - yz * yz) / det AS pxx, (xz * yz - xy * zz) / det AS pxy, (xy * yz - xz * yy) / det AS pxz, (xx * zz - xz * xz) / det AS pyy, (xy * xz - xx * yz) / det AS pyz, (xx * yy - xy * xy) / det AS pzz"
    entry = lambda a, b: f"p{min(a, b)}{max(a, b)}"
    slopes = ", ".join(f"{' + '.join(f'{entry(a, b)} * c{b}{d}' for b in XYZ)} AS a{d}{a}" for d in XYZ for a in XYZ)
    errors = " + ".join(f"pow(f{d} - mf{d} - ({' + '.join(f'a{d}{a} * ({a} - m{a})' for a in XYZ)}), 2)" for d in XYZ)
    lever = " + ".join(f"{entry(a, b)} * ({a} - m{a}) * ({b} - m{b})" for a in XYZ for b in XYZ)
    return f"""WITH e AS (SELECT label, {", ".join(f"embedding[{k + 1}]::DOUBLE AS {c}, embedding[{k + 4}]::DOUBLE AS e{c}" for k, c in enumerate(XYZ))} FROM embeddings), p AS (SELECT label, x, y, z, {fixed} FROM e),
 m AS (SELECT label, count(*) AS n, {moments} FROM p GROUP BY label), d AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM m), v AS (SELECT *, {inverse} FROM d), a AS (SELECT *, {slopes} FROM v),
 r AS (SELECT label, n, {errors} AS sq, (1 + {lever}) / n AS h, gx * gx + gy * gy + gz * gz AS pub FROM p JOIN a USING (label))
 SELECT label, any_value(n) AS n, round(sqrt(avg(pub)), 6) AS pub_rms, round(sqrt(max(pub)), 6) AS pub_max, round(sqrt(avg(sq)), 6) AS rms, round(sqrt(max(sq)), 6) AS max_res, round(sqrt(avg(sq / pow(1 - h, 2))), 6) AS loo_rms FROM r GROUP BY label"""


@query(_landmark_sql())
def landmark_residuals(spark, folder):
    """3-D affine fit per label: published map against refit, with leave-one-out error."""
    p = _pairs(spark, folder)
    fit = fits.landmark_errors(p, ["label"], XYZ, ["fx", "fy", "fz"])
    mapped = p.select("label", *[c.alias(f"p{n}") for c, n in zip(geometry.affine_apply(MATRIX), XYZ)], "fx", "fy", "fz")
    pub = fits.published_errors(mapped, ["label"], ["px", "py", "pz"], ["fx", "fy", "fz"])
    out = pub.join(fit, "label")
    return out.select("label", "n", *[r(c).alias(c) for c in ("pub_rms", "pub_max", "rms", "max_res", "loo_rms")])


@query(
    f"""WITH p AS ({PAIRS1}), c AS (SELECT label, regr_slope(f, x) AS a, regr_intercept(f, x) AS b, count(*) AS points FROM p GROUP BY label), e AS (SELECT p.*, abs(f - a * x - b) <= 0.15 AS keep, points FROM p JOIN c USING (label)),
 t AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY label) AS kept FROM e), u AS (SELECT * FROM t WHERE NOT (kept >= 3 AND kept < points) OR keep), g AS (SELECT label, regr_slope(f, x) AS a, regr_intercept(f, x) AS b, count(*) AS used FROM u GROUP BY label)
 SELECT g.label, any_value(u.points) AS points, any_value(u.kept) AS kept, any_value(used) AS used, round(any_value(a), 6) AS slope, round(any_value(b), 6) AS intercept, round(sqrt(avg((f - a * x - b) * (f - a * x - b))), 6) AS rms,
 CASE WHEN any_value(used) >= 8 AND sqrt(avg((f - a * x - b) * (f - a * x - b))) <= 0.08 THEN 'PLACE_OK' ELSE 'PLACE_FAIL' END AS verdict FROM u JOIN g USING (label) GROUP BY g.label"""
)
def affine_fit_trimmed(spark, folder):
    f = fits.trimmed_fit(_pairs1(spark, folder), ["label"], ["x"], ["f"], 0.15)
    out = verdicts.fitted_placement(f, rms_max=0.08)
    return out.select("label", "points", "kept", "used", r("a_f_x").alias("slope"), r("t_f").alias("intercept"), r("rms").alias("rms"), "verdict")


@query(
    """WITH m AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings), s AS (SELECT *, (a * a + b * b + c * c + d * d) / 2 AS h, a * d - b * c AS det FROM m)
 SELECT vec_id, round(sqrt(h + sqrt(greatest(h * h - det * det, 0))), 6) AS s1, round(sqrt(greatest(h - sqrt(greatest(h * h - det * det, 0)), 0)), 6) AS s2 FROM s"""
)
def scale_check(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("abcd")])
    s1, s2 = fits.singular_values_2x2(*[F.col(c) for c in "abcd"])
    return e.select("vec_id", r(s1).alias("s1"), r(s2).alias("s2"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:9], lambda v: v::DOUBLE * v::DOUBLE))), 6) AS frobenius FROM embeddings")
def scale_check_3d(spark, folder):
    """Singular values of 3x3 matrices; their root sum of squares is the Frobenius norm."""
    e = table(spark, folder, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double")).alias("m"))
    s = e.withColumn("s", fits.singular_values_3x3("m"))
    return s.select("vec_id", r(F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v))).alias("frobenius"))


@query(
    "SELECT label, count(*) AS n, " + ", ".join(f"round(covar_samp({a}, {b}), 9) + 0.0 AS c{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + f" FROM ({points_sql()}) GROUP BY label"
)
def pca_frame(spark, folder):
    f = fits.local_frame(points(spark, folder), ["label"], XYZ)
    return f.select("label", "n", *[r(F.col("cov")[k], 9).alias(f"c{p}") for k, p in enumerate(("xx", "yy", "zz", "xy", "xz", "yz"))])


_NN = f"""SELECT l.vec_id, l.label, min(sqrt((l.x - t.x) * (l.x - t.x) + (l.y - t.y) * (l.y - t.y) + (l.z - t.z) * (l.z - t.z))) AS distance, arg_min(t.tid, ((l.x - t.x) * (l.x - t.x) + (l.y - t.y) * (l.y - t.y) + (l.z - t.z) * (l.z - t.z), t.tid)) AS tid
 FROM ({points_sql()}) l, (SELECT * RENAME (vec_id AS tid) FROM ({points_sql(3)})) t GROUP BY l.vec_id, l.label"""


def _two_scans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The same items seen by two scans: dimensions 0-2 as queries, dimensions 3-5 as targets."""
    return points(spark, folder), points(spark, folder, 3, "tid").drop("label")


@query(f"SELECT vec_id, tid, round(distance, 9) AS distance FROM ({_NN})")
def nearest_one(spark, folder):
    q, t = _two_scans(spark, folder)
    return nearest.nearest(q, t, XYZ, "vec_id", "tid").withColumn("distance", r("distance", 9))


@query(f"SELECT vec_id, CASE WHEN distance <= 0.05 THEN tid END AS tid, CASE WHEN distance <= 0.05 THEN round(distance, 9) ELSE 0.05 END AS distance FROM ({_NN})")
def within_r(spark, folder):
    q, t = _two_scans(spark, folder)
    return nearest.within(q, t, XYZ, "vec_id", "tid", 0.05, clamp=True).withColumn("distance", r("distance", 9))


@query(f"SELECT vec_id FROM ({_NN}) WHERE distance <= 0.05")
def scope_semi(spark, folder):
    q, t = _two_scans(spark, folder)
    return nearest.scope(q, t, XYZ, "vec_id", "tid", 0.05).select("vec_id")


@query(f"SELECT label FROM ({_NN}) GROUP BY label HAVING min(distance) >= 0.006")
def guard_anti(spark, folder):
    """Labels none of whose points comes within 0.006 of a held-out point."""
    q, t = _two_scans(spark, folder)
    return nearest.guarded_groups(q, t, XYZ, "vec_id", "tid", "label", 0.006)


_UNION = f"""SELECT l.vec_id, t.label AS winding, least(min(sqrt((l.x - t.x) * (l.x - t.x) + (l.y - t.y) * (l.y - t.y) + (l.z - t.z) * (l.z - t.z))), 0.2) AS d FROM ({points_sql()}) l, ({points_sql(3)}) t GROUP BY ALL"""


def _winding_distances(spark: SparkSession, folder: str, cap: float = 0.2) -> DataFrame:
    """Distance of every point to every winding (label), clamped to ``cap``."""
    q, _ = _two_scans(spark, folder)
    t = points(spark, folder, 3, "tid").withColumnRenamed("label", "winding")
    kinds = t.agg(F.collect_set("winding")).scalar()
    each = q.select("vec_id", *XYZ, F.explode(kinds).alias("winding"))
    return nearest.within(each, t, XYZ, "vec_id", "tid", cap, ["winding"], clamp=True).select("vec_id", "winding", F.col("distance").alias("d"))


@query(f"WITH u AS ({_UNION}), m AS (SELECT vec_id, round(min(d), 9) AS d FROM u GROUP BY 1) SELECT round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(avg(CASE WHEN d < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS share FROM m")
def union_min_distance(spark, folder):
    q, _ = _two_scans(spark, folder)
    t = points(spark, folder, 3, "tid").select("tid", *XYZ)
    m = nearest.within(q.select("vec_id", *XYZ), t, XYZ, "vec_id", "tid", 0.2, [], clamp=True).select("vec_id", r("distance", 9).alias("d"))
    stats_ = ordered.percentiles(m, [], "d", {"median": 0.5, "p90": 0.9})
    share = m.agg(F.avg((F.col("d") < 0.05).cast("double")))
    return stats_.select(r("median").alias("median"), r("p90").alias("p90"), r(share.scalar(), 9).alias("share"))


@query(
    f"""WITH u AS (SELECT winding, round(d, 9) AS d FROM ({_UNION})), s AS (SELECT winding, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(avg(CASE WHEN d < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS share, min(d) AS lowest FROM u GROUP BY 1),
 k AS (SELECT *, row_number() OVER (ORDER BY median, winding) AS near_rank, row_number() OVER (ORDER BY winding) AS place FROM s), b AS (SELECT place AS bp, median AS bm FROM k WHERE near_rank = 1)
 SELECT winding, median, p90, share, lowest, near_rank, (near_rank <= 15 AND (median <= 0.06 OR share >= 0.30)) OR place BETWEEN bp - 2 AND bp + 2 AS chosen, CASE WHEN bm < 0.1 THEN 'MESH_REACHES' ELSE 'MESH_MISS' END AS gate FROM k, b"""
)
def winding_gate(spark, folder):
    d = stored(_winding_distances(spark, folder).withColumn("d", r("d", 9)), "distances")
    pct = ordered.percentiles(d, ["winding"], "d", {"median": 0.5, "p90": 0.9})
    agg = d.groupBy("winding").agg(r(F.avg((F.col("d") < 0.05).cast("double")), 9).alias("share"), F.min("d").alias("lowest"))
    s = pct.join(agg, "winding").withColumns({c: r(c) for c in ("median", "p90")})
    return verdicts.known_text_gate(s, "winding", "median", "share", median_max=0.06, share_min=0.30, reach=0.1).drop("place")


@query("SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey)::INT AS shared FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(DISTINCT a.l_orderkey) >= 2")
def overlap_pairs(spark, folder):
    li = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey")
    return nearest.shared_group_pairs(li, "l_partkey", "l_orderkey", 2).withColumn("shared", F.col("shared").cast("int"))


@query(
    """WITH RECURSIVE e0 AS (SELECT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(DISTINCT a.l_orderkey) >= 3),
 e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0), r AS (SELECT DISTINCT a AS node, a AS lab FROM e UNION SELECT e.b, r.lab FROM r JOIN e ON e.a = r.node WHERE r.lab < e.b)
 SELECT node, min(lab) AS component FROM r GROUP BY node"""
)
def frame_components(spark, folder):
    li = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey")
    return components.graph_components(nearest.shared_group_pairs(li, "l_partkey", "l_orderkey", 3))


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.dayofmonth("ts").cast("double").alias("z")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))


@query(
    """WITH c AS (SELECT event_type, day(ts)::DOUBLE AS z, avg(value) AS v, count(*)::DOUBLE AS n FROM events GROUP BY ALL), q AS (SELECT event_id, event_type, day(ts) + hour(ts) / 24.0::DOUBLE AS z FROM events),
 k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY z) AS i, count(*) OVER (PARTITION BY event_type) AS m FROM c),
 s AS (SELECT q.event_id, q.event_type, q.z, least(greatest((SELECT count(*) FROM c WHERE c.event_type = q.event_type AND c.z <= q.z), 1), greatest((SELECT count(*) FROM c WHERE c.event_type = q.event_type) - 1, 1)) AS i FROM q)
 SELECT s.event_id, round(a.v + (b.v - a.v) * ((s.z - a.z) / (b.z - a.z)), 6) AS v, round(a.n + (b.n - a.n) * ((s.z - a.z) / (b.z - a.z)), 6) AS n FROM s JOIN k a ON a.event_type = s.event_type AND a.i = s.i JOIN k b ON b.event_type = s.event_type AND b.i = s.i + 1"""
)
def axis_interp(spark, folder):
    """Control points = daily mean value; each event reads the axis at its own time (extrapolated on the last day)."""
    e = table(spark, folder, "events")
    cps = _daily(spark, folder)
    q = e.select("event_id", "event_type", (F.dayofmonth("ts") + F.hour("ts") / 24.0).alias("z"))
    out = geometry.interpolate_axis(cps, q, ["event_type"], "z", ["v", "n"], "event_id")
    return out.select("event_id", r("v").alias("v"), r("n").alias("n"))


@query(f"WITH d AS (SELECT round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9) AS d FROM ({points_sql()}) a JOIN ({points_sql(3)}) b USING (vec_id)) SELECT round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.99), 6) AS p99, count(*) AS n FROM d")
def mesh_round_trip(spark, folder):
    out = geometry.round_trip(points(spark, folder), points(spark, folder, 3), [], ["vec_id"])
    return out.select(r("median").alias("median"), r("p99").alias("p99"), "n")


@query(f"WITH d AS (SELECT a.label, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) * 2.4, 9) AS d FROM ({points_sql()}) a JOIN ({points_sql(3)}) b USING (vec_id)) SELECT label, round(quantile_cont(d, 0.5), 6) AS median_um, round(quantile_cont(d, 0.9), 6) AS p90_um, round(max(d), 6) AS max_um FROM d GROUP BY label")
def displacement(spark, folder):
    a, b = points(spark, folder), points(spark, folder, 3)
    out = experiments.displacement(a, b, ["label"], ["vec_id"], 2.4)
    return out.select("label", *[r(c).alias(c) for c in ("median_um", "p90_um", "max_um")])


@query(f"SELECT round(quantile_cont(tid - vec_id * 2.0, 0.5), 6) AS row_offset, round(quantile_cont(tid % 16 - vec_id % 16 * 1.0, 0.5), 6) + 0.0 AS col_offset FROM ({_NN})")
def mesh_index_offset(spark, folder):
    q, t = _two_scans(spark, folder)
    hit = nearest.nearest(q, t, XYZ, "vec_id", "tid")
    pairs = hit.select(F.col("tid").alias("fi"), F.pmod("tid", F.lit(16)).alias("fj"), F.col("vec_id").alias("ai"), F.pmod("vec_id", F.lit(16)).alias("aj"))
    out = geometry.index_offset(pairs, [], F.lit(2.0), F.lit(1.0))
    return out.select(r("row_offset").alias("row_offset"), r("col_offset").alias("col_offset"))


@query(
    """WITH g AS (SELECT vec_id AS y, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding) > 0 AS v FROM embeddings), a AS (SELECT * FROM g WHERE x < 32), b AS (SELECT y, x - 32 AS x, v FROM g WHERE x >= 32),
 s AS (SELECT dy, dx, count(*) AS n, avg(CASE WHEN a.v = b.v THEN 1.0 ELSE 0.0 END) AS share FROM a, generate_series(-3, 3) t(dy), generate_series(-3, 3) u(dx), b WHERE b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL)
 SELECT dy::INT AS dy, dx::INT AS dx, round(share, 9) AS agreement, round((SELECT share FROM s WHERE dy = 0 AND dx = 0), 9) AS agreement0 FROM s ORDER BY round(share, 9) DESC, dy, dx LIMIT 1"""
)
def grid_agreement(spark, folder):
    g = grid(spark, folder).withColumn("valid", F.col("v") > 0)
    a = g.where("x < 32").select("y", "x", "valid")
    b = g.where("x >= 32").select("y", (F.col("x") - 32).alias("x"), "valid")
    out = shift.grid_agreement(a, b, [], 3)
    return out.select("dy", "dx", r("agreement", 9).alias("agreement"), r("agreement0", 9).alias("agreement0"))


def _holes_sql(c: str, axis: str, other: str) -> str:
    w = f"(PARTITION BY seg, {other} ORDER BY {axis})"
    back, ahead = f"CASE WHEN lag({axis}) OVER {w} = {axis} - 1 THEN {c} - lag({c}) OVER {w} END", f"CASE WHEN lead({axis}) OVER {w} = {axis} + 1 THEN lead({c}) OVER {w} - {c} END"
    return f"coalesce(({back} + {ahead}) / 2, {back}, {ahead})"


def _carry_sql() -> str:
    """Each vertex, moved by less than 0.04, meets its nearest vertex within that distance; then the 2 x 2 solve there."""
    dot = lambda p, q: " + ".join(f"{p}{c} * {q}{c}" for c in XYZ)
    slopes = ", ".join(f"{_holes_sql(c, 'i', 'j')} AS u{c}, {_holes_sql(c, 'j', 'i')} AS v{c}" for c in XYZ)
    return f"""WITH m AS MATERIALIZED (SELECT *, 0 AS seg FROM ({MESH}) WHERE {VALID}), g AS MATERIALIZED (SELECT i, j, x, y, z, {slopes} FROM m), q AS (SELECT i, j, x + 0.03 AS x, y + 0.02 AS y, z FROM m),
 h AS (SELECT q.i, q.j, any_value(q.x) AS x, any_value(q.y) AS y, any_value(q.z) AS z, arg_min({{'i': g.i, 'j': g.j}}, (pow(q.x - g.x, 2) + pow(q.y - g.y, 2) + pow(q.z - g.z, 2), g.i, g.j)) AS n
  FROM q JOIN g ON g.x BETWEEN q.x - 0.04 AND q.x + 0.04 AND g.y BETWEEN q.y - 0.04 AND q.y + 0.04 AND g.z BETWEEN q.z - 0.04 AND q.z + 0.04 GROUP BY q.i, q.j),
 d AS (SELECT h.i, h.j, n.i AS ni, n.j AS nj, h.x - g.x AS dx, h.y - g.y AS dy, h.z - g.z AS dz, {", ".join(f"u{c}, v{c}" for c in XYZ)} FROM h JOIN g ON g.i = n.i AND g.j = n.j),
 o AS (SELECT *, {dot("u", "u")} AS uu, {dot("u", "v")} AS uv, {dot("v", "v")} AS vv, {dot("u", "d")} AS ud, {dot("v", "d")} AS vd FROM d), e AS (SELECT *, CASE WHEN abs(uu * vv - uv * uv) > 1e-12 THEN uu * vv - uv * uv END AS det FROM o),
 s AS (SELECT *, (vv * ud - uv * vd) / det AS su, (uu * vd - uv * ud) / det AS sv FROM e), r AS (SELECT *, sqrt({" + ".join(f"pow(d{c} - su * u{c} - sv * v{c}, 2)" for c in XYZ)}) AS res FROM s),
 c AS (SELECT i, j, ni + su AS u, nj + sv AS v, res, coalesce(abs(su) <= 1 AND abs(sv) <= 1 AND res <= 0.2, false) AS carried FROM r)
 SELECT i, j, round(u, 6) AS u, round(c.v, 6) AS v, round(res, 6) AS residual, carried, carried AND k.y IS NOT NULL AS label FROM c LEFT JOIN (SELECT y, x FROM ({GRID}) WHERE v > 0.1) k ON k.y = round_even(2 * u, 0) AND k.x = round_even(2 * c.v, 0)"""


@query(_carry_sql())
def label_carry(spark, folder):
    """Points of the second scan carried to the mesh of the first: sub-cell positions and labels."""
    m = mesh(spark, folder)
    q = m.where("valid").select(F.struct("i", "j").alias("qid"), (F.col("x") + 0.03).alias("x"), (F.col("y") + 0.02).alias("y"), "z")
    pos = geometry.carry_positions(q, m, "qid", max_residual=0.2)
    mask = grid(spark, folder).where("v > 0.1").select("y", "x")
    out = geometry.carry_labels(pos, mask, per_cell=2)
    return out.select("qid.i", "qid.j", r("u").alias("u"), r("v").alias("v"), r("residual").alias("residual"), "carried", "label")


@query(
    f"""WITH m AS (SELECT *, i // 50 AS seg FROM ({MESH}) WHERE {VALID}), d AS (SELECT seg, {", ".join(f"{_holes_sql(c, 'i', 'j')} AS u{c}, {_holes_sql(c, 'j', 'i')} AS v{c}" for c in "xyz")} FROM m),
 g AS (SELECT seg, ux * ux + uy * uy + uz * uz AS uu, vx * vx + vy * vy + vz * vz AS vv, ux * vx + uy * vy + uz * vz AS uv FROM d),
 s AS (SELECT seg, (uu + vv) / 2 AS half, sqrt(pow((uu - vv) / 2, 2) + uv * uv) AS root FROM g)
 SELECT seg::INT AS seg, round(quantile_cont(sqrt(half + root), 0.5), 6) AS s1, round(quantile_cont(sqrt(greatest(half - root, 0)), 0.5), 6) AS s2 FROM s GROUP BY seg"""
)
def local_scale(spark, folder):
    m = mesh(spark, folder).withColumn("seg", F.floor(F.col("i") / 50).cast("int"))
    out = geometry.local_scale(m, ["seg"])
    return out.select("seg", r("s1").alias("s1"), r("s2").alias("s2"))


@query(
    f"""WITH p AS MATERIALIZED (SELECT *, label % 3 AS own FROM ({points_sql()})), f AS (SELECT DISTINCT own AS fold FROM p),
 d AS (SELECT f.fold, a.label AS segment, a.vec_id AS patch, any_value(a.x) AS x, min(sqrt((a.x - h.x) * (a.x - h.x) + (a.y - h.y) * (a.y - h.y) + (a.z - h.z) * (a.z - h.z))) AS min_distance
  FROM f JOIN p a ON a.own <> f.fold JOIN p h ON h.own = f.fold GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY fold, segment ORDER BY x DESC, patch) AS rn FROM d WHERE min_distance >= 0.05)
 SELECT fold, segment, patch, round(min_distance, 6) AS min_distance FROM k WHERE rn <= 12"""
)
def guarded_plan(spark, folder):
    """Fold plan with leakage guard: folds hold out label mod 3, patches are the vectors of other labels that stay clear of every
    held-out point, the twelve with the largest first component per label and fold."""
    from voxtable.operators.select import guarded_fold_plan

    p = points(spark, folder).withColumn("segment", F.col("label")).withColumn("own", F.pmod("label", F.lit(3)))
    folds = F.explode(F.array(*[F.lit(k) for k in range(3)]))
    patches = p.select(folds.alias("fold"), F.col("vec_id").alias("patch"), "segment", "x")
    vertices = p.select(F.col("vec_id").alias("patch"), F.lit(0).alias("vid"), *XYZ)
    held = p.select(F.col("own").alias("fold"), F.col("vec_id").alias("hid"), "segment", *XYZ)
    out = guarded_fold_plan(patches, vertices, held, 0.05, 12, XYZ, [-F.col("x")])
    return out.select("fold", "segment", "patch", r("min_distance").alias("min_distance"))


@query(
    f"""WITH m AS (SELECT * FROM ({MESH}) WHERE {VALID} AND j >= 2 AND j < 14), k AS (SELECT *, row_number() OVER (ORDER BY i, j) - 1 AS r, count(*) OVER () AS n FROM m), g AS (SELECT DISTINCT floor(t.k * ((n - 1) / 499.0)) AS r FROM k, range(500) t(k) WHERE k.r = 0),
 c AS (SELECT x, y, z FROM k WHERE n <= 500 OR r IN (SELECT r FROM g)), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM c)
 SELECT (SELECT count(*) FROM c) AS claimed, count(*) AS near FROM ({points_sql(3)}) t, b WHERE x BETWEEN lx - 0.1 AND hx + 0.1 AND y BETWEEN ly - 0.1 AND hy + 0.1 AND z BETWEEN lz - 0.1 AND hz + 0.1"""
)
def claim_box(spark, folder):
    """Claim points of twelve mesh columns (five hundred, evenly spaced) and the second-scan points near their extent."""
    m = mesh(spark, folder)
    claim = geometry.claim_points(m, 0, 10**9, 2, 14, 500)
    near = geometry.near_extent(points(spark, folder, 3), claim, 0.1)
    return near.agg(F.count(F.lit(1)).alias("near")).withColumn("claimed", claim.agg(F.count(F.lit(1))).scalar())


_BANDS = f"""m AS MATERIALIZED (SELECT i, j, x, floor((z + 2) * 1000)::BIGINT AS z, CASE WHEN y > j * 0.1 THEN 1.0 ELSE 0.0 END AS ink FROM ({MESH})),
 wt AS (SELECT z, sum(abs(x)) AS w FROM m GROUP BY z), cum AS (SELECT z, sum(w) OVER (ORDER BY z) / sum(w) OVER () AS share FROM wt),
 e AS (SELECT (round_even(min(z) FILTER (share >= 1 / 3.0::DOUBLE) / 10.0, 0) * 10)::BIGINT - 200 AS lower, (round_even(min(z) FILTER (share >= 2 / 3.0::DOUBLE) / 10.0, 0) * 10)::BIGINT + 200 AS upper FROM cum),
 c AS (SELECT a.i AS y, a.j AS x, least(a.z, b.z, c.z, d.z) AS lo, greatest(a.z, b.z, c.z, d.z) AS hi, a.ink FROM m a JOIN m b ON b.i = a.i + 1 AND b.j = a.j JOIN m c ON c.i = a.i AND c.j = a.j + 1 JOIN m d ON d.i = a.i + 1 AND d.j = a.j + 1),
 k AS (SELECT y, x, ink, CASE WHEN lo < lower THEN 0 WHEN lo < upper THEN 1 ELSE 2 END AS band FROM c, e WHERE CASE WHEN lo < lower THEN 0 WHEN lo < upper THEN 1 ELSE 2 END = CASE WHEN hi < lower THEN 0 WHEN hi < upper THEN 1 ELSE 2 END),
 b AS MATERIALIZED (SELECT a.band, a.y, a.x, sum(o.ink) / 4 AS density, row_number() OVER (PARTITION BY a.band ORDER BY sum(o.ink) / 4 DESC, a.y, a.x) AS rk FROM k a JOIN k o ON o.band = a.band AND o.y BETWEEN a.y AND a.y + 1 AND o.x BETWEEN a.x AND a.x + 1 GROUP BY a.band, a.y, a.x HAVING count(*) = 4 AND sum(o.ink) > 0)"""


@query(
    f"""WITH RECURSIVE {_BANDS}, walk AS (SELECT band, rk, y, x, density, [[y, x]] AS taken, 1 AS pick FROM b WHERE rk = 1
 UNION ALL SELECT n.band, n.rk, n.y, n.x, n.density, n.taken, n.pick FROM (SELECT b.band, b.rk, b.y, b.x, b.density, list_append(w.taken, [b.y, b.x]) AS taken, w.pick + 1 AS pick, row_number() OVER (PARTITION BY b.band ORDER BY b.rk) AS first
  FROM walk w JOIN b ON b.band = w.band AND b.rk > w.rk WHERE w.pick < 6 AND len(list_filter(w.taken, lambda t: abs(t[1] - b.y) < 2 AND abs(t[2] - b.x) < 2)) = 0) n WHERE n.first = 1)
 SELECT band::INT AS band, pick, y, x, round(density, 6) AS density FROM walk"""
)
def band_plan(spark, folder):
    """Mesh cells in z bands (terciles weighted by the first component), the six 2 x 2 windows per band with the most ink."""
    from voxtable.operators import select

    m = mesh(spark, folder)
    ink = m.select("i", "j", "x", F.when(F.col("y") > F.col("j") * 0.1, 1.0).otherwise(0.0).alias("ink"))
    cells = geometry.cell_corners(m.withColumn("valid", F.lit(True)), [], ["z"]).join(ink, ["i", "j"])
    w = m.select(F.floor((F.col("z") + 2) * 1000).alias("z"), F.abs("x").alias("w"))
    e = select.weighted_tercile_edges(w, [], "z", "w")
    scaled = cells.select(F.col("i").alias("y"), F.col("j").alias("x"), *[F.floor((F.col(c) + 2) * 1000).alias(c) for c in ("min_z", "max_z")], "ink")
    wide = e.select((F.col("lower") - 200).alias("lower"), (F.col("upper") + 200).alias("upper"))
    out = select.band_plan(scaled, [], wide, "ink", 2, 6)
    return out.select("band", "pick", "y", "x", r("density").alias("density"))
