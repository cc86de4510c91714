"""Raster, histogram and profile queries: embeddings as an image (row = vec_id, column = dimension), lines as layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.catalog import Registry
from voxtable.catalog.tables import GRID, grid, r, table
from voxtable.functions import columns as fx
from voxtable.operators import components, distance, nearest, profile, raster, select, stats
from voxtable.sources import readers

REGISTRY = Registry()
query = REGISTRY.query

STACK = f"SELECT (x // 16)::INT AS layer, y, (x % 16)::INT AS x, least(greatest(round_even(128 + 300 * v, 0), 0), 255)::INT AS v FROM ({GRID})"


def stack(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as four layers of 16 columns: layer = dimension div 16, uint8 values."""
    g = grid(spark, folder)
    v = F.least(F.greatest(F.rint(128 + 300 * F.col("v")), F.lit(0.0)), F.lit(255.0)).cast("int")
    return g.select(F.floor(F.col("x") / 16).cast("int").alias("layer"), "y", F.pmod("x", F.lit(16)).cast("int").alias("x"), v.alias("v"))


_HIST = """h AS (SELECT l_returnflag AS layer, l_linestatus AS side, l_quantity::INT AS v, count(*) AS n FROM lineitem GROUP BY ALL),
 d AS (SELECT k.layer, k.side, b.v::INT AS v, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT layer, side FROM h) k CROSS JOIN range(256) b(v) LEFT JOIN h ON h.layer = k.layer AND h.side = k.side AND h.v = b.v),
 c AS (SELECT *, sum(n) OVER (PARTITION BY layer, side ORDER BY v) / sum(n) OVER (PARTITION BY layer, side) AS cdf FROM d),
 lut AS (SELECT s.layer, s.v, least(greatest(coalesce(min(f.v), 255), 1), 255)::INT AS v2 FROM c s LEFT JOIN c f ON f.layer = s.layer AND f.side = 'F' AND f.cdf >= s.cdf WHERE s.side = 'O' GROUP BY ALL)"""


def _hists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("layer"), "l_linestatus", F.col("l_quantity").cast("int").alias("v"))
    src, ref = li.where("l_linestatus = 'O'"), li.where("l_linestatus = 'F'")
    return src, stats.histogram(src, ["layer"], "v"), stats.histogram(ref, ["layer"], "v")


@query("WITH h AS (SELECT l_returnflag AS layer, l_linestatus AS side, l_quantity::INT AS v, count(*) AS n FROM lineitem GROUP BY ALL) SELECT k.layer, k.side, b.v::INT AS v, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT layer, side FROM h) k CROSS JOIN range(256) b(v) LEFT JOIN h ON h.layer = k.layer AND h.side = k.side AND h.v = b.v")
def histogram(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("layer"), F.col("l_linestatus").alias("side"), F.col("l_quantity").cast("int").alias("v"))
    return stats.histogram(li, ["layer", "side"], "v")


@query("SELECT o_orderpriority, count(*) AS pixels, count(*) FILTER (u8 = 0) AS dark, count(*) FILTER (u8 = 255) AS bright, sum(u8) AS total FROM (SELECT o_orderpriority, trunc(least(greatest((o_totalprice - lo) / (hi - lo), 0), 1) * 255)::INT AS u8 FROM orders JOIN (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders GROUP BY 1) USING (o_orderpriority)) GROUP BY 1")
def stretch_percentile(spark, folder):
    """Contrast stretch between the first and the last percentile of each image (here of each order priority)."""
    o = table(spark, folder, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("v"))
    u = stats.stretch_between(o, ["o_orderpriority"], "v", 0.01, 0.99)
    return u.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("u8") == 0).alias("dark"), F.count_if(F.col("u8") == 255).alias("bright"), F.sum("u8").alias("total"))


@query(f"SELECT layer, count(*) AS pixels, min(y)::INT AS y0, max(y)::INT AS y1 FROM ({STACK}) WHERE v > 140 AND y >= 3 AND y < 40 AND x >= 2 AND x < 11 GROUP BY layer")
def label_region(spark, folder):
    """Label pixels of a half-open region, per layer."""
    mask = stack(spark, folder).where("v > 140")
    return readers.mask_region(mask, 3, 40, 2, 11).groupBy("layer").agg(F.count(F.lit(1)).alias("pixels"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query(f"WITH {_HIST} SELECT layer, v, v2 FROM lut")
def hist_match_lut(spark, folder):
    _, a, b = _hists(spark, folder)
    return stats.histogram_lut(a, b, ["layer"])


@query(
    f"""WITH {_HIST}, p AS (SELECT l_returnflag AS layer, CASE WHEN l_discount > 0.01 THEN lut.v2 ELSE 0 END AS v FROM lineitem JOIN lut ON lut.layer = l_returnflag AND lut.v = l_quantity::INT WHERE l_linestatus = 'O')
 SELECT layer, v, count(*) AS n FROM p GROUP BY ALL"""
)
def lut_remap(spark, folder):
    _, a, b = _hists(spark, folder)
    li = table(spark, folder, "lineitem").where("l_linestatus = 'O'").select(F.col("l_returnflag").alias("layer"), F.col("l_quantity").cast("int").alias("v"), (F.col("l_discount") > 0.01).alias("inside"))
    return stats.remap(li, stats.histogram_lut(a, b, ["layer"]), ["layer"], "v", "inside").groupBy("layer", "v").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_HIST} SELECT layer, min(v) FILTER (cdf >= 0.05) AS p05, min(v) FILTER (cdf >= 0.5) AS p50, min(v) FILTER (cdf >= 0.95) AS p95 FROM c WHERE side = 'O' GROUP BY layer")
def layer_percentiles(spark, folder):
    return stats.histogram_percentile(_hists(spark, folder)[1], ["layer"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})


@query(f"SELECT (y // 8)::INT AS by, (x // 8)::INT AS bx, round(avg(v), 6) AS mean, count(*) AS cells FROM ({GRID}) GROUP BY ALL HAVING count(*) = 64")
def block_mean(spark, folder):
    return stats.block_mean(grid(spark, folder), [], "y", "x", "v", 8).withColumn("mean", r("mean"))


@query(f"SELECT y, x, bool_or(v > 170) AS covered FROM ({STACK}) GROUP BY ALL")
def coverage_any(spark, folder):
    s = stack(spark, folder).withColumn("v", F.col("v") - 170)
    return s.groupBy("y", "x").agg(stats.layer_any("v").alias("covered"))


@query(
    f"""WITH c AS (SELECT y // 4 AS y, x // 4 AS x, bool_or(v > 200) AS covered FROM ({STACK}) GROUP BY ALL), e AS (SELECT max(y) AS ym, max(x) AS xm FROM c)
 SELECT g.y AS i, g.x AS j, coalesce(c.covered, false) AS covered FROM ({GRID}) g CROSS JOIN e LEFT JOIN c ON c.y = least(floor(g.y * 10 / 32.0), ym) AND c.x = least(floor(g.x * 10 / 32.0), xm)"""
)
def coverage_lookup(spark, folder):
    from voxtable.operators.chunks import surface_coverage

    s = stack(spark, folder).select("layer", F.floor(F.col("y") / 4).cast("int").alias("y"), F.floor(F.col("x") / 4).cast("int").alias("x"), (F.col("v") - 200).alias("v"))
    cells = grid(spark, folder).select(F.col("y").alias("i"), F.col("x").alias("j"))
    return surface_coverage(s, [], 10, 32, cells)


@query(f"SELECT y, x, bool_and(v > 110) AND count(DISTINCT layer) = 4 AS kept FROM ({STACK}) GROUP BY ALL")
def mask_all(spark, folder):
    s = stack(spark, folder).withColumn("v", F.col("v") - 110)
    return s.groupBy("y", "x").agg(stats.layer_all("v", "layer", 4).alias("kept"))


@query(f"SELECT y, x, CASE WHEN v > -0.2 THEN trunc(least(greatest((v - 0.25 + 0.25) / 0.5, 0), 1) * 255)::INT ELSE 0 END AS u8 FROM ({GRID})")
def stretch_u8(spark, folder):
    g = grid(spark, folder)
    return g.select("y", "x", fx.stretch_u8("v", F.col("v") > -0.2, lo=0.0).alias("u8"))


@query(
    """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), u AS (SELECT *, greatest(sqrt(a * a + b * b + c * c), 1e-9) AS n FROM e)
 SELECT vec_id, CASE WHEN n > 0.1 THEN least(greatest(round_even(c / n * CASE WHEN a / n < 0 THEN -1.0 ELSE 1.0 END * 127 + 128, 0), 0), 255)::INT ELSE 0 END AS ex,
 CASE WHEN n > 0.1 THEN least(greatest(round_even(b / n * CASE WHEN a / n < 0 THEN -1.0 ELSE 1.0 END * 127 + 128, 0), 0), 255)::INT ELSE 0 END AS ey FROM u"""
)
def normal_encode(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("abc")])
    nz, ny, nx = fx.unit(["a", "b", "c"])
    e = e.withColumns({"nz": nz, "ny": ny, "nx": nx, "ok": fx.norm(["a", "b", "c"]) > 0.1})
    return e.select("vec_id", fx.encode_normal("nz", "nx", "ok").alias("ex"), fx.encode_normal("nz", "ny", "ok").alias("ey"))


@query(
    f"""WITH b AS (SELECT y // 4 AS "by", x // 4 AS bx, avg(CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END) AS share, count(*) = 16 AS f FROM ({GRID}) GROUP BY ALL),
 d AS (SELECT a."by", a.bx, bool_or(sqrt((a."by" - i."by") * (a."by" - i."by") + (a.bx - i.bx) * (a.bx - i.bx)) <= 2.5) AS near FROM b a, (SELECT * FROM b WHERE share >= 0.5) i GROUP BY ALL)
 SELECT b."by"::INT AS "by", b.bx::INT AS bx, CASE WHEN f AND share >= 0.5 THEN 'pos' WHEN f AND share < 0.05 AND coalesce(near, false) THEN 'neg' END AS class FROM b LEFT JOIN d ON d."by" = b."by" AND d.bx = b.bx"""
)
def class_map(spark, folder):
    """Label classes of 4 x 4 blocks: ink blocks, and clean blocks within 2.5 blocks of ink (bounded nearest join)."""
    g = grid(spark, folder).withColumn("ink", (F.col("v") > 0.1).cast("int"))
    b = stats.block_mean(g, [], "y", "x", "ink", 4, full_only=False, name="share").withColumn("id", F.struct("by", "bx"))
    ink = b.where("share >= 0.5").select(F.col("id").alias("ink_id"), "by", "bx")
    d = nearest.within(b, ink, ["by", "bx"], "id", "ink_id", 2.5).select("id", F.col("ink_id").isNotNull().alias("near"))
    j = b.join(d, "id")
    return j.select("by", "bx", fx.label_class("share", F.col("cells") == 16, "near").alias("class"))


@query(f"SELECT y, x, CASE WHEN v >= 0.16 THEN 1 WHEN v <= 0.05 THEN 0 ELSE -1 END AS class FROM ({GRID})")
def teacher_class(spark, folder):
    return grid(spark, folder).select("y", "x", fx.teacher_class(F.col("v") * 1000, 160, 50).alias("class"))


@query(f"WITH g AS ({GRID}), t AS (SELECT y, x FROM g WHERE v > 0.25) SELECT a.y, a.x, round(sqrt(min((a.y - t.y) * (a.y - t.y) + (a.x - t.x) * (a.x - t.x))), 6) AS distance FROM g a, t GROUP BY ALL")
def distance_transform(spark, folder):
    """Distance of every pixel to the nearest TRUE one."""
    g = grid(spark, folder).select("y", "x", (F.col("v") > 0.25).alias("lit"))
    return distance.distance_transform(g, [], "lit").select("y", "x", r("distance").alias("distance"))


@query(
    f"""WITH g AS ({GRID}) SELECT y, x, round(sum(v) OVER w / 20, 6) AS mean, max(v) OVER w AS max FROM (SELECT a.y, a.x, b.v, 1 AS k FROM g a JOIN g b ON b.y BETWEEN a.y - 2 AND a.y + 1 AND b.x BETWEEN a.x - 2 AND a.x + 2) WINDOW w AS (PARTITION BY y, x)
 QUALIFY row_number() OVER (PARTITION BY y, x) = 1"""
)
def box_mean_max(spark, folder):
    """4 x 5 box around each pixel: mean with zero outside, and maximum."""
    g = grid(spark, folder)
    out = raster.box_sum(g, [], 4, 5, {"mean": F.sum, "max": F.max}, {"mean": "v", "max": "v"})
    return out.select("y", "x", r(F.col("mean") / 20).alias("mean"), "max")


@query(
    f"""WITH g AS (SELECT y, x, (v > -0.1)::INT AS b FROM ({GRID})), e AS (SELECT a.y, a.x, CASE WHEN count(*) = 9 THEN min(b.b) ELSE 0 END AS e FROM g a JOIN g b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL),
 o AS (SELECT a.y, a.x, max(b.e) AS opened FROM e a JOIN e b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL) SELECT y, x, opened FROM o"""
)
def opening_box(spark, folder):
    g = grid(spark, folder).select("y", "x", (F.col("v") > -0.1).cast("int").alias("b"))
    return raster.box_opening(g, [], "b", 3).select("y", "x", "opened")


@query(
    f"""WITH g AS (SELECT y, x, (v > -0.1)::INT AS b FROM ({GRID})), e AS (SELECT a.y, a.x, CASE WHEN count(*) = 9 THEN min(b.b) ELSE 0 END AS e FROM g a JOIN g b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL),
 o AS (SELECT a.y, a.x, max(b.e) AS opened FROM e a JOIN e b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL)
 SELECT count(*) AS valid, count(*) FILTER (b = 1 AND opened = 0) AS thin, round(count(*) FILTER (b = 1 AND opened = 0) / count(*), 9) AS share FROM g JOIN o USING (y, x)"""
)
def stroke_share(spark, folder):
    g = grid(spark, folder).select("y", "x", (F.col("v") > -0.1).alias("b"))
    return components.stroke_share(g, [], "b", 3).withColumn("share", r("share", 9))


_L1 = "abs(a.y - b.y) + abs(a.x - b.x) <= 2"


@query(f"WITH g AS (SELECT y, x, v > -0.2 AS m FROM ({GRID})) SELECT a.y, a.x, count(*) FILTER (b.m) = 13 AS eroded FROM g a JOIN g b ON b.y BETWEEN a.y - 2 AND a.y + 2 AND {_L1} GROUP BY ALL")
def cross_erosion(spark, folder):
    g = grid(spark, folder).select("y", "x", (F.col("v") > -0.2).alias("m"))
    return raster.cross_erosion(g, [], "m", 2)


@query(
    f"""WITH g AS (SELECT y, x, v > 0.2 AS m FROM ({GRID})), d AS (SELECT a.y, a.x, bool_or(b.m) AS m FROM g a JOIN g b ON b.y BETWEEN a.y - 2 AND a.y + 2 AND {_L1} GROUP BY ALL)
 SELECT a.y, a.x, count(*) FILTER (b.m) = 13 AS closed FROM d a JOIN d b ON b.y BETWEEN a.y - 2 AND a.y + 2 AND {_L1} GROUP BY ALL"""
)
def cross_closing(spark, folder):
    g = grid(spark, folder).select("y", "x", (F.col("v") > 0.2).alias("m"))
    return raster.cross_closing(g, [], "m", 2)


def _taps(sigma: float) -> str:
    w = stats.gaussian_taps(sigma)
    return "(VALUES " + ", ".join(f"({k - len(w) // 2}, {v!r}::DOUBLE)" for k, v in enumerate(w)) + ") t(d, w)"


@query(f"WITH g AS ({GRID}) SELECT g.y, (g.x + t.d)::INT AS x, round(sum(g.v * t.w), 6) + 0.0 AS smooth FROM g, {_taps(1.0)} WHERE g.x + t.d BETWEEN 0 AND 63 GROUP BY ALL")
def gaussian_smooth(spark, folder):
    """1-D Gaussian along each embedding, zero outside."""
    out = stats.smooth_profile(grid(spark, folder), ["y"], "x", "v", stats.gaussian_taps(1.0), "smooth")
    return out.select("y", "x", r("smooth").alias("smooth"))


@query(
    f"""WITH g AS ({GRID}), n AS (SELECT max(y) AS ym FROM g), a AS (SELECT g.y, g.x, sum(b.v * t.w) AS v FROM g, {_taps(1.0)}, g b WHERE b.y = g.y AND b.x = CASE WHEN g.x + t.d < 0 THEN -1 - (g.x + t.d) WHEN g.x + t.d > 63 THEN 127 - (g.x + t.d) ELSE g.x + t.d END GROUP BY ALL)
 SELECT g.y, g.x, round(sum(b.v * t.w), 6) AS smooth FROM g, n, {_taps(1.0)}, a b WHERE b.x = g.x AND b.y = CASE WHEN g.y + t.d < 0 THEN -1 - (g.y + t.d) WHEN g.y + t.d > ym THEN 2 * ym + 1 - (g.y + t.d) ELSE g.y + t.d END GROUP BY ALL"""
)
def gaussian_blur(spark, folder):
    """2-D Gaussian reflecting at the image edge."""
    return raster.gaussian(grid(spark, folder), [], ("y", "x"), "v", 1.0).withColumn("smooth", r("smooth"))


@query(
    f"""WITH g AS ({GRID}) SELECT y, x, round(CASE WHEN lag(v) OVER r IS NULL THEN lead(v) OVER r - v WHEN lead(v) OVER r IS NULL THEN v - lag(v) OVER r ELSE (lead(v) OVER r - lag(v) OVER r) / 2 END, 6) AS g_x,
 round(CASE WHEN lag(v) OVER c IS NULL THEN lead(v) OVER c - v WHEN lead(v) OVER c IS NULL THEN v - lag(v) OVER c ELSE (lead(v) OVER c - lag(v) OVER c) / 2 END, 6) AS g_y FROM g WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)"""
)
def image_gradient(spark, folder):
    return raster.gradients(grid(spark, folder), [], ("y", "x"), "v").select("y", "x", r("g_y").alias("g_y"), r("g_x").alias("g_x"))


def _day_profile(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.hour("ts").alias("h")).agg(F.avg("value").alias("m"))


@query("WITH p AS (SELECT event_type, hour(ts)::INT AS h, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, h, round(sum(m) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smooth FROM p")
def moving_avg3(spark, folder):
    out = stats.smooth_profile(_day_profile(spark, folder), ["event_type"], "h", "m", [1 / 3] * 3, "smooth")
    return out.select("event_type", "h", r("smooth").alias("smooth"))


@query(
    """WITH p AS (SELECT event_type, hour(ts)::INT AS h, avg(value) AS m FROM events GROUP BY ALL), s AS (SELECT event_type, h, sum(m) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM p),
 d AS (SELECT *, s <= lag(s) OVER w AND s <= lead(s) OVER w AS dip FROM s WINDOW w AS (PARTITION BY event_type ORDER BY h)) SELECT event_type, coalesce(min(h) FILTER (dip), arg_min(h, (s, h))) AS gap FROM d GROUP BY event_type"""
)
def local_minima(spark, folder):
    s = stats.smooth_profile(_day_profile(spark, folder), ["event_type"], "h", "m", [1 / 3] * 3, "s")
    return profile.first_local_minimum(s, ["event_type"], "h", "s")


PEAKS = """e AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
 s AS (SELECT *, lag(v) OVER (PARTITION BY label, vec_id ORDER BY k) AS pv FROM e),
 u AS (SELECT label, vec_id, k, v, lead(k) OVER w AS nk, lag(v) OVER w AS lv, lead(v) OVER w AS rv FROM s WHERE pv IS NULL OR v <> pv WINDOW w AS (PARTITION BY label, vec_id ORDER BY k)),
 t AS (SELECT label, vec_id, v, (k + nk - 1) // 2 AS pos FROM u WHERE v > lv AND v > rv AND v >= 0.1), l AS (SELECT label, vec_id, list([pos] ORDER BY v DESC, pos DESC) AS c FROM t GROUP BY ALL),
 p AS (SELECT label, vec_id, list_sort(list_reduce(c, lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y - x[1]) < 4)) > 0 THEN a ELSE list_append(a, x[1]) END)) AS p FROM l),
 d AS (SELECT label, len(p) AS n, list_transform(range(1, len(p)), lambda i: p[i + 1] - p[i]) AS gaps FROM p)"""


@query(f"WITH {PEAKS} SELECT label, quantile_cont(list_aggregate(gaps, 'median'), 0.5) AS spacing FROM d WHERE n >= 3 GROUP BY label")
def peak_spacing(spark, folder):
    """Peaks of every embedding read as a profile (height 0.1, distance 4): median gap per label."""
    e = table(spark, folder, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("profile"))
    return profile.crest_spacing(e, ["label"], ["vec_id"], step=1.0, height=0.1, distance=4)


@query(f"WITH {PEAKS} SELECT label, round(quantile_cont(list_aggregate(gaps, 'stddev_pop') / list_aggregate(gaps, 'avg'), 0.5), 9) AS regularity FROM d WHERE n >= 4 GROUP BY label")
def crest_regularity(spark, folder):
    e = table(spark, folder, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("profile"))
    return profile.crest_regularity(e, ["label"], ["vec_id"], height=0.1).withColumn("regularity", r("regularity", 9))


_W3 = stats.gaussian_taps(3.0)


@query(
    f"""WITH p AS (SELECT user_id % 4 AS quarter, hour(ts)::INT AS layer, avg(value) AS m FROM events GROUP BY ALL),
 s AS (SELECT a.quarter, a.layer, sum(b.m * t.w) AS s FROM p a, {_taps(3.0)}, p b WHERE b.quarter = a.quarter AND b.layer = CASE WHEN a.layer + t.d < 0 THEN -1 - (a.layer + t.d) WHEN a.layer + t.d > 23 THEN 47 - (a.layer + t.d) ELSE a.layer + t.d END GROUP BY ALL),
 k AS (SELECT quarter, layer - 11 AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY round(s, 9) DESC, layer) AS k FROM s WHERE abs(layer - 11) <= 10) WHERE k = 1)
 SELECT quarter, predicted, CASE WHEN predicted <= -6 THEN -8 WHEN predicted <= -2 THEN -4 WHEN predicted <= 2 THEN 0 WHEN predicted <= 6 THEN 4 ELSE 8 END AS snapped FROM k"""
)
def depth_predictor(spark, folder):
    e = table(spark, folder, "events").select(F.pmod("user_id", F.lit(4)).alias("quarter"), F.hour("ts").alias("layer"), F.col("value").alias("v"))
    return profile.depth_prediction(e, [], "quarter", 24, reach=10, grid=(-8, -4, 0, 4, 8))


@query(
    f"""WITH p AS (SELECT user_id % 4 AS quarter, hour(ts)::INT AS layer, avg(value) AS m FROM events GROUP BY ALL),
 s AS (SELECT a.quarter, a.layer, sum(b.m * t.w) AS s FROM p a, {_taps(3.0)}, p b WHERE b.quarter = a.quarter AND b.layer = CASE WHEN a.layer + t.d < 0 THEN -1 - (a.layer + t.d) WHEN a.layer + t.d > 23 THEN 47 - (a.layer + t.d) ELSE a.layer + t.d END GROUP BY ALL),
 k AS (SELECT quarter, layer - 11 AS p FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY round(s, 9) DESC, layer) AS k FROM s WHERE abs(layer - 11) <= 10) WHERE k = 1),
 n AS (SELECT quarter, CASE WHEN p <= -6 THEN -8 WHEN p <= -2 THEN -4 WHEN p <= 2 THEN 0 WHEN p <= 6 THEN 4 ELSE 8 END AS snapped FROM k),
 l AS (SELECT user_id AS u, user_id % 4 AS quarter, ((count(*) % 5)::INT - 2) * 4 AS label FROM events GROUP BY ALL)
 SELECT count(*) AS scorable, count(*) FILTER (snapped = label) AS matches, count(*) FILTER (label = 0) AS constant_matches FROM n JOIN l USING (quarter)"""
)
def depth_match(spark, folder):
    """How often the predicted depth, and a constant one, meet the labelled depth of each user."""
    labels = table(spark, folder, "events").groupBy("user_id", F.pmod("user_id", F.lit(4)).alias("quarter")).agg(((F.pmod(F.count(F.lit(1)), F.lit(5)) - 2) * 4).cast("int").alias("label"))
    return profile.match_rate(depth_predictor(spark, folder), labels, ["quarter"])


@query("SELECT b.bin::INT AS bin, count(l_quantity) AS n, round(avg(l_extendedprice), 4) AS mean FROM range(8) b(bin) LEFT JOIN lineitem ON floor((l_quantity - 5 + 5) / 10) = b.bin GROUP BY 1")
def depth_bin_pool(spark, folder):
    """Eight bins of ten; quantities end at 50, so the last two are empty."""
    li = table(spark, folder, "lineitem").withColumn("bin", stats.depth_bin("l_quantity", 5.0, 10.0))
    return stats.bin_pool(li, "bin", 8, "l_extendedprice").withColumn("mean", r("mean", 4))


@query(
    f"""WITH RECURSIVE g AS (SELECT y, x, y * 64 + x AS id FROM ({GRID}) WHERE v > 0.12), e AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON (b.y = a.y AND abs(b.x - a.x) = 1) OR (b.x = a.x AND abs(b.y - a.y) = 1)),
 r AS (SELECT id AS node, id AS lab FROM g UNION SELECT e.b, r.lab FROM r JOIN e ON e.a = r.node WHERE r.lab < e.b), c AS (SELECT node, min(lab) AS lab FROM r GROUP BY node)
 SELECT (lab // 64)::INT AS y, (lab % 64)::INT AS x, min(node // 64)::INT AS y0, max(node // 64)::INT AS y1, min(node % 64)::INT AS x0, max(node % 64)::INT AS x1, count(*) AS pixels FROM c GROUP BY lab"""
)
def component_extents(spark, folder):
    mask = grid(spark, folder).where("v > 0.12").select("y", "x")
    out = components.component_extents(components.mask_components(mask, [], tile=32), [])
    return out.select("component.y", "component.x", "y0", "y1", "x0", "x1", "pixels")


@query()
def component_extent_score(spark, folder):
    """Two-sided text score: even dimensions as side a, odd ones as side b."""
    g = grid(spark, folder)
    v = F.least(F.greatest(F.rint(160 + 300 * F.col("v")), F.lit(0.0)), F.lit(255.0)).cast("int")
    img = g.select(F.when(F.pmod("x", F.lit(2)) == 0, "a").otherwise("b").alias("side"), "y", F.floor(F.col("x") / 2).cast("int").alias("x"), v.alias("v"))
    out = components.text_score(img, [], "side", "v", 175.0, edge_mm=0.35)
    return out.select(r("score").alias("score"), r("ta").alias("ta"), r("tb").alias("tb"), "side")


def _angles() -> str:
    import math

    return "(VALUES " + ", ".join(f"({a}, {math.cos(math.radians(a))!r}::DOUBLE, {math.sin(math.radians(a))!r}::DOUBLE)" for a in range(0, 180, 4)) + ") t(angle, c, s)"


@query(
    f"""WITH p AS (SELECT y, x, greatest(128 + 300 * v - 127, 0) AS v FROM ({GRID})), t AS (SELECT v, angle, round(y * c + x * s, 9) AS a FROM p, {_angles()}),
 b AS (SELECT angle, band, sum(w * v) AS sv, round(sum(w), 6) AS n FROM (SELECT angle, v, floor(a)::INT AS band, floor(a) + 1 - a AS w FROM t UNION ALL SELECT angle, v, floor(a)::INT + 1, a - floor(a) FROM t) WHERE w > 0 GROUP BY ALL),
 k AS (SELECT angle, band, sv / n AS p FROM (SELECT *, max(n) OVER (PARTITION BY angle) AS m FROM b) WHERE n > 0.5 * m),
 f AS (SELECT angle, band, p - avg(p) OVER (PARTITION BY angle ORDER BY band RANGE BETWEEN 9 PRECEDING AND 9 FOLLOWING) AS d FROM k), st AS (SELECT angle, stddev_pop(d) AS std FROM f GROUP BY angle),
 best AS (SELECT angle, std FROM st ORDER BY round(std, 9) DESC, angle LIMIT 1), mid AS (SELECT quantile_cont(std, 0.5) AS m FROM st),
 ac AS (SELECT b.band - a.band AS lag, sum(a.d * b.d) AS ac FROM f a JOIN best USING (angle) JOIN f b ON b.angle = a.angle AND b.band - a.band BETWEEN 5 AND 17 GROUP BY 1)
 SELECT round(std / m, 6) AS ratio, angle, round((SELECT lag FROM ac ORDER BY round(ac, 6) DESC, lag LIMIT 1) * 500.0 / 1000, 6) AS spacing_mm FROM best, mid"""
)
def line_banding(spark, folder):
    img = grid(spark, folder).withColumn("v", 128 + 300 * F.col("v"))
    out = raster.line_banding(img, [], "v", 500.0)
    return out.select(r("ratio").alias("ratio"), "angle", r("spacing_mm").alias("spacing_mm"))


@query(
    f"""WITH m AS (SELECT max(y) + 1 AS h FROM ({GRID})), oy AS (SELECT unnest(list_sort(list_distinct(list_append(range(0, (h - 8 + 1)::BIGINT, 4), (h - 8)::BIGINT)))) AS oy FROM m), ox AS (SELECT unnest([0, 4, 8]) AS ox),
 s AS (SELECT oy, ox, avg(v) / 255.0 AS s FROM ({STACK}) p, oy, ox WHERE p.y BETWEEN oy AND oy + 7 AND p.x BETWEEN ox AND ox + 7 GROUP BY ALL) SELECT oy::INT AS oy, ox::INT AS ox, round(s, 9) AS s FROM s"""
)
def plugin_scorer(spark, folder):
    """The scorer plug-in on overlapping 8 x 8 tiles: here one score per tile, the mean of its block."""
    tiles = raster.to_tiles(stack(spark, folder), [], 8)
    scored = raster.score_tiles(tiles, [], 8, 4, _tile_mean)
    return scored.groupBy("oy", "ox").agg(r(F.max("s"), 9).alias("s"))


def _tile_mean(block):
    import numpy as np

    return np.full(block.shape[1:], block.mean() / 255.0)


@query(
    f"""WITH m AS (SELECT y, x, avg(v) AS v FROM ({STACK}) GROUP BY ALL), n AS (SELECT y, x, v, 1 AS k, 0 AS dy, -1 AS dx FROM m UNION ALL SELECT y, x, v, 1, -1, 0 FROM m UNION ALL SELECT y, x, v, 2, 0, 1 FROM m)
 SELECT m.y, m.x, round(coalesce(sum(n.v * n.k), 0) / 4, 6) AS s FROM m LEFT JOIN n ON n.y + n.dy = m.y AND n.x + n.dx = m.x GROUP BY m.y, m.x"""
)
def fused_views(spark, folder):
    """Four views of the image stack, with a read that sees the next pixel to the right: it meets another neighbour in every view."""

    def read(stack_, keys):
        mean = stack_.groupBy(*keys, "y", "x").agg(F.avg("v").alias("v"))
        ahead = mean.select(*keys, "y", (F.col("x") - 1).alias("x"), F.col("v").alias("s"))
        return mean.drop("v").join(ahead, [*keys, "y", "x"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))

    out = raster.fused_views(stack(spark, folder), [], read)
    return out.select("y", "x", r("s").alias("s"))


@query(f"SELECT (y // 8)::INT AS i, (x // 8)::INT AS j, sum(CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END) / 64 AS share, count(*) = 64 AND bool_and(v > -0.3) AS all_carried FROM ({GRID}) GROUP BY ALL")
def canvas_cells(spark, folder):
    """Per 8 x 8 cell of the canvas: the share of labelled pixels, and whether all were carried."""
    from voxtable.operators import geometry

    g = grid(spark, folder).select("y", "x", (F.col("v") > 0.1).alias("label"), (F.col("v") > -0.3).alias("carried"))
    return geometry.cell_labels(g, [], 8, "label", "carried")


@query(
    f"""WITH g AS (SELECT x // 8 AS band, y, x, v, max(y) OVER () + 1 AS h FROM ({GRID})) SELECT band::INT AS band, greatest(min(y) - 5, 0)::INT AS y0, least(max(y) + 6, max(h))::INT AS y1, greatest(min(x) - 5, 0)::INT AS x0, least(max(x) + 6, 64)::INT AS x1
 FROM g WHERE v > 0.3 GROUP BY band"""
)
def padded_extents(spark, folder):
    """Regions of bright pixels in bands of eight columns, grown by five and cut to the grid."""
    from voxtable.operators import geometry

    g = grid(spark, folder)
    g = g.withColumn("band", F.floor(F.col("x") / 8).cast("int")).withColumns({"h": g.agg(F.max("y") + 1).scalar(), "w": F.lit(64)})
    return geometry.padded_extent(g.where("v > 0.3"), ["band"], 5, "h", "w")


def _hann_sql(a: str) -> str:
    return f"(0.5 - 0.5 * cos(({a}) * (2 * pi() / 7)))"


@query(
    f"""WITH m AS (SELECT max(y) + 1 AS h FROM ({GRID})), oy AS (SELECT unnest(list_sort(list_distinct(list_append(range(0, (h - 8 + 1)::BIGINT, 4), (h - 8)::BIGINT)))) AS oy FROM m), ox AS (SELECT unnest([0, 4, 8]) AS ox),
 p AS (SELECT DISTINCT y, x FROM ({STACK})), s AS (SELECT oy, ox, avg(v) / 255.0 AS s FROM ({STACK}) p, oy, ox WHERE p.y BETWEEN oy AND oy + 7 AND p.x BETWEEN ox AND ox + 7 GROUP BY ALL),
 pk AS (SELECT {_hann_sql("3")} AS peak), w AS (SELECT p.y, p.x, s.s, greatest({_hann_sql("p.y - oy")} * {_hann_sql("p.x - ox")} / (peak * peak), 1e-3) AS w FROM p, pk, s WHERE p.y BETWEEN oy AND oy + 7 AND p.x BETWEEN ox AND ox + 7)
 SELECT y, x, round(sum(w * s) / sum(w), 6) AS s FROM w GROUP BY ALL"""
)
def tile_blend(spark, folder):
    tiles = raster.to_tiles(stack(spark, folder), [], 8)
    out = raster.blend_tiles(raster.score_tiles(tiles, [], 8, 4, _tile_mean), [], 8)
    return out.select("y", "x", r("s").alias("s"))


@query(f"SELECT y, x, round(avg(v / 255.0), 6) AS mean, max(v) / 255.0 AS best FROM ({STACK}) GROUP BY ALL")
def member_mean(spark, folder):
    maps = stack(spark, folder).select("y", "x", (F.col("v") / 255.0).alias("s"))
    mean = raster.member_mean(maps, []).select("y", "x", r("s").alias("mean"))
    return mean.join(raster.member_mean(maps, [], how="max").withColumnRenamed("s", "best"), ["y", "x"])


@query(
    f"""WITH g AS ({GRID}), m AS (SELECT max(y) + 1 AS h FROM g), v AS (SELECT y, x, v FROM g UNION ALL SELECT x AS y, h - 1 - y AS x, v FROM g, m UNION ALL SELECT h - 1 - y, 63 - x, v FROM g, m UNION ALL SELECT y, 63 - x, v FROM g)
 SELECT y::INT AS y, x::INT AS x, count(*) AS views, round(sum(v), 6) AS total FROM v GROUP BY ALL"""
)
def warp_rotate(spark, folder):
    """Four exact views of the image (as is, turned 90 clockwise, turned 180, mirrored), summed per view pixel."""
    g = grid(spark, folder)
    h, w = g.agg(F.max("y") + 1).scalar(), F.lit(64)
    y, x = F.col("y"), F.col("x")
    views = [(k, m) for k, m in ((0, False), (3, False), (2, False), (0, True))]
    # the view pixel an image pixel lands on is the source of the inverse turn
    sides = {0: (h, w), 3: (w, h), 2: (h, w)}
    pixels = [F.struct(*[c.cast("int").alias(n) for c, n in zip(raster.turn(y, x, *sides[k], (4 - k) % 4, m), "yx")]) for k, m in views]
    spread = g.select("v", F.explode(F.array(*pixels)).alias("p"))
    return spread.groupBy("p.y", "p.x").agg(F.count(F.lit(1)).alias("views"), r(F.sum("v")).alias("total"))


@query(
    f"""WITH g AS ({GRID}), t AS (SELECT y, x, y * 0.5 + 0.25 AS sy, x * 0.5 + 0.25 AS sx FROM g), c AS (SELECT t.y, t.x, sum(coalesce(g.v, 0) * (CASE WHEN g.y = floor(sy) THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE WHEN g.x = floor(sx) THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END)) AS value
 FROM t JOIN g ON g.y IN (floor(sy), floor(sy) + 1) AND g.x IN (floor(sx), floor(sx) + 1) GROUP BY ALL) SELECT y, x, round(value, 6) AS value FROM c"""
)
def resample_grid(spark, folder):
    """The image at twice the resolution's quarter offsets, linear."""
    g = grid(spark, folder)
    targets = g.select(F.col("y").alias("ty"), F.col("x").alias("tx"), (F.col("y") * 0.5 + 0.25).alias("y"), (F.col("x") * 0.5 + 0.25).alias("x"))
    out = raster.resample_linear(targets, g, [], ["ty", "tx"], "v")
    return out.select(F.col("ty").alias("y"), F.col("tx").alias("x"), r("value").alias("value"))


@query(
    f"""WITH g AS ({GRID}), t AS (SELECT y, x, 0.75 * y + 0.25 * x - 3.5 AS sy, -0.25 * y + 0.75 * x + 2.25 AS sx FROM g), c AS (SELECT t.y, t.x, sum(g.v * (CASE WHEN g.y = floor(sy) THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE WHEN g.x = floor(sx) THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END)) AS value
 FROM t JOIN g ON g.y IN (floor(sy), floor(sy) + 1) AND g.x IN (floor(sx), floor(sx) + 1) GROUP BY ALL) SELECT t.y, t.x, coalesce(round(value, 6), 0) AS value FROM t LEFT JOIN c USING (y, x)"""
)
def affine_warp(spark, folder):
    g = grid(spark, folder)
    out = raster.affine_warp(g.select("y", "x"), g, [[0.75, 0.25, -3.5], [-0.25, 0.75, 2.25]], [], "v")
    return out.select("y", "x", r("value").alias("value"))


@query("SELECT l_orderkey, l_partkey, 4 - (l_linenumber - 2) AS layer, l_quantity FROM lineitem WHERE l_linenumber BETWEEN 2 AND 6")
def layer_window(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("layer"), "l_quantity")
    return raster.layer_window(li, 2, 5, reverse=True)


@query("SELECT l_linenumber - 2 AS layer, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber - 2 BETWEEN 0 AND 7 GROUP BY 1")
def layer_shift(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("layer"), "l_quantity")
    return raster.shift_layers(li, 2, 8).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query(
    """WITH p AS (SELECT l AS src, 2 + row_number() OVER (ORDER BY md5(concat_ws(',', '0', l::VARCHAR)), l) - 1 AS dst FROM range(2, 7) t(l))
 SELECT coalesce(dst, l_linenumber)::INT AS layer, count(*) AS n, sum(l_quantity) AS q FROM lineitem LEFT JOIN p ON src = l_linenumber GROUP BY 1"""
)
def layer_shuffle(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("layer"), "l_quantity")
    return raster.shuffle_layers(li, 2, 5).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query(f"SELECT (y // 8)::INT AS by, (x // 8)::INT AS bx, round(count(*) FILTER (v > -0.15) / 64, 9) AS share FROM ({GRID}) GROUP BY ALL HAVING count(*) FILTER (v > -0.15) / 64 >= 0.9")
def grid_boxes(spark, folder):
    g = grid(spark, folder).withColumn("ok", F.col("v") > -0.15)
    return select.grid_boxes(g, [], 8, "ok").withColumn("share", r("share", 9))


@query(
    f"""WITH c AS (SELECT list([{{'y': y, 'x': x, 'v': v}}] ORDER BY v DESC, y, x) AS c FROM ({GRID}) WHERE v > 0.2),
 k AS (SELECT unnest(list_reduce(c, lambda a, b: CASE WHEN len(list_filter(a, lambda k: abs(k.y - b[1].y) < 6 AND abs(k.x - b[1].x) < 6)) > 0 THEN a ELSE list_append(a, b[1]) END)) AS k FROM c) SELECT k.y AS y, k.x AS x, k.v AS v FROM k"""
)
def greedy_separated(spark, folder):
    """Brightest pixels, none within 6 rows and 6 columns of a better one."""
    g = grid(spark, folder).where("v > 0.2")
    return select.greedy_separated(g, [], [-F.col("v")], 6, 6)


@query(
    f"""WITH g AS (SELECT y, x, CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END AS ink FROM ({GRID})), b AS (SELECT g.y - dy AS y, g.x - dx AS x, sum(ink) / 64 AS density, count(*) AS n FROM g, range(8) a(dy), range(8) b(dx) GROUP BY ALL),
 c AS (SELECT list([{{'y': y, 'x': x, 'd': density}}] ORDER BY density DESC, y, x) AS c FROM b WHERE n = 64 AND density > 0),
 k AS (SELECT list_reduce(c, lambda a, b: CASE WHEN len(a) >= 12 OR len(list_filter(a, lambda k: abs(k.y - b[1].y) < 8 AND abs(k.x - b[1].x) < 8)) > 0 THEN a ELSE list_append(a, b[1]) END) AS k FROM c), u AS (SELECT unnest(k) AS s, generate_subscripts(k, 1) AS pick FROM k)
 SELECT s.y::INT AS y, s.x::INT AS x, round(s.d, 9) AS density, pick FROM u"""
)
def densest_boxes(spark, folder):
    """Twelve densest disjoint 8 x 8 boxes."""
    g = grid(spark, folder).withColumn("ink", (F.col("v") > 0.1).cast("double"))
    return select.densest_boxes(g, [], "ink", 8, 8, 12).withColumn("density", r("density", 9))
