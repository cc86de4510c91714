"""Chunked-volume queries. The part table is read as tilted sheets in a volume: row y = key div 40, column x = key mod 40,
height z0 from the price; the volume, its chunks and its surfaces grow with the table."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.catalog import Registry
from voxtable.catalog.images import STACK, stack
from voxtable.catalog.tables import GRID, VOLUME, grid, r, table, volume
from voxtable.operators import chunks as ch
from voxtable.operators import growth, nearest, normals, placement, profile, select, shift, stitch
from voxtable.session import scratch_path
from voxtable.sources import writers

REGISTRY = Registry()
query = REGISTRY.query

CHUNK = (16, 16, 16)

PARTS = "SELECT p_partkey, p_size, (p_partkey // 40)::INT AS y, (p_partkey % 40)::INT AS x, 8 + (p_retailprice - 900) * 0.08 AS z0 FROM part"
SHEET = f"SELECT (floor(z0) + k)::INT AS z, y, x, round_even(200 * exp(-0.5 * (floor(z0) + k - z0) * (floor(z0) + k - z0)), 0)::INT AS v FROM ({PARTS}), range(-3, 5) t(k)"


def parts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select(
        "p_partkey", "p_size", F.floor(F.col("p_partkey") / 40).cast("int").alias("y"), F.pmod("p_partkey", F.lit(40)).cast("int").alias("x"), (8 + (F.col("p_retailprice") - 900) * 0.08).alias("z0")
    )


def sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels of the sheets: a Gaussian bump of height 200 across the surface."""
    p = parts(spark, folder).withColumn("k", F.explode(F.sequence(F.lit(-3), F.lit(4))))
    z = F.floor("z0") + F.col("k")
    v = F.rint(200 * F.exp(-0.5 * (z - F.col("z0")) * (z - F.col("z0"))))
    return p.select(F.lit("sheet").alias("volume_id"), F.lit(0).alias("level"), z.cast("int").alias("z"), "y", "x", v.cast("smallint").alias("v"))


def sheet_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return ch.to_chunks(sheet(spark, folder), CHUNK)


def sheet_store(spark: SparkSession, folder: str) -> DataFrame:
    return ch.lay_out(sheet_chunks(spark, folder))


def shape(spark: SparkSession, folder: str) -> tuple[int, int, int]:
    """Volume shape, from the extent of the table (one row)."""
    top = table(spark, folder, "part").agg(F.max("p_partkey")).first()[0]
    return (24, top // 40 + 1, 40)


@query(f"SELECT z, y, x, v FROM ({SHEET}) WHERE v > 0")
def chunk_write_read(spark, folder):
    """Voxels written as chunk buffers partitioned by volume and level, read back; zero voxels are not stored."""
    path = scratch_path(spark, "chunks")
    writers.write_chunks(sheet(spark, folder), path, CHUNK)
    return ch.explode_chunks(spark.read.parquet(path), CHUNK).select("z", "y", "x", "v")


@query(f"SELECT z, y, x, v FROM ({VOLUME}) WHERE v > 0")
def chunk_roundtrip_dense(spark, folder):
    return ch.explode_chunks(ch.to_chunks(volume(spark, folder), CHUNK), CHUNK).select("z", "y", "x", "v")


@query(f"SELECT z, y, x, v FROM ({SHEET}) WHERE v > 0 AND z >= 10 AND z < 15 AND x >= 8 AND x < 36")
def box_read(spark, folder):
    """A slab through the whole volume: only the chunks it touches are opened."""
    dims = shape(spark, folder)
    return ch.box(sheet_chunks(spark, folder), "sheet", 0, (10, 0, 8), (15, dims[1], 36), CHUNK, shape=dims).select("z", "y", "x", "v")


@query(
    f"""WITH d AS (SELECT max(y) AS ym FROM ({PARTS})), g AS (SELECT z::INT AS z, y::INT AS y, x::INT AS x FROM range(-2, 20) a(z), d, generate_series(0, ym) b(y), range(30, 50) c(x)),
 s AS (SELECT * FROM ({SHEET}) WHERE v > 0), c AS (SELECT DISTINCT z // 16 AS cz, y // 16 AS cy, x // 16 AS cx FROM s)
 SELECT g.z, g.y, g.x, coalesce(s.v, 0) AS v, c.cz IS NULL AS missing FROM g LEFT JOIN s USING (z, y, x) LEFT JOIN c ON c.cz = floor(g.z / 16.0) AND c.cy = floor(g.y / 16.0) AND c.cx = floor(g.x / 16.0)"""
)
def box_read_padded(spark, folder):
    """Every voxel of a box that leaves the volume on both sides: zero outside and in absent chunks."""
    dims = shape(spark, folder)
    out = ch.box(sheet_chunks(spark, folder), "sheet", 0, (-2, 0, 30), (20, dims[1], 50), CHUNK, pad=True)
    return out.select("z", "y", "x", F.col("v").cast("int").alias("v"), "missing")


def _probe_points(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (-20, 0, 1, 6)])))
    return p.select("p_partkey", "k", F.lit("sheet").alias("volume_id"), F.lit(0).alias("level"), (F.floor("z0").cast("int") + F.col("k")).alias("z"), "y", "x")


@query(
    f"""WITH p AS (SELECT p_partkey, k::INT AS k, (floor(z0) + k)::INT AS z, y, x FROM ({PARTS}), (VALUES (-20), (0), (1), (6)) t(k)), s AS (SELECT * FROM ({SHEET}) WHERE v > 0),
 c AS (SELECT DISTINCT z // 16 AS cz, y // 16 AS cy, x // 16 AS cx FROM s)
 SELECT p_partkey, k, coalesce(s.v, 0) AS v, CASE WHEN p.z < 0 OR p.z >= 24 THEN 'outside' WHEN c.cz IS NULL THEN 'missing' ELSE 'ok' END AS read
 FROM p LEFT JOIN s USING (z, y, x) LEFT JOIN c ON c.cz = floor(p.z / 16.0) AND c.cy = p.y // 16 AND c.cx = p.x // 16"""
)
def gather_points(spark, folder):
    out = ch.gather(_probe_points(spark, folder), sheet_store(spark, folder), shape(spark, folder), CHUNK)
    return out.select("p_partkey", "k", "v", "read")


@query(f"WITH p AS (SELECT (floor(z0) + k)::INT AS z, y, x FROM ({PARTS}), (VALUES (-20), (0), (1), (6)) t(k)) SELECT floor(z / 16.0)::INT AS cz, (y // 16)::INT AS cy, (x // 16)::INT AS cx, count(*) AS points FROM p GROUP BY ALL")
def chunk_footprint(spark, folder):
    return ch.footprint(_probe_points(spark, folder), CHUNK)


def _tri_sql(points: str, keys: str) -> str:
    join = " AND ".join(f"s.{a} = c.{a}" for a in "zyx")
    corners = ", ".join(f"range(0, 2) d{a}(d{a})" for a in "zyx")
    cells = ", ".join(f"(floor(p.{a}) + d{a})::INT AS {a}" for a in "zyx")
    weights = " * ".join(f"(CASE WHEN d{a} = 0 THEN 1 - (p.{a} - floor(p.{a})) ELSE p.{a} - floor(p.{a}) END)" for a in "zyx")
    return f"WITH p AS ({points}), c AS (SELECT {keys}, {cells}, {weights} AS w FROM p, {corners}), s AS (SELECT * FROM ({SHEET}) WHERE v > 0) SELECT {keys}, round(sum(w * coalesce(s.v, 0)), 6) + 0.0 AS value FROM c LEFT JOIN s ON {join} WHERE w > 0 GROUP BY {keys}"


@query(_tri_sql(f"SELECT p_partkey, z0 + 0.3 AS z, y + 0.25 AS y, x + 0.5 AS x FROM ({PARTS})", "p_partkey"))
def gather_trilinear(spark, folder):
    p = parts(spark, folder).select("p_partkey", F.lit("sheet").alias("volume_id"), F.lit(0).alias("level"), (F.col("z0") + 0.3).alias("z"), (F.col("y") + 0.25).alias("y"), (F.col("x") + 0.5).alias("x"))
    out = ch.trilinear(p, sheet_store(spark, folder), shape(spark, folder), CHUNK, ["p_partkey"])
    return out.select("p_partkey", r("value").alias("value"))


@query(_tri_sql(f"SELECT p_partkey, layer::INT AS layer, z0 + (layer - 2) * 0.8 AS z, y + (layer - 2) * 0.6 AS y, x::DOUBLE AS x FROM ({PARTS}), range(5) t(layer)", "p_partkey, layer"))
def render_layers(spark, folder):
    p = parts(spark, folder).select(
        "p_partkey", F.lit("sheet").alias("volume_id"), F.lit(0).alias("level"), F.col("z0").alias("z"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"),
        F.lit(0.8).alias("nz"), F.lit(0.6).alias("ny"), F.lit(0.0).alias("nx"),
    )
    out = ch.render_layers(p, sheet_store(spark, folder), shape(spark, folder), CHUNK, 2, ["p_partkey"])
    return out.select("p_partkey", "layer", r("value").alias("value"))


@query(
    f"""WITH p AS (SELECT p_partkey, y // 25 AS seg, y, x, z0 FROM ({PARTS})), d AS (SELECT p.*, k, round_even(z0 + k, 0)::INT AS z FROM p, generate_series(-58, 58, 2) t(k)), s AS (SELECT * FROM ({SHEET}) WHERE v > 0),
 v AS (SELECT d.seg, d.p_partkey, d.k, CASE WHEN d.z BETWEEN 0 AND 23 THEN coalesce(s.v, 0) ELSE 0 END AS v, d.z NOT BETWEEN 0 AND 23 AS o FROM d LEFT JOIN s USING (z, y, x)),
 m AS (SELECT seg, step, 0.5 * sum(m) AS m FROM (SELECT seg, abs(k) AS step, k, avg(v) AS m FROM v WHERE k <> 0 GROUP BY ALL) GROUP BY ALL), sm AS (SELECT seg, step, sum(m) OVER (PARTITION BY seg ORDER BY step ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM m),
 dip AS (SELECT *, s <= lag(s) OVER w AND s <= lead(s) OVER w AS dip FROM sm WINDOW w AS (PARTITION BY seg ORDER BY step)), gap AS (SELECT seg, coalesce(min(step) FILTER (dip), arg_min(step, (s, step))) AS gap FROM dip GROUP BY seg),
 q AS (SELECT v.seg, v.p_partkey, gap, max(v) FILTER (k = 0) AS c, sum(v) FILTER (abs(k) = gap) AS sides FROM v JOIN gap USING (seg) GROUP BY ALL),
 e AS (SELECT seg, gap, count(*) AS points, avg(CASE WHEN c > 40 THEN 1.0 ELSE 0.0 END) AS coverage, avg(c - 0.5 * sides) FILTER (c > 40) AS contrast, avg(c) FILTER (c > 40) AS on_mean, avg(c) AS all_mean FROM q GROUP BY ALL)
 SELECT seg::INT AS seg, points, round(CASE WHEN coverage < 0.25 THEN -1 ELSE contrast * coverage END, 6) AS score, round(CASE WHEN coverage < 0.25 THEN all_mean ELSE on_mean END, 6) AS centre_mean, round(coverage, 6) AS coverage, gap::INT AS gap, (SELECT count(*) FROM v WHERE o AND v.seg = e.seg) AS outside_reads FROM e"""
)
def seating_score(spark, folder):
    """Seating of every part on its sheet, one score per sheet of 25 rows."""
    p = parts(spark, folder).select(
        F.floor(F.col("y") / 25).cast("int").alias("seg"), F.col("p_partkey").alias("point_id"), F.lit("sheet").alias("volume_id"), F.lit(0).alias("level"), F.col("z0").alias("z"), "y", "x",
        F.lit(1.0).alias("nz"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nx"),
    )
    out = profile.seating_score(p, sheet_store(spark, folder), shape(spark, folder), CHUNK, ["seg"], steps=tuple(range(2, 60, 2)))
    return out.select("seg", "points", r("score").alias("score"), r("centre_mean").alias("centre_mean"), r("coverage").alias("coverage"), "gap", "outside_reads")


@query(
    f"""WITH v AS MATERIALIZED (SELECT z, y, x, v FROM ({SHEET})), s AS (SELECT y // 25 AS seg, p_partkey AS id, y, x, k, z0 - 4 + 0.5 * k AS z FROM ({PARTS}), range(17) t(k)),
 e AS (SELECT seg, id, k, (1 - (s.z - floor(s.z))) * coalesce(a.v, 0) + (s.z - floor(s.z)) * coalesce(b.v, 0) AS v FROM s LEFT JOIN v a ON a.y = s.y AND a.x = s.x AND a.z = floor(s.z) LEFT JOIN v b ON b.y = s.y AND b.x = s.x AND b.z = floor(s.z) + 1),
 p AS (SELECT *, lag(v) OVER (PARTITION BY seg, id ORDER BY k) AS pv FROM e),
 u AS (SELECT seg, id, k, v, lead(k) OVER w AS nk, lag(v) OVER w AS lv, lead(v) OVER w AS rv FROM p WHERE pv IS NULL OR v <> pv WINDOW w AS (PARTITION BY seg, id ORDER BY k)),
 t AS (SELECT seg, id, v, (k + nk - 1) // 2 AS pos FROM u WHERE v > lv AND v > rv AND v >= 20), l AS (SELECT seg, id, list([pos] ORDER BY v DESC, pos DESC) AS c FROM t GROUP BY ALL),
 g AS (SELECT seg, id, len(list_reduce(c, lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y - x[1]) < 4)) > 0 THEN a ELSE list_append(a, x[1]) END)) AS n FROM l)
 SELECT q.seg::INT AS seg, count(*) AS points, round(avg(coalesce(g.n, 0)), 6) AS peaks FROM (SELECT DISTINCT seg, id FROM s) q LEFT JOIN g USING (seg, id) GROUP BY q.seg"""
)
def normal_profile_spacing(spark, folder):
    """Peak spacing along the sheet normals of every part."""
    p = parts(spark, folder).select(
        F.floor(F.col("y") / 25).cast("int").alias("seg"), "p_partkey", F.lit("sheet").alias("volume_id"), F.lit(0).alias("level"), F.col("z0").alias("z"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"),
        F.lit(1.0).alias("nz"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nx"),
    )
    prof = profile.normal_profiles(p, sheet_store(spark, folder), shape(spark, folder), CHUNK, ["seg", "p_partkey"], 4.0, 0.5)
    peaks = profile.find_peaks(prof, ["seg", "p_partkey"], "profile", 20.0, 4)
    return peaks.groupBy("seg").agg(F.count(F.lit(1)).alias("points"), r(F.avg(F.size("peaks"))).alias("peaks"))


#: A plane over the grid of parts, z = 24 + x: differences along z and x are alike on it, so that its normal is (1, 0, -1) over its length.
PLANE = "SELECT z::INT AS z, y, x, round_even(200 * exp(-0.4 * (z - 24 - x) * (z - 24 - x)), 0)::INT AS v FROM (SELECT (p_partkey // 40)::INT AS y, (p_partkey % 40)::INT AS x FROM part), range(0, 88) t(z)"
INNER = "x BETWEEN 17 AND 22 AND y >= 17 AND y < (SELECT max(p_partkey) // 40 - 17 FROM part)"


def _plane(spark: SparkSession, folder: str) -> tuple[DataFrame, tuple[int, int, int]]:
    p = parts(spark, folder).withColumn("z", F.explode(F.sequence(F.lit(10), F.lit(75))))
    off = F.col("z") - 24 - F.col("x")
    v = p.select(F.lit("plane").alias("volume_id"), F.lit(0).alias("level"), "z", "y", "x", F.rint(200 * F.exp(-0.4 * off * off)).cast("smallint").alias("v"))
    return ch.lay_out(ch.to_chunks(v, CHUNK)), (88, shape(spark, folder)[1], 40)


def _inner(df: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Voxels away from the borders, on the crest of the plane or eight voxels above it, where the volume holds zeros."""
    height = F.col("z") - 24 - F.col("x")
    place = F.when(F.abs(height) <= 0.5, "crest").when((height >= 7.5) & (height < 8.5), "beside")
    return df.where(F.col("x").between(17, 22) & (F.col("y") >= 17) & (F.col("y") < dims[1] - 18)).withColumn("place", place).where("place is not null")


def _inner_box(dims: tuple[int, int, int]) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """The box around the voxels of ``_inner``: what the filter on places cannot tell a read of chunks."""
    return (24 + 17, 17, 17), (24 + 22 + 9, dims[1] - 18, 23)


_PLACES = f"SELECT y, x, CASE WHEN abs(z - 24 - x) <= 0.5 THEN 'crest' ELSE 'beside' END AS place, v FROM ({PLANE}) WHERE {INNER} AND (abs(z - 24 - x) <= 0.5 OR (z - 24 - x >= 7.5 AND z - 24 - x < 8.5))"


@query(f"SELECT place, count(*) AS voxels, round(1 / sqrt(2), 2) AS nz, 0.0::DOUBLE AS ny, round(-1 / sqrt(2), 2) AS nx FROM ({_PLACES}) GROUP BY place")
def structure_tensor(spark, folder):
    """Normals of a planted plane, on it and beside it: mean components with nz turned up."""
    c, dims = _plane(spark, folder)
    n = _inner(normals.volume_normals(c, dims, CHUNK), dims)
    up = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    return n.groupBy("place").agg(F.count(F.lit(1)).alias("voxels"), *(r(F.avg(F.col(f"n{a}") * up), 2).alias(f"n{a}") for a in "zyx"))


@query(
    f"SELECT c.channel, place, CASE c.channel WHEN 'nx' THEN round(-1 / sqrt(2) * 127 + 128)::INT WHEN 'ny' THEN 128 ELSE 23 END AS v, count(*) AS voxels FROM ({_PLACES}), (VALUES ('nx'), ('ny'), ('grad_mag')) c(channel) GROUP BY ALL"
)
def normals_volume(spark, folder):
    """The encoded normal volume of the plane as chunk rows, read back and counted by code."""
    c, dims = _plane(spark, folder)
    n = normals.normal_chunks(c, dims, CHUNK, 20.0)
    channel = F.split("volume_id", "/")[1].alias("channel")
    lo, hi = _inner_box(dims)
    held = ch.chunk_range(n.withColumn("volume_id", F.concat_ws("/", "volume_id", "channel")), lo, hi, CHUNK)
    v = ch.explode_chunks(held, CHUNK, lo=lo, hi=hi)
    return _inner(v, dims).groupBy(channel, "place", F.col("v").cast("int").alias("v")).agg(F.count(F.lit(1)).alias("voxels"))


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    """One seed per sheet: the middle of its rows, half a voxel off the surface."""
    p = parts(spark, folder).withColumn("patch", F.floor(F.col("y") / 25).cast("long"))
    mid = p.where((F.pmod("y", F.lit(25)) == 12) & (F.col("x") == 20))
    return mid.select("patch", (F.col("z0") + 0.5).alias("z"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))


#: The plane cut into volumes of 25 rows.
ROWS = 25


def _planes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, tuple[int, int, int]]:
    """Chunks of one volume per 25 rows of the plane, and a seed over the middle of each: three voxels above the crest."""
    p = parts(spark, folder)
    number = F.floor(F.col("y") / ROWS).cast("long")
    own = p.select(number.alias("patch"), F.concat(F.lit("plane"), number.cast("string")).alias("volume_id"), F.lit(0).alias("level"), F.pmod("y", F.lit(ROWS)).cast("int").alias("y"), "x")
    v = own.withColumn("z", F.explode(F.sequence(F.lit(10), F.lit(75))))
    off = F.col("z") - 24 - F.col("x")
    v = v.select("volume_id", "level", "z", "y", "x", F.rint(200 * F.exp(-0.3 * off * off)).cast("smallint").alias("v"))
    seeds = own.where((F.col("y") == 12) & (F.col("x") == 19)).withColumn("z", F.col("x") + 27)
    return ch.lay_out(ch.to_chunks(v, CHUNK)), seeds, (88, ROWS, 40)


_BALL = f"""SELECT s.patch, dz, dy, dx FROM (SELECT (p_partkey // 40 // {ROWS})::BIGINT AS patch, max(p_partkey // 40 % {ROWS}) AS last FROM part GROUP BY ALL) s, range(-14, 15) a(dz), range(-14, 15) b(dy), range(-14, 15) c(dx)
 WHERE dz * dz + dy * dy + dx * dx <= 196 AND abs(1 + dz - dx) <= 1 AND 12 + dy BETWEEN 0 AND s.last AND s.last >= 12"""


@query(
    f"""WITH m AS (SELECT patch, count(*) AS voxels, var_samp(dz) AS zz, var_samp(dx) AS xx, var_samp(dy) AS yy, covar_samp(dz, dx) AS zx FROM ({_BALL}) GROUP BY patch)
 SELECT 'plane' || patch AS volume_id, patch, 45.0::DOUBLE AS pz, 12.0::DOUBLE AS py, 20.0::DOUBLE AS px, round(sqrt(2), 6) AS distance, voxels, round(sqrt(0.5), 4) AS nz, 0.0::DOUBLE AS ny, round(-sqrt(0.5), 4) AS nx,
 round((zz - 2 * zx + xx) / 2 / least(yy, (zz + 2 * zx + xx) / 2), 6) AS planarity FROM m"""
)
def seed_frames(spark, folder):
    """Frames on the planes: the snapped place, the normal turned up, and the covariance's axes, which the lattice of the ball gives in SQL."""
    chunks, seeds, _ = _planes(spark, folder)
    f = growth.seed_frames(seeds, chunks, CHUNK)
    up = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    return f.select("volume_id", "patch", *(r(p).alias(p) for p in growth.P), r("distance").alias("distance"), "voxels", *(r(F.col(n) * up, 4).alias(n) for n in growth.N), r("planarity").alias("planarity"))


@query(
    f"""SELECT 'plane' || (p_partkey // 40 // {ROWS}) AS volume_id, (p_partkey // 40 // {ROWS})::BIGINT AS patch, true AS on_plane, true AS upright, true AS covers FROM part GROUP BY ALL HAVING max(p_partkey // 40 % {ROWS}) >= 12"""
)
def grow_patches(spark, folder):
    """Grows a patch in each volume, all in one call, at the registered size: whether the nodes lie on the plane, their normals across it, and their
    number within a fifth of what its area holds at a step of 4."""
    chunks, seeds, dims = _planes(spark, folder)
    frames = growth.seed_frames(seeds, chunks, CHUNK)
    nodes = growth.grow_patches(frames, chunks, dims, CHUNK)
    grown = nodes.where("ok and (i <> 0 or j <> 0)").join(seeds.select("patch", "volume_id"), ["patch", "volume_id"])
    rows = parts(spark, folder).groupBy(F.floor(F.col("y") / ROWS).cast("long").alias("patch")).agg((F.max(F.pmod("y", F.lit(ROWS))) + 1).alias("rows"))
    lean = F.abs(F.col("nz") - F.col("nx")) / 2**0.5
    out = grown.groupBy("volume_id", "patch").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("pz") - 24 - F.col("px")) / 2**0.5).alias("off"), F.min(lean).alias("lean")).join(rows, "patch")
    area = F.col("rows") / 4 * (40 * 2**0.5 / 4)
    return out.select("volume_id", "patch", (F.col("off") < 0.4).alias("on_plane"), (F.col("lean") > 0.99).alias("upright"), (F.abs(F.col("n") / area - 1) < 0.2).alias("covers"))


def _sheet_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping patches of 24 rows, one every 12: nodes (i, j) with their 3-D position."""
    p = parts(spark, folder)
    k = F.explode(F.array_distinct(F.array(F.floor(F.col("y") / 12) - 1, F.floor(F.col("y") / 12)))).alias("patch")
    n = p.select(k, "y", "x", "z0", "p_size").where("patch >= 0")
    return n.select("patch", (F.col("y") - 12 * F.col("patch")).cast("int").alias("i"), F.col("x").alias("j"), F.col("z0").alias("z"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "p_size")


PATCHES = f"SELECT patch, (y - 12 * patch)::INT AS i, x AS j, z0, y, x, p_size FROM (SELECT y, x, z0, p_size, unnest(list_distinct([y // 12 - 1, y // 12])) AS patch FROM ({PARTS})) WHERE patch >= 0"


@query(
    f"""WITH n AS ({PATCHES}), k AS (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY i, j) - 1 AS rn FROM n), h AS (SELECT a.patch AS a, b.patch AS b, count(*) AS hits FROM k b JOIN n a ON a.patch < b.patch AND a.y = b.y AND a.x = b.x WHERE b.rn % 3 = 0 GROUP BY ALL)
 SELECT a, b, hits, 1.0::DOUBLE AS m00, 0.0::DOUBLE AS m01, 12.0 * (b - a)::DOUBLE AS m02, 0.0::DOUBLE AS m10, 1.0::DOUBLE AS m11, 0.0::DOUBLE AS m12 FROM h WHERE hits >= 150"""
)
def overlap_links(spark, folder):
    links = stitch.overlap_links(_sheet_patches(spark, folder).drop("p_size"), reach=0.5)
    return links.select("a", "b", "hits", *[r(m).alias(m) for m in stitch.MAP])


def _frames(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    n = _sheet_patches(spark, folder)
    links = stitch.overlap_links(n.drop("p_size"), reach=0.5)
    scores = n.groupBy("patch").agg(F.avg("p_size").alias("ts"))
    return n, stitch.chain_frames(links, scores, 30)


@query(
    f"""WITH n AS ({PATCHES}), s AS (SELECT patch, avg(p_size) AS ts, count(*) AS c FROM n GROUP BY patch), k AS (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY i, j) - 1 AS rn FROM n),
 h AS (SELECT a.patch AS a, b.patch AS b FROM k b JOIN n a ON a.patch < b.patch AND a.y = b.y AND a.x = b.x WHERE b.rn % 3 = 0 GROUP BY ALL HAVING count(*) >= 150), m AS (SELECT DISTINCT a AS patch FROM h UNION SELECT b FROM h),
 root AS (SELECT patch AS root FROM s SEMI JOIN m USING (patch) ORDER BY ts DESC, patch LIMIT 1)
 SELECT root, patch, abs(patch - root)::INT AS ring, 12.0 * (patch - root)::DOUBLE AS row_shift, 0.0::DOUBLE AS col_shift FROM m, root"""
)
def chained_frames(spark, folder):
    """Patch frames chained to the best-scored patch: consecutive patches differ by twelve rows."""
    _, placed = _frames(spark, folder)
    return placed.select("root", "patch", "ring", r("m02").alias("row_shift"), r("m12").alias("col_shift"))


@query(
    f"""WITH n AS ({PATCHES}), s AS (SELECT patch, avg(p_size) AS ts FROM n GROUP BY patch), k AS (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY i, j) - 1 AS rn FROM n),
 h AS (SELECT a.patch AS a, b.patch AS b FROM k b JOIN n a ON a.patch < b.patch AND a.y = b.y AND a.x = b.x WHERE b.rn % 3 = 0 GROUP BY ALL HAVING count(*) >= 150), m AS (SELECT DISTINCT a AS patch FROM h UNION SELECT b FROM h),
 root AS (SELECT patch AS root FROM s SEMI JOIN m USING (patch) ORDER BY ts DESC, patch LIMIT 1)
 SELECT root, layer, (i + 12 * (patch - root))::INT AS y, j::INT AS x, round(avg(p_size), 6) AS v, count(*)::DOUBLE AS weight FROM n JOIN m USING (patch), root, (VALUES ('ink'), ('back')) l(layer) GROUP BY ALL"""
)
def stitch_mosaic(spark, folder):
    """Weighted mosaic of the chained patches; every canvas pixel shows the part size it was drawn from."""
    n, placed = _frames(spark, folder)
    face = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("face")
    images = n.select("patch", face, "i", "j", F.col("p_size").alias("v"), F.lit(True).alias("ok"))
    faces = n.select("patch").distinct().select("patch", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("n0"), F.lit("a").alias("side"))
    out = stitch.mosaic(images, placed, faces)
    # an edge that a fitted frame meets within rounding has no weight
    return out.select("root", "layer", "y", "x", r("v").alias("v"), r("weight").alias("weight")).where("weight > 0")


_SHIFTS = f"""WITH s AS MATERIALIZED ({STACK}), o AS MATERIALIZED (SELECT layer + 1 AS layer, y + 2 AS y, x - 1 AS x, least(v + (y * 7 + x * 3) % 5, 255) AS v FROM s), p AS MATERIALIZED (SELECT s.layer + dl AS layer, s.y + dy AS y, s.x + dx AS x, s.v AS a, dl, dy, dx FROM s, generate_series(-1, 1) a(dl), generate_series(-48, 48) b(dy), generate_series(-2, 2) c(dx) WHERE s.v > 0)
 SELECT dl::INT AS dlayer, dy::INT AS dy, dx::INT AS dx, count(*) AS n, round(covar_pop(a, v) * count(*) / sqrt(var_pop(a) * count(*) * var_pop(v) * count(*) + 1e-12), 6) + 0.0 AS ncc
 FROM p JOIN o USING (layer, y, x) WHERE v > 0 GROUP BY ALL"""


def _scan_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The image stack and the same stack moved by (1, 2, -1) with a small position-dependent gain."""
    s = stack(spark, folder)
    o = s.select((F.col("layer") + 1).alias("layer"), (F.col("y") + 2).alias("y"), (F.col("x") - 1).alias("x"), F.least(F.col("v") + F.pmod(F.col("y") * 7 + F.col("x") * 3, F.lit(5)), F.lit(255)).alias("v"))
    return s, o


def _all_shifts(spark: SparkSession, folder: str, method: str) -> DataFrame:
    a, b = _scan_pair(spark, folder)
    s = shift.shift_sums(a, b, [], ("layer", "y", "x"), (1, 48, 2), method=method)
    out = shift.shift_scores(s, [], ["dlayer", "dy", "dx"])
    return out.where("n > 0.5").select("dlayer", "dy", "dx", F.round("n").cast("long").alias("n"), r("ncc").alias("ncc"))


@query(_SHIFTS)
def shift_correlation(spark, folder):
    return _all_shifts(spark, folder, "direct")


@query(_SHIFTS)
def fft_shift(spark, folder):
    """The same table from one transform per block."""
    return _all_shifts(spark, folder, "fft")


@query(f"SELECT dlayer, dy, dx, ncc AS best FROM ({_SHIFTS}) ORDER BY ncc DESC, dlayer, dy, dx LIMIT 1")
def placement_search(spark, folder):
    """Two-stage search (pooled, then fine) finds the planted shift."""
    a, b = _scan_pair(spark, folder)
    one = F.lit(1).alias("k")
    out = shift.coarse_to_fine(a.select(one, "*"), b.select(one, "*"), ["k"], 1, 48)
    return out.select("dlayer", "dy", "dx", r("best").alias("best"))


@query(
    """WITH b AS (SELECT s_suppkey * 20 AS z0, s_suppkey * 20 + 20 AS z1, s_nationkey * 10 AS y0, s_nationkey * 10 + 25 AS y1, 0 AS x0, 30 AS x1 FROM supplier),
 l AS (SELECT z, y, x FROM b, LATERAL (SELECT unnest(generate_series(z0 + 3, z1 - 1, 7)) AS z), LATERAL (SELECT unnest(generate_series(y0 + 3, y1 - 1, 7)) AS y), LATERAL (SELECT unnest(generate_series(x0 + 3, x1 - 1, 7)) AS x)),
 k AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(',', '0', z::VARCHAR, y::VARCHAR, x::VARCHAR)), z, y, x) - 1 AS id FROM l) SELECT id, z, y::BIGINT AS y, x::INT AS x, (id % 4)::INT AS shard FROM k"""
)
def seed_lattice(spark, folder):
    s = table(spark, folder, "supplier")
    z = F.col("s_suppkey") * 20
    y = F.col("s_nationkey") * 10
    boxes = s.select(z.alias("z0"), (z + 20).alias("z1"), y.alias("y0"), (y + 25).alias("y1"), F.lit(0).alias("x0"), F.lit(30).alias("x1"))
    out = select.seed_lattice(boxes, 7, 4)
    return out.select("id", "z", F.col("y").cast("long").alias("y"), "x", "shard")


@query(f"SELECT cz, cy, cx, count(*) AS voxels FROM (SELECT z // 16 AS cz, y // 16 AS cy, x // 16 AS cx FROM ({SHEET}) WHERE v > 0) GROUP BY ALL")
def chunk_occupancy(spark, folder):
    """Non-zero voxels per stored chunk, counted inside the buffers."""
    v = ch.explode_chunks(sheet_chunks(spark, folder), CHUNK)
    out = v.groupBy(*ch.chunk_keys(CHUNK)).agg(F.count(F.lit(1)).alias("voxels"))
    return out


@query(
    f"""WITH s AS (SELECT (y // 25)::BIGINT AS patch, z0 + 0.5 AS sz, y AS sy, x AS sx FROM ({PARTS}) WHERE y % 25 = 12 AND x = 20), v AS (SELECT z, y, x FROM ({SHEET}) WHERE v > 127),
 d AS (SELECT patch, z, y, x, (z - sz) * (z - sz) + (y - sy) * (y - sy) + (x - sx) * (x - sx) AS d FROM s, v), k AS (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY d, z, y, x) AS k FROM d)
 SELECT patch, z, y, x, round(sqrt(d), 6) AS distance FROM k WHERE k = 1 AND sqrt(d) <= 14"""
)
def nearest_sheet(spark, folder):
    """Nearest bright voxel of every seed."""
    lit = sheet(spark, folder).where("v > 127").select(F.struct("z", "y", "x").alias("vid"), "z", "y", "x")
    seeds = _seeds(spark, folder)
    out = nearest.nearest(seeds, lit, ["z", "y", "x"], "patch", "vid", max_distance=14.0)
    return out.select("patch", "vid.z", "vid.y", "vid.x", r("distance").alias("distance"))


#: Side and depth of the placement stacks, their scale in um, and how the moved stack lies: voxels of 9.6 um, two to a pixel of the common grid.
SIDE, DEEP, UM, MOVED = 140, 84, 9.6, (4, 6, -4)


def _placement_stacks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Embedding values as images of 140 x 140 pixels, a segment each, drawn into five stacks: the reference, a moved copy, a thin one, one with bands
    of zeros and one with cut buffers. The last image may be incomplete. Returns levels and chunks."""
    g = grid(spark, folder)
    at = F.col("y").cast("long") * 64 + F.col("x")
    pixels = g.select(F.floor(at / SIDE**2).cast("string").alias("segment"), F.floor(F.pmod(at, F.lit(SIDE**2)) / SIDE).cast("int").alias("y"), F.pmod(at, F.lit(SIDE)).cast("int").alias("x"), "v")

    def draw(pdf):
        import numpy as np
        import pandas as pd

        image, lit = np.zeros((SIDE, SIDE)), np.zeros((SIDE, SIDE), bool)
        image[pdf["y"], pdf["x"]] = 30 * pdf["v"].clip(-1, 1)
        lit[pdf["y"], pdf["x"]] = True
        z, y, x = np.ogrid[:DEEP, :SIDE, :SIDE]

        def stack(dz: int, dy: int, dx: int):
            a, b, c = z - dz, y - dy, x - dx
            wave = 40 * np.sin(b / 4.7 + a / 9 + 0.004 * c * c) + 40 * np.sin(c / 5.3 - a / 4.1) + 30 * np.sin(a / 3.7 + 0.005 * b * b - c / 13)
            return np.clip(np.rint(128 + wave + np.roll(image, (dy, dx), (0, 1))[None]), 1, 255).astype(np.uint8) * lit

        base = stack(0, 0, 0)
        bands = base.copy()
        bands[:, (np.arange(SIDE) // 8) % 2 == 0] = 0
        rows = []
        for name, block in {"a_ref": base, "moved": stack(*MOVED), "thin": base[:6], "bands": bands, "cut": base}.items():
            full = np.zeros([-(-n // c) * c for n, c in zip(block.shape, CHUNK)], np.uint8)
            full[tuple(slice(0, n) for n in block.shape)] = block
            for k in np.ndindex(*(n // c for n, c in zip(full.shape, CHUNK))):
                data = full[tuple(slice(i * c, i * c + c) for i, c in zip(k, CHUNK))]
                if data.any():
                    rows.append((f"{pdf['segment'].iloc[0]}/{name}", 0, *k, data.tobytes()[: -1 if name == "cut" else None]))
        return pd.DataFrame(rows, columns=["volume_id", "level", "cz", "cy", "cx", "data"])

    chunks = pixels.groupBy("segment").applyInPandas(draw, "volume_id string, level int, cz int, cy int, cx int, data binary")
    stacks = F.explode(F.array(*(F.struct(F.lit(n).alias("stack"), F.lit(DEEP if n != "thin" else 6).alias("nz")) for n in ("a_ref", "moved", "thin", "bands", "cut")))).alias("s")
    levels = pixels.select("segment").distinct().select("segment", stacks).select("segment", "s.*")
    scales = [F.lit(UM).alias(f"s{a}") for a in "zyx"]
    levels = levels.select("segment", "stack", F.concat_ws("/", "segment", "stack").alias("volume_id"), F.lit(0).alias("level"), *scales, "nz", F.lit(SIDE).alias("ny"), F.lit(SIDE).alias("nx"))
    return levels, ch.lay_out(chunks)


@query(
    f"""WITH p AS (SELECT (y::BIGINT * 64 + x) // {SIDE**2} AS segment, count(*) AS n FROM ({{GRID}}) GROUP BY 1), w AS (SELECT segment::VARCHAR AS segment, y, x FROM p, range(63, 77) a(y), range(63, 77) b(x) WHERE n = {SIDE**2}),
 k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY md5(concat_ws(',', '0', y::VARCHAR, x::VARCHAR)), y, x)::INT AS k FROM w),
 o AS (SELECT * FROM (VALUES ('moved', 'ok', true, {MOVED[0] * UM}::DOUBLE, {MOVED[1] * UM}::DOUBLE, {MOVED[2] * UM}::DOUBLE), ('thin', 'skipped: too few layers or pixels', NULL, NULL, NULL, NULL),
  ('bands', 'skipped: under 90% data', NULL, NULL, NULL, NULL), ('cut', 'error: a chunk of 4095 bytes, not 4096', NULL, NULL, NULL, NULL)) t(other, status, found, dz_um, dy_um, dx_um))
 SELECT segment, other, k AS "window", round(y * {UM} - 300, 3) AS y_um, round(x * {UM} - 300, 3) AS x_um, status, found, round(dz_um, 3) AS dz_um, round(dy_um, 3) AS dy_um, round(dx_um, 3) AS dx_um FROM k, o WHERE k <= 6
 UNION ALL SELECT segment::VARCHAR, NULL, NULL, NULL, NULL, 'no reference data', NULL, NULL, NULL, NULL FROM p WHERE n < {SIDE**2}""".replace("{GRID}", GRID)
)
def placement_check(spark, folder):
    """Windows of 600 um of every segment, each other stack against the reference: shifts in um, skips and errors as rows."""
    levels, chunks = _placement_stacks(spark, folder)
    out = placement.placement_check(levels, chunks, CHUNK, windows=6, size_um=600.0)
    found = (F.col("best") > 0.8).alias("found")
    return out.select("segment", "other", "window", r("y_um", 3).alias("y_um"), r("x_um", 3).alias("x_um"), "status", found, *(r(f"d{a}_um", 3).alias(f"d{a}_um") for a in "zyx"))
