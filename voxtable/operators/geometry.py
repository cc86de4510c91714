"""Meshes, affine maps and index arithmetic on named coordinate columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.functions.columns import cross, norm
from voxtable.operators.fits import determinant, inverse
from voxtable.operators.nearest import nearest
from voxtable.operators.ordered import carry_forward, neighbours_in_order, percentiles, percentiles_of
from voxtable.operators.tiles import with_halo

XYZ = ("x", "y", "z")


def validity(rule: str = "positive", cols: Sequence[str] = XYZ) -> Column:
    """The validity conventions: ``positive`` (> 0), ``above_half`` (> -0.5), ``finite_x`` (x > 0 and all finite)."""
    if rule == "finite_x":
        out = F.col(cols[0]) > 0
        for c in cols:
            out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return out
    bound = {"positive": 0.0, "above_half": -0.5}[rule]
    out = F.col(cols[0]) > bound
    for c in cols[1:]:
        out = out & (F.col(c) > bound)
    return out


def mesh_from_planes(x: DataFrame, y: DataFrame, z: DataFrame, rule: str = "positive", keys: Sequence[str] = ()) -> DataFrame:
    """Zips three coordinate planes (keys, i, j, v) into one grid relation with a validity flag."""
    on = [*keys, "i", "j"]
    grid = x.select(*on, F.col("v").alias("x")).join(y.select(*on, F.col("v").alias("y")), on).join(z.select(*on, F.col("v").alias("z")), on)
    return grid.withColumn("valid", validity(rule))


def inside_volume(shape_xyz: Sequence[int], cols: Sequence[str] = XYZ, valid: str | None = None) -> Column:
    """Inclusive ``0 <= p <= n - 1``; with ``valid`` named, an invalid vertex passes."""
    out = None
    for c, n in zip(cols, shape_xyz):
        here = F.col(c).between(0, n - 1)
        out = here if out is None else out & here
    return out | ~F.col(valid) if valid else out


def cell_corners(mesh: DataFrame, keys: Sequence[str], carry: Sequence[str] = XYZ) -> DataFrame:
    """Cells whose four corners are all valid, with min/max of ``carry`` over the corners.

    Every vertex is sent to its four cells and the cells are aggregated: four rows per cell, whatever the mesh size.
    """
    to = F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j")) for a in (0, 1) for b in (0, 1)])
    sent = mesh.where("valid").select(*keys, *carry, F.explode(to).alias("c")).groupBy(*keys, F.col("c.i").alias("i"), F.col("c.j").alias("j"))
    spans = [f(c).alias(f"{t}_{c}") for c in carry for t, f in (("min", F.min), ("max", F.max))]
    return sent.agg(F.count(F.lit(1)).alias("corners"), *spans).where("corners = 4").drop("corners")


def affine_apply(matrix: Sequence[Sequence[Column | float]], cols: Sequence[str] = XYZ) -> list[Column]:
    """``A p + t`` for a 3x4 matrix of numbers or columns."""
    m = [[v if isinstance(v, Column) else F.lit(float(v)) for v in row] for row in matrix]
    return [row[0] * F.col(cols[0]) + row[1] * F.col(cols[1]) + row[2] * F.col(cols[2]) + row[3] for row in m[:3]]


def affine_invert(matrix: Sequence[Sequence[Column | float]]) -> list[list[Column]]:
    """Inverse 3x4 matrix as columns; NULL when singular."""
    m = [[v if isinstance(v, Column) else F.lit(float(v)) for v in row] for row in matrix]
    a = [row[:3] for row in m[:3]]
    det = determinant(a)
    inv = inverse(a, F.when(det != 0, det))
    shift = [-(r[0] * m[0][3] + r[1] * m[1][3] + r[2] * m[2][3]) for r in inv]
    return [[*r, s] for r, s in zip(inv, shift)]


def affine_compose(outer: Sequence[Sequence[Column | float]], inner: Sequence[Sequence[Column | float]]) -> list[list[Column]]:
    """``outer`` after ``inner``."""
    o = [[v if isinstance(v, Column) else F.lit(float(v)) for v in row] for row in outer]
    n = [[v if isinstance(v, Column) else F.lit(float(v)) for v in row] for row in inner]
    out = []
    for r in range(3):
        row = [o[r][0] * n[0][c] + o[r][1] * n[1][c] + o[r][2] * n[2][c] for c in range(4)]
        row[3] = row[3] + o[r][3]
        out.append(row)
    return out


def pixel_centre_index(p: Column, k: float, shift: Column | float = 0.0) -> Column:
    """Index on a grid ``k`` times finer: pixel centres map to ``(p - shift + 0.5) k - 0.5``, rounded half to even."""
    s = shift if isinstance(shift, Column) else F.lit(float(shift))
    return F.rint((p - s + 0.5) * k - 0.5).cast("int")


def differences(mesh: DataFrame, keys: Sequence[str], cols: Sequence[str], rule: str = "holes", tile: int = 64) -> DataFrame:
    """Adds ``du_<c>`` (along i) and ``dv_<c>`` (along j).

    ``holes``: mean of the forward and backward step, one-sided next to a hole or edge, NULL if neither exists.
    ``ends``: ``next - previous``, doubled one-sided at the ends.
    """
    tiled = with_halo(mesh, keys, {"i": (tile, 1), "j": (tile, 1)})
    out = tiled
    for axis, other, prefix in (("i", "j", "du"), ("j", "i", "dv")):
        w = Window.partitionBy(*keys, "t_i", "t_j", other).orderBy(axis)
        prev_at, next_at = F.lag(axis).over(w) == F.col(axis) - 1, F.lead(axis).over(w) == F.col(axis) + 1
        for c in cols:
            back = F.when(prev_at, F.col(c) - F.lag(c).over(w))
            fwd = F.when(next_at, F.lead(c).over(w) - F.col(c))
            if rule == "ends":
                value = F.when(back.isNotNull() & fwd.isNotNull(), back + fwd).otherwise(2 * F.coalesce(back, fwd))
            else:
                value = F.coalesce((back + fwd) / 2, back, fwd)
            out = out.withColumn(f"{prefix}_{c}", value)
    return out.where("core").drop("core", "t_i", "t_j")


def grid_normals(mesh: DataFrame, keys: Sequence[str], tile: int = 64) -> DataFrame:
    """Unit normals ``nx, ny, nz`` = (d/dj) x (d/di), differences doubled one-sided at the ends."""
    d = differences(mesh, keys, XYZ, "ends", tile)
    n = cross([f"dv_{c}" for c in XYZ], [f"du_{c}" for c in XYZ])
    size = norm(n) + 1e-9
    out = d.withColumns({f"n{c}": v / size for c, v in zip(XYZ, n)})
    return out.select(*mesh.columns, "nx", "ny", "nz")


def densify_cells(mesh: DataFrame, keys: Sequence[str], k: int, cols: Sequence[str] = XYZ) -> DataFrame:
    """k x k bilinear sub-points of every cell with four valid corners, plus the valid vertices."""
    parts = []
    for a in (0, 1):
        for b in (0, 1):
            parts.append(F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(a).alias("a"), F.lit(b).alias("b")))
    sent = mesh.where("valid").select(*keys, *cols, F.explode(F.array(*parts)).alias("c"))
    corner = {(a, b): [F.max(F.when((F.col("c.a") == a) & (F.col("c.b") == b), F.col(v))).alias(f"{v}{a}{b}") for v in cols] for a in (0, 1) for b in (0, 1)}
    cells = sent.groupBy(*keys, F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(
        F.count(F.lit(1)).alias("corners"), *[c for group in corner.values() for c in group]
    ).where("corners = 4")
    sub = cells.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    a, b = F.col("p") / k, F.col("q") / k
    fine = [
        ((1 - a) * (1 - b) * F.col(f"{v}00") + a * (1 - b) * F.col(f"{v}10") + (1 - a) * b * F.col(f"{v}01") + a * b * F.col(f"{v}11")).alias(v)
        for v in cols
    ]
    inner = sub.select(*keys, (F.col("i") + a).alias("u"), (F.col("j") + b).alias("v"), F.lit("cell").alias("kind"), *fine)
    nodes = mesh.where("valid").select(*keys, F.col("i").cast("double").alias("u"), F.col("j").cast("double").alias("v"), F.lit("vertex").alias("kind"), *cols)
    return inner.unionByName(nodes)


#: Beyond so many nodes a cubic cardinal spline has died down below 1e-12 of its value.
SPLINE_REACH = 22


def cubic_weights(step: int) -> list[tuple[int, int, float]]:
    """(a, k, w): what node k adds to the value at a / step between nodes 0 and 1, for the cubic spline through all nodes.

    The spline's coefficients are the nodes filtered by sqrt(3) z^|n|, z = sqrt(3) - 2 (the inverse of 1/6, 4/6, 1/6); its values are the coefficients weighed by the B-spline.
    """
    z = 3**0.5 - 2

    def basis(t: float) -> float:
        t = abs(t)
        return 2 / 3 - t * t + t**3 / 2 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0

    out = []
    for a in range(step):
        near = [(m, basis(a / step - m)) for m in (-1, 0, 1, 2)]
        out += [(a, k, sum(b * 3**0.5 * z ** abs(k - m) for m, b in near)) for k in range(-SPLINE_REACH, SPLINE_REACH + 1)]
    return out


def densify_cubic(grid: DataFrame, keys: Sequence[str], step: int, cols: Sequence[str] = XYZ, tile: int = 64) -> DataFrame:
    """Points (v, u) = 0 .. step * (n - 1) - 1 of the cubic spline through a grid that stores every node (i, j); the border's nodes go on outside it.

    Tiles carry a halo in which the spline's memory of further nodes dies down, so that the tiles agree to rounding. ``smooth_grid`` fills holes before.
    """
    from voxtable.operators.raster import map_tiles

    keys = list(keys)
    weights = cubic_weights(step)

    def kernel(block):
        import numpy as np

        taps = np.zeros((step, 2 * SPLINE_REACH + 1))
        for a, k, w in weights:
            taps[a, k + SPLINE_REACH] = w
        wide = np.pad(block, SPLINE_REACH, mode="edge")
        h, w = block.shape
        rows = np.stack([sum(t * wide[k : k + h] for k, t in enumerate(tap)) for tap in taps])
        fine = np.stack([np.stack([sum(t * row[:, k : k + w] for k, t in enumerate(tap)) for tap in taps]) for row in rows])
        return {"fine": np.moveaxis(fine.reshape(step * step, h, w), 0, -1)}

    last = grid.groupBy(*keys).agg(F.max("i").alias("__i"), F.max("j").alias("__j"))
    out = None
    for c in cols:
        part = map_tiles(grid, keys, ("i", "j"), c, tile, SPLINE_REACH + 2, kernel, {"fine": "array<double>"})
        part = part.select(*keys, "i", "j", F.posexplode("fine").alias("__k", c))
        out = part if out is None else out.join(part, [*keys, "i", "j", "__k"])
    out = out.join(last, keys) if keys else out.withColumns({k: last.select(k).scalar() for k in ("__i", "__j")})
    out = out.where((F.col("i") < F.col("__i")) & (F.col("j") < F.col("__j")))
    at = {"v": F.col("i") * step + F.floor(F.col("__k") / step), "u": F.col("j") * step + F.col("__k") % step}
    return out.select(*keys, *(e.cast("int").alias(n) for n, e in at.items()), *cols)


def carry_positions(
    queries: DataFrame, mesh: DataFrame, query_id: str, keys: Sequence[str] = (), max_delta: float = 1.0, max_residual: float = 8.0
) -> DataFrame:
    """Sub-cell grid position (u, v) of each query point on a mesh: nearest vertex, then a 2x2 solve with its Jacobians.

    Carried when both steps are at most ``max_delta`` cells and the remaining distance at most ``max_residual``.
    """
    vertices = differences(mesh.where("valid"), keys, XYZ, "holes").withColumn("vid", F.struct("i", "j"))
    hit = nearest(queries, vertices, XYZ, query_id, "vid", keys).withColumnRenamed("distance", "vertex_distance")
    at = vertices.select(*keys, "vid", *[F.col(c).alias(f"p_{c}") for c in XYZ], *[f"d{t}_{c}" for t in "uv" for c in XYZ])
    j = queries.join(hit, [*keys, query_id]).join(at, [*keys, "vid"])
    d = [F.col(c) - F.col(f"p_{c}") for c in XYZ]
    u, v = [F.col(f"du_{c}") for c in XYZ], [F.col(f"dv_{c}") for c in XYZ]

    def dot3(a, b):
        return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    uu, uv, vv, ud, vd = dot3(u, u), dot3(u, v), dot3(v, v), dot3(u, d), dot3(v, d)
    det = uu * vv - uv * uv
    safe = F.when(F.abs(det) > 1e-12, det)
    j = j.withColumn("__du", (vv * ud - uv * vd) / safe).withColumn("__dv", (uu * vd - uv * ud) / safe)
    rest = [d[k] - F.col("__du") * u[k] - F.col("__dv") * v[k] for k in range(3)]
    j = j.withColumn("residual", norm(rest))
    ok = (F.abs("__du") <= max_delta) & (F.abs("__dv") <= max_delta) & (F.col("residual") <= max_residual)
    return j.select(
        *queries.columns, "vertex_distance", (F.col("vid.i") + F.col("__du")).alias("u"), (F.col("vid.j") + F.col("__dv")).alias("v"),
        "residual", F.coalesce(ok, F.lit(False)).alias("carried"),
    )


def cell_labels(pixels: DataFrame, keys: Sequence[str], size: int, label: str, carried: str) -> DataFrame:
    """Per cell of ``size`` x ``size`` pixels: the share of labelled ones, and whether all of its pixels are there and carried."""
    cell = [F.floor(F.col(a) / size).cast("int").alias(c) for a, c in (("y", "i"), ("x", "j"))]
    whole = (F.count(F.lit(1)) == size * size) & F.bool_and(carried)
    return pixels.groupBy(*keys, *cell).agg((F.sum(F.col(label).cast("double")) / (size * size)).alias("share"), whole.alias("all_carried"))


def padded_extent(usable: DataFrame, keys: Sequence[str], pad: int, height: str, width: str) -> DataFrame:
    """Half-open rows and columns of the usable cells (keys, y, x, and the grid's height and width), grown by ``pad`` and cut to the grid."""
    low = lambda a: F.greatest(F.min(a) - pad, F.lit(0))
    high = lambda a, n: F.least(F.max(a) + pad + 1, F.max(n))
    return usable.groupBy(*keys).agg(low("y").alias("y0"), high("y", height).alias("y1"), low("x").alias("x0"), high("x", width).alias("x1"))


def carry_labels(positions: DataFrame, mask: DataFrame, keys: Sequence[str] = (), per_cell: int = 20) -> DataFrame:
    """Label of each carried point: the mask pixel at ``rint(per_cell * u), rint(per_cell * v)``; absent pixels are False."""
    at = positions.withColumn("y", F.rint(F.col("u") * per_cell).cast("int")).withColumn("x", F.rint(F.col("v") * per_cell).cast("int"))
    true = mask.select(*keys, "y", "x").distinct().withColumn("__hit", F.lit(True))
    out = at.join(true, [*keys, "y", "x"], "left")
    return out.withColumn("label", F.col("carried") & F.coalesce("__hit", F.lit(False))).drop("__hit", "y", "x")


def local_scale(mesh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median over vertices of the two singular values of the local frame (step lengths along and across)."""
    d = differences(mesh.where("valid"), keys, XYZ, "holes")
    u, v = [F.col(f"du_{c}") for c in XYZ], [F.col(f"dv_{c}") for c in XYZ]
    uu, vv = sum((c * c for c in u[1:]), u[0] * u[0]), sum((c * c for c in v[1:]), v[0] * v[0])
    uv = u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    half, root = (uu + vv) / 2, F.sqrt(F.pow((uu - vv) / 2, 2) + uv * uv)
    s = d.withColumn("s1", F.sqrt(half + root)).withColumn("s2", F.sqrt(F.greatest(half - root, F.lit(0.0))))
    return percentiles_of(s, keys, {"s1": {"s1": 0.5}, "s2": {"s2": 0.5}})


def round_trip(a: DataFrame, b: DataFrame, keys: Sequence[str], names: Sequence[str] = ("i", "j")) -> DataFrame:
    """Point-to-point distance of two meshes on one grid: median, p99, n."""
    other = b.select(*keys, *names, *[F.col(c).alias(f"o_{c}") for c in XYZ])
    d = a.join(other, [*keys, *names]).withColumn("d", norm([F.col(c) - F.col(f"o_{c}") for c in XYZ]))
    stats = percentiles(d, keys, "d", {"median": 0.5, "p99": 0.99})
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return stats.join(n, list(keys)) if keys else stats.withColumn("n", n.scalar())


def index_offset(pairs: DataFrame, keys: Sequence[str], ratio_i: Column, ratio_j: Column) -> DataFrame:
    """Median fine-minus-coarse index offset of matched vertices (fi, fj, ai, aj)."""
    p = pairs.withColumn("di", F.col("fi") - F.col("ai") * ratio_i).withColumn("dj", F.col("fj") - F.col("aj") * ratio_j)
    return percentiles_of(p, keys, {"di": {"row_offset": 0.5}, "dj": {"col_offset": 0.5}})


def interpolate_axis(points: DataFrame, queries: DataFrame, keys: Sequence[str], z: str, values: Sequence[str], query_id: str, ranges: int | None = None) -> DataFrame:
    """As-of both ways: linear between the bracketing control points, linear extrapolation outside, constant if one point.

    Control points become segments that know both their ends; the first also serves what lies before it and the last
    but one what lies after. A query takes the segment that starts at or before it. Keys without control points drop out.
    """
    keys = list(keys)
    first = points.groupBy(*keys, z).agg(*[F.max(v).alias(v) for v in values])
    chained = neighbours_in_order(first, keys, [z], [z, *values], ranges)
    # the last control point reuses the segment that ends in it
    ends = chained.select(
        *keys,
        F.when(F.col(f"prev_{z}").isNull(), F.lit(float("-inf"))).otherwise(F.col(z)).cast("double").alias("__z"),
        F.struct(
            F.when(F.col(f"next_{z}").isNull() & F.col(f"prev_{z}").isNotNull(), F.col(f"prev_{z}")).otherwise(F.col(z)).alias("z0"),
            F.when(F.col(f"next_{z}").isNull(), F.when(F.col(f"prev_{z}").isNotNull(), F.col(z))).otherwise(F.col(f"next_{z}")).alias("z1"),
            *[F.when(F.col(f"next_{z}").isNull() & F.col(f"prev_{z}").isNotNull(), F.col(f"prev_{v}")).otherwise(F.col(v)).alias(f"{v}0") for v in values],
            *[F.when(F.col(f"next_{z}").isNull(), F.col(v)).otherwise(F.col(f"next_{v}")).alias(f"{v}1") for v in values],
        ).alias("__seg"),
        F.lit(0).alias("__kind"),
        F.lit(None).cast(queries.schema[query_id].dataType).alias(query_id),
    )
    asked = queries.select(*keys, F.col(z).cast("double").alias("__z"), F.lit(None).cast(ends.schema["__seg"].dataType).alias("__seg"), F.lit(1).alias("__kind"), query_id)
    met = carry_forward(ends.unionByName(asked), keys, ["__z", "__kind", query_id], "__seg", "__at", ranges).where("__kind = 1 and __at is not null")
    share = (F.col("__z") - F.col("__at.z0")) / (F.col("__at.z1") - F.col("__at.z0"))
    out = [F.when(F.col("__at.z1").isNull(), F.col(f"__at.{v}0")).otherwise(F.col(f"__at.{v}0") + (F.col(f"__at.{v}1") - F.col(f"__at.{v}0")) * share).alias(v) for v in values]
    return met.select(*keys, query_id, F.col("__z").alias(z), *out)


def claim_points(mesh: DataFrame, i0: int, i1: int, j0: int, j1: int, most: int) -> DataFrame:
    """Valid vertices of a half-open row and column range, at most ``most`` of them, evenly spaced in grid order."""
    from voxtable.operators.select import even_sample

    inside = (F.col("i") >= i0) & (F.col("i") < i1) & (F.col("j") >= j0) & (F.col("j") < j1)
    return even_sample(mesh.where(inside & F.col("valid")), [], ["i", "j"], most).drop("rn")


def near_extent(targets: DataFrame, points: DataFrame, margin: float = 60.0, cols: Sequence[str] = XYZ) -> DataFrame:
    """Targets inside the bounding box of ``points`` grown by ``margin`` on every side (one row of bounds, as scalars)."""
    box = points.agg(*[f(c).alias(f"{t}_{c}") for c in cols for t, f in (("lo", F.min), ("hi", F.max))])
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.col(c).between(box.select(F.col(f"lo_{c}") - margin).scalar(), box.select(F.col(f"hi_{c}") + margin).scalar())
    return targets.where(keep)


def smooth_grid(mesh: DataFrame, keys: Sequence[str], sigma: float = 1.0, floor: float = 0.05, cols: Sequence[str] = XYZ) -> DataFrame:
    """Grid with holes filled for sampling: Gaussian mean of the valid vertices around each node, and where those are too
    few (weight up to ``floor``) the values of the nearest filled node. Adds ``share``, the smoothed validity.

    ``mesh`` stores every node of its grid; ``valid`` marks the holes.
    """
    from voxtable.operators.raster import gaussian

    keys = list(keys)
    on = [*keys, "i", "j"]
    base = mesh.withColumn("share", F.col("valid").cast("double"))
    out = None
    for c in [*cols, "share"]:
        value = F.col("share") if c == "share" else F.when(F.col("valid"), F.col(c)).otherwise(0.0)
        part = gaussian(base.select(*on, value.alias("__g")), keys, ("i", "j"), "__g", sigma, f"g_{c}")
        out = part if out is None else out.join(part, on)
    known = F.col("g_share") > floor
    out = out.select(*on, F.col("g_share").alias("share"), *[F.when(known, F.col(f"g_{c}") / F.greatest("g_share", F.lit(1e-6))).alias(c) for c in cols])
    node = F.struct("i", "j").alias("node")
    full = out.where(F.col(cols[0]).isNotNull())
    holes = out.where(F.col(cols[0]).isNull()).select(*keys, node, "i", "j", "share")
    source = full.select(*keys, F.struct("i", "j").alias("from"), "i", "j")
    hit = nearest(holes, source, ["i", "j"], "node", "from", keys).select(*keys, "node", "from")
    values = full.select(*keys, F.struct("i", "j").alias("from"), *cols)
    filled = holes.join(hit, [*keys, "node"]).join(values, [*keys, "from"]).select(*on, "share", *cols)
    return full.select(*on, "share", *cols).unionByName(filled)
