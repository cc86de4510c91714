"""Nearest joins, overlaps, fits and mesh geometry against brute force and planted truth."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import components, fits, geometry, nearest

XYZ = ["x", "y", "z"]


def frame(spark, points, name):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], f"{name} long, x double, y double, z double")


@pytest.fixture(scope="module")
def clouds():
    """A wide cloud with a very dense cluster, duplicates included."""
    rng = np.random.default_rng(0)
    targets = np.concatenate([rng.normal(size=(600, 3)) * 100, rng.normal(size=(600, 3)) * 0.01 + 50, np.repeat([[1.0, 2, 3]], 400, 0)])
    queries = np.concatenate([rng.normal(size=(150, 3)) * 120, targets[:40], np.repeat([[1.0, 2, 3]], 60, 0)])
    return queries, targets


def test_nearest_is_exact_for_clusters_and_copies(spark, clouds):
    q, t = clouds
    got = {r.q: (r.t, r.distance) for r in nearest.nearest(frame(spark, q, "q"), frame(spark, t, "t"), XYZ, "q", "t").collect()}
    d = ((q[:, None] - t[None]) ** 2).sum(-1)
    assert [got[i][0] for i in range(len(q))] == d.argmin(1).tolist()
    assert np.allclose([got[i][1] for i in range(len(q))], np.sqrt(d.min(1)))


def test_within_keeps_everyone(spark, clouds):
    q, t = clouds
    rows = nearest.within(frame(spark, q, "q"), frame(spark, t, "t"), XYZ, "q", "t", 20.0, clamp=True).collect()
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(-1).min(1))
    assert np.allclose([r.distance for r in sorted(rows)], np.minimum(d, 20.0))


def test_guard_drops_close_groups(spark):
    members = spark.createDataFrame([(0, "far", 0.0), (1, "far", 1.0), (2, "near", 8.5), (3, "near", 0.0)], "m long, g string, x double")
    held = spark.createDataFrame([(0, 9.0)], "h long, x double")
    assert [r.g for r in nearest.guarded_groups(members, held, ["x"], "m", "h", "g", 1.0).collect()] == ["far"]


@pytest.mark.parametrize("crowded", [1, 10_000])
def test_shared_pairs_with_a_crowded_group(spark, crowded):
    rng = np.random.default_rng(1)
    rows = {(int(a), int(b)) for a, b in rng.integers(0, 40, (500, 2))} | {(m, 99) for m in range(40)}
    df = spark.createDataFrame(list(rows), "m long, g long")
    got = {(r.a, r.b): r.shared for r in nearest.shared_group_pairs(df, "m", "g", 6, crowded).collect()}
    sets = {}
    for m, g in rows:
        sets.setdefault(m, set()).add(g)
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 6}
    assert got == want


def test_affine_fit_residuals_and_leave_one_out(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    y = x @ rng.normal(size=(3, 3)).T + [1, 2, 3] + rng.normal(size=(40, 3)) * 0.1
    df = spark.createDataFrame([("k", *map(float, a), *map(float, b)) for a, b in zip(x, y)], "k string, x double, y double, z double, u double, v double, w double")
    got = fits.landmark_errors(df, ["k"], XYZ, ["u", "v", "w"]).first()
    a = np.c_[x, np.ones(40)]
    m, *_ = np.linalg.lstsq(a, y, rcond=None)
    e = np.linalg.norm(a @ m - y, axis=1)
    loo = []
    for i in range(40):
        keep = np.arange(40) != i
        mi, *_ = np.linalg.lstsq(a[keep], y[keep], rcond=None)
        loo.append(np.linalg.norm(a[i] @ mi - y[i]))
    assert np.allclose([got.rms, got.max_res, got.loo_rms], [np.sqrt((e**2).mean()), e.max(), np.sqrt(np.mean(np.square(loo)))])


def test_trimmed_fit_drops_the_outlier(spark):
    rows = [("s", float(y), float(x), 3 + 0.01 * y, -2 + 0.02 * x) for y in range(0, 400, 100) for x in range(0, 300, 100)]
    rows[5] = (*rows[5][:3], 40.0, 40.0)
    df = spark.createDataFrame(rows, "s string, cy double, cx double, dy double, dx double")
    # one far outlier pulls the first fit; a wide first limit still removes only it
    fit = fits.trimmed_fit(df, ["s"], ["cy", "cx"], ["dy", "dx"], 20.0).first()
    assert fit.points == 12 and fit.used == 11 and fit.rms < 1e-9
    assert np.isclose(fit.a_dy_cy, 0.01) and np.isclose(fit.a_dx_cx, 0.02)


def test_singular_values_and_frames(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(5, 3, 3))
    df = spark.createDataFrame([(i, [float(v) for v in a.ravel()]) for i, a in enumerate(m)], "i int, m array<double>")
    got = [r.s for r in df.select("i", fits.singular_values_3x3("m").alias("s")).orderBy("i").collect()]
    assert np.allclose(got, np.linalg.svd(m, compute_uv=False))
    plane = np.c_[rng.normal(size=(300, 2)) * 5, rng.normal(size=300) * 0.01]
    local = fits.local_frame(frame(spark, plane, "i").withColumn("g", F.lit(1)), ["g"], XYZ).first()
    assert abs(local.normal[2]) > 0.999 and local.planarity < 1e-3


def planes(spark, shift=(0.0, 0.0)):
    rows = []
    for i in range(12):
        for j in range(10):
            ii, jj = i + shift[0], j + shift[1]
            rows.append((i, j, 20.0 * jj, 20.0 * ii, 3.0 * ii + 2.0 * jj + 50, True))
    return spark.createDataFrame(rows, "i int, j int, x double, y double, z double, valid boolean")


def test_carry_recovers_sub_cell_positions(spark):
    a, b = planes(spark), planes(spark, (0.3, -0.2))
    q = b.where("i < 11 and j > 0").select(F.struct("i", "j").alias("qid"), *XYZ)
    got = geometry.carry_positions(q, a, "qid").collect()
    assert len(got) == 11 * 9 and all(r.carried for r in got)
    assert max(abs(r.u - (r.qid.i + 0.3)) for r in got) < 0.02 and max(abs(r.v - (r.qid.j - 0.2)) for r in got) < 0.02
    assert max(r.residual for r in got) < 0.05


def test_differences_and_scale(spark):
    mesh = planes(spark).where("not (i = 5 and j = 5)")
    d = {(r.i, r.j): r for r in geometry.differences(mesh, [], ["z"], tile=4).collect()}
    assert len(d) == 119 and all(np.isclose(r.du_z, 3) and np.isclose(r.dv_z, 2) for r in d.values())
    ends = {(r.i, r.j): r for r in geometry.differences(planes(spark), [], ["z"], "ends", tile=5).collect()}
    assert all(np.isclose(r.du_z, 6) and np.isclose(r.dv_z, 4) for r in ends.values())
    n = geometry.grid_normals(planes(spark), []).first()
    assert np.isclose(n.nx**2 + n.ny**2 + n.nz**2, 1)


def test_affine_round_trip(spark):
    m = [[0.8, -0.5, 0.1, 12.0], [0.5, 0.9, 0.0, -7.5], [0.05, 0.0, 1.1, 3.25]]
    p = frame(spark, np.random.default_rng(5).normal(size=(20, 3)), "i")
    there = p.select("i", *[c.alias(n) for c, n in zip(geometry.affine_apply(m), XYZ)])
    back = there.select("i", *[c.alias(f"b{n}") for c, n in zip(geometry.affine_apply(geometry.affine_invert(m)), XYZ)]).join(p, "i")
    assert all(np.allclose([r.bx, r.by, r.bz], [r.x, r.y, r.z]) for r in back.collect())


@pytest.mark.parametrize("ranges", [None, 3])
def test_axis_interpolation(spark, ranges):
    cps = spark.createDataFrame([("s", 0.0, 1.0), ("s", 10.0, 3.0), ("s", 20.0, 9.0), ("one", 5.0, 4.0)], "s string, z double, v double")
    q = spark.createDataFrame([(0, "s", -5.0), (1, "s", 5.0), (2, "s", 25.0), (3, "one", 99.0), (4, "one", -9.0), (5, "s", 20.0), (6, "s", 10.0)], "q int, s string, z double")
    got = {r.q: r.v for r in geometry.interpolate_axis(cps, q, ["s"], "z", ["v"], "q", ranges).collect()}
    assert got == {0: 0.0, 1: 2.0, 2: 12.0, 3: 4.0, 4: 4.0, 5: 9.0, 6: 3.0}


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 160)] + [(200, 201)]
    got = {r.node: r.component for r in components.graph_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(31)) and all(got[k] == 100 for k in range(100, 160)) and got[201] == 200


def test_smooth_grid_fills_holes(spark):
    rng = np.random.default_rng(6)
    ok = rng.random((14, 13)) > 0.3
    ok[:9, :9] = False
    z = rng.normal(size=ok.shape) + 5
    rows = [(i, j, float(z[i, j]) if ok[i, j] else -1.0, bool(ok[i, j])) for i, j in np.ndindex(ok.shape)]
    mesh = spark.createDataFrame(rows, "i int, j int, z double, valid boolean")
    got = geometry.smooth_grid(mesh, [], cols=["z"]).toPandas()
    from voxtable.operators.stats import gaussian_taps

    t = np.array(gaussian_taps(1.0))
    h = len(t) // 2

    def blur(a):
        w = np.pad(a, h, mode="symmetric")
        return sum(t[p] * t[q] * w[p : p + a.shape[0], q : q + a.shape[1]] for p in range(len(t)) for q in range(len(t)))

    den = blur(ok.astype(float))
    want = np.where(den > 0.05, blur(np.where(ok, z, 0)) / np.maximum(den, 1e-6), np.nan)
    known = np.argwhere(den > 0.05)
    assert len(got) == ok.size and (den <= 0.05).any()
    for r in got.itertuples():
        if den[r.i, r.j] > 0.05:
            assert np.isclose(r.z, want[r.i, r.j])
        else:
            d = ((known - [r.i, r.j]) ** 2).sum(1)
            assert any(np.isclose(r.z, want[tuple(k)]) for k in known[d == d.min()])


def test_nearest_with_a_dense_cluster_a_far_query_and_equal_points(spark):
    rng = np.random.default_rng(11)
    cluster = rng.normal(0, 1e-6, (3_000, 3))
    spread = rng.uniform(-1e4, 1e4, (500, 3))
    points = np.concatenate([cluster, spread, np.full((1, 3), 7.0)])
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    equal = spark.range(100_000).select((F.col("id") + 10_000).alias("tid"), *(F.lit(7.0).alias(c) for c in "zyx"))
    targets = spark.createDataFrame(rows, "tid long, z double, y double, x double").unionByName(equal)
    asked = np.concatenate([rng.normal(0, 1e-6, (200, 3)), rng.uniform(-1e4, 1e4, (100, 3)), [[1e7, 1e7, -1e7], [7.0, 7.0, 7.0]]])
    queries = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(asked)], "qid int, z double, y double, x double")
    got = {r.qid: r for r in nearest.nearest(queries, targets, list("zyx"), "qid", "tid").collect()}
    assert len(got) == len(asked) and got[301].tid == 3_500 and got[301].distance == 0
    for i, q in enumerate(asked):
        d = np.sqrt(((points - q) ** 2).sum(axis=1))
        assert np.isclose(got[i].distance, d.min(), rtol=1e-9) and np.isclose(d[got[i].tid], d.min(), rtol=1e-9)


def test_cubic_densify_goes_through_nodes_and_keeps_cubics(spark):
    """A spline through samples of a cubic is the cubic away from the border, whatever the tiles; nodes are kept everywhere."""
    f = lambda i, j: 0.002 * i**3 - 0.05 * i * j + 0.01 * j**2
    n = 90
    rows = [(i, j, float(f(i, j))) for i in range(n) for j in range(60)]
    df = spark.createDataFrame(rows, "i int, j int, z double")
    for tile in (256, 32):
        got = geometry.densify_cubic(df, [], 4, ["z"], tile=tile).toPandas()
        assert len(got) == 4 * (n - 1) * 4 * 59 and got.v.max() == 4 * (n - 1) - 1
        nodes = got[(got.v % 4 == 0) & (got.u % 4 == 0)]
        assert np.allclose(nodes.z, f(nodes.v / 4, nodes.u / 4), atol=1e-8)
        inner = got[got.v.between(100, 4 * n - 104) & got.u.between(100, 136)]
        assert np.allclose(inner.z, f(inner.v / 4, inner.u / 4), atol=1e-6)
    for a, total in ((a, sum(w for b, _, w in geometry.cubic_weights(4) if b == a)) for a in range(4)):
        assert np.isclose(total, 1.0), a


def test_nearest_collects_no_side_of_its_joins(spark):
    """Candidates and cells meet by shuffles: a broadcast goes through the driver and grows with the input."""
    right = spark.range(20000).selectExpr("id AS t", "cast(id % 200 as double) AS y", "cast(id div 200 as double) AS x")
    left = spark.range(50).selectExpr("id AS q", "id * 3.3 AS y", "id * 1.7 AS x")
    out = nearest.nearest(left, right, ["y", "x"], "q", "t")
    assert out.count() == 50
    with contextlib.redirect_stdout(io.StringIO()) as text:
        out.explain()
    assert "BroadcastHashJoin" not in text.getvalue() and "SortMergeJoin" in text.getvalue()


def test_shared_group_pairs_take_more_parts_for_more_rows(spark, monkeypatch):
    rows = [(int(m), int(g)) for g in range(300) for m in np.random.default_rng(g).integers(0, 40, 6)]
    members = spark.createDataFrame(rows, "m int, g int")
    want = {tuple(r) for r in nearest.shared_group_pairs(members, "m", "g", 3).collect()}
    monkeypatch.setattr(nearest, "PART_ROWS", 50)
    spread = nearest.shared_group_pairs(members, "m", "g", 3)
    assert {tuple(r) for r in spread.collect()} == want and len(want) > 100
    held = {tuple(sorted({m for m, g in rows if g == k})) for k in range(300)}
    pairs = sum(len(x) * (len(x) - 1) // 2 for x in held)
    assert spread.rdd.getNumPartitions() >= pairs // 50 > 8


def test_parts_of_a_nearest_join_follow_the_queries(spark, monkeypatch):
    """A task holds the candidates of so many queries, however many there are, and they are dealt out once a level."""
    monkeypatch.setattr(nearest, "PART_ROWS", 512)
    rng = np.random.default_rng(5)
    q, t = rng.random((100, 3)), rng.random((3000, 3))
    left = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(q)], "qid long, x double, y double, z double")
    right = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(t)], "tid long, x double, y double, z double")
    out = nearest.nearest(left, right, ["x", "y", "z"], "qid", "tid")
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(__qid#" in line]
    assert any(", 25)" in line for line in dealt) and not any("normalized" in line for line in dealt)
    far = ((q[:, None] - t[None]) ** 2).sum(axis=2)
    assert {r.qid: r.tid for r in out.collect()} == dict(enumerate(far.argmin(axis=1).tolist()))


def test_a_query_knows_a_near_target_before_it_walks(spark, monkeypatch):
    """The walk starts from the distance of a target at hand, so that few cells can still win; without it most cells of a level were dealt out."""
    kept, plain = {}, nearest.stored
    monkeypatch.setattr(nearest, "stored", lambda df, name="table": kept.setdefault(name, plain(df, name)))
    rng = np.random.default_rng(8)
    t = np.concatenate([rng.normal(c, 0.1, (1500, 3)) for c in (0.0, 0.6)])
    q = np.concatenate([rng.normal(0.3, 0.3, (300, 3)), [[9.0, 9.0, 9.0]]])
    left = spark.createDataFrame([(k % 2, k, *map(float, p)) for k, p in enumerate(q)], "g int, qid long, x double, y double, z double")
    right = spark.createDataFrame([(k % 2, k, *map(float, p)) for k, p in enumerate(t)], "g int, tid long, x double, y double, z double")
    got = {r.qid: r.tid for r in nearest.nearest(left, right, ["x", "y", "z"], "qid", "tid", ["g"]).collect()}
    far = ((q[:, None] - t[None]) ** 2).sum(axis=2)
    far[(np.arange(len(q)) % 2)[:, None] != (np.arange(len(t)) % 2)[None]] = np.inf
    assert got == dict(enumerate(far.argmin(axis=1).tolist()))
    best = {r["__qid"]: r["__best"] for r in kept["bounds"].collect()}
    ratio = np.array([best[k] for k in range(len(q))]) / far.min(axis=1)
    assert ratio.min() >= 1 - 1e-12 and np.median(ratio) < 1.5
