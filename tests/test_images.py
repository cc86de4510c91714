"""Raster, selection, component and shift operators against straightforward array code."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxtable.operators import components, profile, raster, select, shift, stats


def table(spark, a, name="v"):
    y, x = np.indices(a.shape)
    return spark.createDataFrame(pd.DataFrame({"y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), name: a.ravel()}))


def image(df, name, shape):
    out = np.full(shape, np.nan)
    p = df.toPandas()
    out[p["y"], p["x"]] = p[name].astype(float)
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(7).normal(size=(37, 29))


def test_gaussian_and_gradient_across_tiles(spark, noise):
    taps = np.array(stats.gaussian_taps(1.5))
    h = len(taps) // 2
    wide = np.pad(noise, h, mode="symmetric")
    want = sum(taps[a] * taps[b] * wide[a : a + 37, b : b + 29] for a in range(len(taps)) for b in range(len(taps)))
    got = image(raster.gaussian(table(spark, noise), [], ("y", "x"), "v", 1.5, tile=8), "smooth", noise.shape)
    assert np.allclose(got, want)
    g = raster.gradients(table(spark, noise), [], ("y", "x"), "v", tile=8)
    assert np.allclose(image(g, "g_y", noise.shape), np.gradient(noise, axis=0)) and np.allclose(image(g, "g_x", noise.shape), np.gradient(noise, axis=1))


def test_box_operators_across_tiles(spark, noise):
    got = raster.box_sum(table(spark, noise), [], 4, 3, {"s": F.sum, "m": F.max}, {"s": "v", "m": "v"}, tile=6)
    s, m = image(got, "s", noise.shape), image(got, "m", noise.shape)
    for y, x in ((0, 0), (11, 12), (36, 28), (5, 17)):
        part = noise[max(0, y - 2) : y + 2, max(0, x - 1) : x + 2]
        assert np.isclose(s[y, x], part.sum()) and np.isclose(m[y, x], part.max())


def flood(mask):
    seen, out = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        out += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                seen[a, b] = out
                todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return seen


def test_mask_components_across_tiles(spark, noise):
    mask = noise > -0.2
    want = flood(mask)
    got = components.mask_components(table(spark, noise).where("v > -0.2").select("y", "x"), [], tile=8).toPandas()
    pairs = {(want[y, x], (c["y"], c["x"])) for y, x, c in zip(got["y"], got["x"], got["component"])}
    assert len(got) == mask.sum() and len(pairs) == want.max() == len({c for _, c in pairs})


def test_text_score_matches_arrays(spark):
    rng = np.random.default_rng(8)
    img = rng.integers(1, 256, (60, 60))
    img[20:24, 20:29] = 255
    img[:, :3] = 0

    def cross(m, n, grow):
        for _ in range(n):
            w = np.pad(m, 1)
            parts = [w[1:-1, 1:-1], w[:-2, 1:-1], w[2:, 1:-1], w[1:-1, :-2], w[1:-1, 2:]]
            m = np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)
        return m

    um = 100.0
    valid = cross(cross(cross(img > 0, 2, True), 2, False), 3, False)
    lab = flood((img > 190) & valid)
    keep = 0
    for k in range(1, lab.max() + 1):
        y, x = np.nonzero(lab == k)
        across = max(y.max() - y.min() + 1, x.max() - x.min() + 1) * um / 1000
        keep += len(y) if 0.3 <= across <= 6 else 0
    got = components.text_score_side(table(spark, img), [], "v", um).first()
    assert got.valid_px == valid.sum() and got.kept_px == keep


def greedy(rows, sep, cap=None):
    kept = []
    for _, y, x in sorted((-v, y, x) for y, x, v in rows):
        if all(abs(y - a) >= sep or abs(x - b) >= sep for a, b in kept):
            kept.append((y, x))
    return kept[:cap]


@pytest.mark.parametrize("cap", [None, 5])
def test_greedy_matches_the_sequential_walk(spark, noise, cap):
    df = table(spark, np.round(noise, 1))
    got = select.greedy_separated(df, [], [-F.col("v")], 4, 4, cap, tile=16)
    rows = [(r.y, r.x, r.v) for r in df.collect()]
    want = greedy(rows, 4, cap)
    assert sorted((r.y, r.x) for r in got.collect()) == sorted(want)
    if cap:
        assert [(r.y, r.x) for r in got.orderBy("pick").collect()] == want


def test_densest_boxes_known_order(spark):
    ink = np.zeros((30, 30))
    ink[2:8, 3:9] = 1.0
    ink[15:21, 18:24] = 0.5
    got = select.densest_boxes(table(spark, ink), [], "v", 6, 6, 2).orderBy("pick").collect()
    assert [(r.y, r.x, r.density) for r in got] == [(2, 3, 1.0), (15, 18, 0.5)]


def test_even_sample_matches_linspace(spark):
    df = spark.range(1000).withColumn("g", F.lit(0))
    got = sorted(r.id for r in select.even_sample(df, ["g"], ["id"], 37).collect())
    assert got == np.linspace(0, 999, 37).astype(int).tolist()


@pytest.mark.parametrize("method", ["direct", "fft"])
def test_shift_search_finds_the_planted_shift(spark, method):
    rng = np.random.default_rng(9)
    vol = rng.integers(20, 250, (6, 40, 40))
    z, y, x = (c.ravel().astype("int32") for c in np.indices(vol.shape))
    ref = spark.createDataFrame(pd.DataFrame({"layer": z, "y": y, "x": x, "v": vol.ravel()}))
    other = ref.select((F.col("layer") + 1).alias("layer"), (F.col("y") - 2).alias("y"), (F.col("x") + 3).alias("x"), "v")
    s = shift.shift_scores(shift.shift_sums(ref, other, [], ("layer", "y", "x"), (1, 3, 3), tile=16, method=method), [], ["dlayer", "dy", "dx"])
    best = shift.best_shift(s, [], ["dlayer", "dy", "dx"]).first()
    assert (best.dlayer, best.dy, best.dx) == (1, -2, 3) and best.best > 0.99 > best.ncc0


def test_coarse_to_fine(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(5, 20, 20)).repeat(4, 1).repeat(4, 2) * 40 + 120
    z, y, x = (c.ravel().astype("int32") for c in np.indices(base.shape))
    ref = spark.createDataFrame(pd.DataFrame({"k": 1, "layer": z, "y": y, "x": x, "v": np.clip(base, 5, 250).astype(int).ravel()}))
    other = ref.select("k", "layer", (F.col("y") + 5).alias("y"), (F.col("x") - 3).alias("x"), "v")
    got = shift.coarse_to_fine(ref, other, ["k"], 1, 8).first()
    assert (got.dlayer, got.dy, got.dx) == (0, 5, -3) and got.best > 0.99 > got.ncc0


def test_histogram_match(spark):
    rng = np.random.default_rng(11)
    src = np.clip(rng.normal(90, 20, 4000), 1, 255).astype(int)
    ref = np.clip(rng.normal(140, 35, 4000), 1, 255).astype(int)
    a = spark.createDataFrame(pd.DataFrame({"layer": 0, "v": src}))
    b = spark.createDataFrame(pd.DataFrame({"layer": 0, "v": ref}))
    ha, hb = stats.histogram(a, ["layer"], "v"), stats.histogram(b, ["layer"], "v")
    lut = stats.histogram_lut(ha, hb, ["layer"]).orderBy("v").toPandas()
    assert lut["v2"].is_monotonic_increasing and lut["v2"].min() >= 1 and len(lut) == 256
    ca, cb = np.cumsum(np.bincount(src, minlength=256)) / 4000, np.cumsum(np.bincount(ref, minlength=256)) / 4000
    assert lut["v2"].tolist() == np.clip(np.searchsorted(cb, ca), 1, 255).tolist()
    moved = stats.remap(a.withColumn("m", F.lit(True)), stats.histogram_lut(ha, hb, ["layer"]), ["layer"], "v", "m").toPandas()["v"]
    assert abs(np.median(moved) - np.median(ref)) <= 2


def test_peaks_and_gaps(spark):
    p = [0.0, 1.0, 0.0, 0.5, 0.5, 0.0, 0.1, 0.0, 2.0, 1.9, 2.1, 0.0]
    df = spark.createDataFrame([(1, p)], "k int, profile array<double>")
    assert profile.find_peaks(df, ["k"], "profile", 0.2, 1).first().peaks == [1, 3, 8, 10]
    assert profile.find_peaks(df, ["k"], "profile", 0.2, 3).first().peaks == [1, 10] or profile.find_peaks(df, ["k"], "profile", 0.2, 3).first().peaks == [1, 4, 10]
    g = profile.gap_differences(profile.find_peaks(df, ["k"], "profile", 0.2, 1), ["k"]).first()
    assert g.gaps == [2.0, 5.0, 2.0] and np.isclose(g.gap_mean, 3) and np.isclose(g.gap_std, np.std([2, 5, 2]))


def test_tile_blend_covers_the_edge(spark):
    stack = spark.createDataFrame([(l, y, x, 100 + l) for l in range(2) for y in range(11) for x in range(9)], "layer int, y int, x int, v int")
    tiles = raster.to_tiles(stack, [], 4)
    origins = {(r.oy, r.ox) for r in tiles.select("oy", "ox").distinct().collect()}
    assert origins == {(a, b) for a in (0, 2, 4, 6, 7) for b in (0, 2, 4, 5)}
    out = raster.blend_tiles(raster.score_tiles(tiles, [], 4, 2, raster.default_scorer), [], 4).toPandas()
    assert len(out) == 99 and np.allclose(out["s"], 100.5 / 255)


def test_turns_match_rot90(spark, noise):
    df = table(spark, noise)
    h, w = (F.lit(k) for k in noise.shape)
    for k, mirror in ((0, False), (1, False), (2, False), (3, False), (0, True)):
        view = np.rot90(noise, k)
        view = view[:, ::-1] if mirror else view
        grid = spark.createDataFrame([(a, b) for a in range(view.shape[0]) for b in range(view.shape[1])], "vy int, vx int")
        sy, sx = raster.turn(F.col("vy"), F.col("vx"), h, w, k, mirror)
        got = grid.select("vy", "vx", sy.alias("y"), sx.alias("x")).join(df, ["y", "x"]).toPandas()
        assert len(got) == view.size and np.allclose(view[got["vy"], got["vx"]], got["v"])


def test_shift_sums_over_blocks_and_keys(spark):
    """Blocks of four times the reach, by transform and by loop, against plain sums on images with holes."""
    rng = np.random.default_rng(8)
    rows, images = [], {}
    for key in ("a", "b"):
        for side in (0, 1):
            image = rng.integers(0, 9, (70, 50)) * (rng.random((70, 50)) < 0.8)
            images[key, side] = image
            rows += [(key, side, int(y), int(x), float(image[y, x])) for y, x in zip(*np.nonzero(image))]
    df = spark.createDataFrame(rows, "k string, side int, y int, x int, v double")
    for method in ("fft", "direct"):
        got = shift.shift_sums(df.where("side = 0"), df.where("side = 1"), ["k"], ("y", "x"), (5, 3), tile=16, method=method).collect()
        assert len(got) == 2 * 11 * 7
        for r in got:
            a = np.pad(images[r.k, 0], 6)
            b = np.roll(np.pad(images[r.k, 1], 6), (-r.dy, -r.dx), (0, 1))
            both = (a > 0) & (b > 0)
            want = [both.sum(), a[both].sum(), b[both].sum(), (a[both] ** 2).sum(), (b[both] ** 2).sum(), (a[both] * b[both]).sum()]
            assert np.allclose([r[n] for n in shift.SUMS], want), (method, r)


@pytest.mark.parametrize("sep, tile", [((3, 3), 16), ((5, 2), 24)])
def test_a_chain_of_picks_takes_rounds_by_tiles(spark, monkeypatch, sep, tile):
    """On a slope every pick hangs on the one before it: one walk from end to end, in as many rounds as tiles are crossed."""
    from voxtable.operators import select as sel

    rounds, plain = [], sel.map_tiles
    monkeypatch.setattr(sel, "map_tiles", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    cells = [(y, x, 100 * x + 7 * y) for y in range(12) for x in range(96)]
    df = spark.createDataFrame(cells, "y int, x int, v int")
    got = {(r.y, r.x) for r in sel.greedy_separated(df, [], [F.col("v")], *sep, tile=tile).collect()}
    want: list[tuple[int, int]] = []
    for y, x, _ in sorted(cells, key=lambda c: (c[2], c[0], c[1])):
        if all(abs(y - b) >= sep[0] or abs(x - a) >= sep[1] for b, a in want):
            want.append((y, x))
    assert got == set(want)
    assert len(rounds) <= 2 * -(-96 // tile) < len({x for _, x in want})


def test_distance_transform_is_the_brute_force(spark):
    from voxtable.operators import distance

    rng = np.random.default_rng(4)
    images = {"sparse": rng.random((70, 33)) < 0.004, "dense": rng.random((40, 50)) < 0.3, "none": np.zeros((9, 8), bool), "one": np.zeros((90, 5), bool), "top": np.zeros((64, 20), bool)}
    images["one"][88, 1] = True
    images["top"][0] = True
    rows = [(k, int(y), int(x), bool(v)) for k, image in images.items() for (y, x), v in np.ndenumerate(image)]
    df = spark.createDataFrame(rows, "k string, y int, x int, lit boolean")
    for tile, strip in ((1024, 32), (8, 6), (1, 1)):
        got = distance.distance_transform(df, ["k"], "lit", tile=tile, strip=strip).toPandas()
        assert len(got) == len(rows)
        for k, image in images.items():
            part = got[got.k == k]
            at = np.argwhere(image)
            if len(at) == 0:
                assert part.distance.isna().all()
                continue
            want = np.sqrt(((part[["y", "x"]].to_numpy()[:, None] - at[None]) ** 2).sum(axis=2)).min(axis=1)
            assert np.allclose(part.distance.to_numpy(float), want), (k, tile)


def test_banding_at_a_small_angle(spark):
    y, x = np.indices((80, 90))
    at = y * np.cos(np.radians(8)) + x * np.sin(np.radians(8))
    v = np.where(np.floor(at / 6) % 2 == 0, 220.0, 130.0)
    got = raster.line_banding(table(spark, v), [], "v", 500.0).first()
    assert got.angle == 8 and got.ratio > 2 and abs(got.spacing_mm - 6.0) < 0.51
    # every pixel counts once, however it lies between two bands
    whole = raster.line_banding(table(spark, np.full((80, 90), 200.0)), [], "v", 500.0).first()
    assert whole.ratio < 50
