"""Neighbourhood operators on pixel tables. Every one works on bounded tiles with a halo (see ``tiles``)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.operators.tiles import with_halo


def box_sum(df: DataFrame, keys: Sequence[str], size_y: int, size_x: int, exprs: Mapping[str, Callable[[Column], Column]], columns: Mapping[str, str], tile: int = 64) -> DataFrame:
    """Separable windowed aggregates over a ``size_y`` x ``size_x`` box around each pixel (centre ``n // 2``).

    ``exprs`` maps an output to the aggregate (``F.sum``, ``F.min``, ...) and ``columns`` to its input. One shuffle
    on the tile key serves both axes. The image must store every pixel of its extent; beyond it pixels count as absent.
    """
    before_y, before_x = size_y // 2, size_x // 2
    after_y, after_x = size_y - 1 - before_y, size_x - 1 - before_x
    halo = max(before_y, before_x, after_y, after_x)
    t = with_halo(df, keys, {"y": (tile, halo), "x": (tile, halo)})
    row = Window.partitionBy(*keys, "t_y", "t_x", "y").orderBy("x").rangeBetween(-before_x, after_x)
    line = Window.partitionBy(*keys, "t_y", "t_x", "x").orderBy("y").rangeBetween(-before_y, after_y)
    for out, f in exprs.items():
        t = t.withColumn(f"__{out}", f(F.col(columns[out])).over(row))
    for out, f in exprs.items():
        t = t.withColumn(out, f(F.col(f"__{out}")).over(line))
    return t.where("core").drop("core", "t_y", "t_x", *[f"__{out}" for out in exprs])


def box_opening(df: DataFrame, keys: Sequence[str], value: str, size: int, name: str = "opened") -> DataFrame:
    """Opening (minimum, then maximum) with a square; a pixel whose square leaves the image is eroded away."""
    ones = df.withColumn("__one", F.lit(1))
    eroded = box_sum(ones, keys, size, size, {"__min": F.min, "__n": F.sum}, {"__min": value, "__n": "__one"})
    eroded = eroded.withColumn("__e", F.when(F.col("__n") == size * size, F.col("__min")).otherwise(F.lit(0)))
    opened = box_sum(eroded.drop("__min", "__n", "__one"), keys, size, size, {name: F.max}, {name: "__e"})
    return opened.drop("__e")


def map_tiles(
    df: DataFrame,
    keys: Sequence[str],
    axes: Sequence[str],
    value: str,
    tile: int,
    halo: int,
    kernel: Callable,
    outputs: Mapping[str, str],
    fill: float = 0.0,
    edges: bool = False,
) -> DataFrame:
    """Runs an array kernel on every tile: ``kernel(block) -> {output: array}`` with ``block`` the dense tile plus halo.

    The block is cut at the image extent, so a kernel that reflects or zero-pads at its borders does so at true image
    edges; elsewhere the halo absorbs the border. Missing pixels read ``fill``. Only stored core pixels are returned. With ``edges`` the kernel is also
    told, per axis, whether the image goes on below and above the block.
    """
    keys, axes = list(keys), list(axes)
    src = df.select(*keys, *axes, F.col(value).cast("double").alias("__v"))
    spans = [f(a).alias(f"__{t}_{a}") for a in axes for t, f in (("lo", F.min), ("hi", F.max))]
    extent = src.groupBy(*keys).agg(*spans)
    tiled = with_halo(src, keys, {a: (tile, halo) for a in axes})
    if keys:
        tiled = tiled.join(extent, keys)
    else:
        bounds = extent.first()
        tiled = tiled.withColumns({f"__{t}_{a}": F.lit(bounds[f"__{t}_{a}"]) for a in axes for t in ("lo", "hi")})
    names = list(outputs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        first = pdf.iloc[0]
        lo, hi, cut = [], [], []
        for a in axes:
            start, end = int(first[f"t_{a}"]) * tile - halo, (int(first[f"t_{a}"]) + 1) * tile + halo - 1
            lo.append(max(start, int(first[f"__lo_{a}"])))
            hi.append(min(end, int(first[f"__hi_{a}"])))
            cut.append((start > int(first[f"__lo_{a}"]), end < int(first[f"__hi_{a}"])))
        block = np.full([h - l + 1 for l, h in zip(lo, hi)], fill)
        at = tuple(pdf[a].to_numpy() - l for a, l in zip(axes, lo))
        block[at] = pdf["__v"].to_numpy()
        core = pdf["core"].to_numpy()
        own = tuple(p[core] for p in at)
        data = {k: pdf[k].to_numpy()[core] for k in keys + axes}
        if not core.any():
            return pd.DataFrame({**data, **{n: pd.Series([], dtype=object) for n in names}})
        result = kernel(block, cut) if edges else kernel(block)
        data.update({n: list(result[n][own]) if result[n].ndim > block.ndim else result[n][own] for n in names})
        return pd.DataFrame(data)

    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keys + axes] + [f"`{n}` {t}" for n, t in outputs.items()])
    return tiled.groupBy(*keys, *[f"t_{a}" for a in axes]).applyInPandas(run, schema)


def separable(block, taps, axes, mode: str = "symmetric"):
    """Convolution along the given axes with edge handling of ``numpy.pad``."""
    import numpy as np

    half = len(taps) // 2
    out = block
    for axis in axes:
        pad = [(half, half) if k == axis else (0, 0) for k in range(out.ndim)]
        # an edge reflection longer than the block needs repeated folds, which pad performs
        wide = np.pad(out, pad, mode=mode)
        n = out.shape[axis]
        acc = np.zeros_like(out)
        for k, w in enumerate(taps):
            acc += w * np.take(wide, range(k, k + n), axis=axis)
        out = acc
    return out


def sliding(block, half: int, axis: int, f, fill: float):
    """Running ``f`` (minimum or maximum) over ``2 half + 1`` cells along an axis, by doubling the span."""
    import numpy as np

    pad = [(half, half) if k == axis else (0, 0) for k in range(block.ndim)]
    out, span, width = np.pad(block, pad, constant_values=fill), 1, 2 * half + 1
    while span < width:
        step = min(span, width - span)
        n = out.shape[axis] - step
        out = f(np.take(out, range(n), axis=axis), np.take(out, range(step, step + n), axis=axis))
        span += step
    return out


def gaussian(df: DataFrame, keys: Sequence[str], axes: Sequence[str], value: str, sigma: float, name: str = "smooth", tile: int = 64) -> DataFrame:
    """Separable Gaussian, reflecting at the image edge, truncated at 4 sigma."""
    from voxtable.operators.stats import gaussian_taps

    taps = gaussian_taps(sigma)

    def kernel(block):
        return {name: separable(block, taps, range(block.ndim))}

    return map_tiles(df, keys, axes, value, tile, len(taps) // 2, kernel, {name: "double"})


def _axis_gradient(block, axis):
    import numpy as np

    return np.gradient(block, axis=axis) if block.shape[axis] > 1 else np.zeros_like(block)


def gradients(df: DataFrame, keys: Sequence[str], axes: Sequence[str], value: str, tile: int = 64) -> DataFrame:
    """Central differences over two, one-sided at the image edge: ``g_<axis>`` columns."""
    names = [f"g_{a}" for a in axes]

    def kernel(block):
        return {n: _axis_gradient(block, k) for k, n in enumerate(names)}

    return map_tiles(df, keys, axes, value, tile, 2, kernel, dict.fromkeys(names, "double"))


def cross_erosion(df: DataFrame, keys: Sequence[str], mask: str, iterations: int, name: str = "eroded", tile: int = 64) -> DataFrame:
    """``iterations`` erosions with the 4-neighbour cross; outside the image counts as empty."""

    def kernel(block):
        return {name: _cross(block > 0, iterations, grow=False)}

    return map_tiles(df.withColumn(mask, F.col(mask).cast("int")), keys, ("y", "x"), mask, tile, iterations + 1, kernel, {name: "boolean"})


def cross_closing(df: DataFrame, keys: Sequence[str], mask: str, iterations: int, name: str = "closed", tile: int = 64) -> DataFrame:
    """``iterations`` dilations, then as many erosions, with the 4-neighbour cross."""

    def kernel(block):
        return {name: _cross(_cross(block > 0, iterations, grow=True), iterations, grow=False)}

    return map_tiles(df.withColumn(mask, F.col(mask).cast("int")), keys, ("y", "x"), mask, tile, 2 * iterations + 1, kernel, {name: "boolean"})


def _cross(mask, iterations: int, grow: bool):
    import numpy as np

    for _ in range(iterations):
        wide = np.pad(mask, 1, constant_values=False)
        parts = [wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]]
        mask = np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)
    return mask


def resample_linear(targets: DataFrame, image: DataFrame, keys: Sequence[str], id_cols: Sequence[str], value: str, axes: Sequence[str] = ("y", "x"), name: str = "value") -> DataFrame:
    """Linear interpolation of ``image`` at real target coordinates (columns named like the axes); zero outside."""
    corners = [[]]
    for a in axes:
        corners = [c + [(a, d)] for c in corners for d in (0, 1)]
    entries = []
    for corner in corners:
        w = F.lit(1.0)
        for a, d in corner:
            t = F.col(a) - F.floor(a)
            w = w * (t if d else 1 - t)
        entries.append(F.struct(*[(F.floor(a).cast("int") + d).alias(a) for a, d in corner], w.alias("w")))
    spread = targets.select(*keys, *id_cols, F.explode(F.array(*entries)).alias("c")).where("c.w > 0")
    spread = spread.select(*keys, *id_cols, *[F.col(f"c.{a}").alias(a) for a in axes], F.col("c.w").alias("w"))
    hit = spread.join(image.select(*keys, *axes, F.col(value).alias("__v")), [*keys, *axes], "left")
    return hit.groupBy(*keys, *id_cols).agg(F.sum(F.col("w") * F.coalesce("__v", F.lit(0.0))).alias(name))


def affine_warp(targets: DataFrame, image: DataFrame, inverse: Sequence[Sequence[float | Column]], keys: Sequence[str], value: str, name: str = "value") -> DataFrame:
    """Output pixel (y, x) reads the image at ``inverse @ (y, x, 1)``: linear, zero outside."""
    m = [[v if isinstance(v, Column) else F.lit(float(v)) for v in row] for row in inverse]
    t = targets.withColumnRenamed("y", "oy").withColumnRenamed("x", "ox")
    for a, row in zip(("y", "x"), m):
        t = t.withColumn(a, row[0] * F.col("oy") + row[1] * F.col("ox") + row[2])
    out = resample_linear(t, image, keys, ["oy", "ox"], value, ("y", "x"), name)
    return out.withColumnRenamed("oy", "y").withColumnRenamed("ox", "x")


def turn(y: Column, x: Column, height: Column, width: Column, quarter_turns: int, mirror: bool) -> tuple[Column, Column]:
    """Source pixel read by view pixel (y, x) after ``quarter_turns`` counter-clockwise turns and a left-right mirror."""
    sides = [(height, width), (width, height), (height, width), (width, height)]
    _, view_w = sides[quarter_turns % 4]
    if mirror:
        x = view_w - 1 - x
    k = quarter_turns % 4
    if k == 0:
        return y, x
    if k == 1:
        return x, width - 1 - y
    if k == 2:
        return height - 1 - y, width - 1 - x
    return height - 1 - x, y


def hann_weight(offset: Column, roi: int) -> Column:
    """Symmetric Hann weight of an offset inside a tile."""
    import math

    if roi == 1:
        return F.lit(1.0)
    return 0.5 - 0.5 * F.cos(offset * (2 * math.pi / (roi - 1)))


def to_tiles(stack: DataFrame, keys: Sequence[str], roi: int, overlap: float = 0.5) -> DataFrame:
    """Copies each pixel into the overlapping score tiles that hold it: adds ``oy, ox`` (tile origin)."""
    step = max(1, int(round(roi * (1 - overlap))))
    extent = stack.groupBy(*keys).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    p = stack.join(extent, list(keys)) if keys else stack.withColumns({"__h": extent.select("__h").scalar(), "__w": extent.select("__w").scalar()})
    for a, size, o in (("y", "__h", "oy"), ("x", "__w", "ox")):
        last = F.greatest(F.col(size) - roi, F.lit(0))
        lo = F.greatest(F.ceil((F.col(a) - roi + 1) / step), F.lit(0)).cast("int")
        hi = F.least(F.floor(F.col(a) / step), F.floor(last / step)).cast("int")
        regular = F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(hi, lo)), lambda k: (k * step).cast("int"))).otherwise(F.array().cast("array<int>"))
        edge = F.when(F.col(a) >= last, F.array(last.cast("int"))).otherwise(F.array().cast("array<int>"))
        p = p.withColumn(o, F.explode(F.array_distinct(F.concat(regular, edge))))
    return p.drop("__h", "__w")


def score_tiles(tiles: DataFrame, keys: Sequence[str], roi: int, layers: int, scorer: Callable) -> DataFrame:
    """Runs ``scorer(block) -> (roi, roi) array`` on every tile, ``block`` a zero-padded (layers, roi, roi) uint8 array."""
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        oy, ox = int(pdf["oy"].iloc[0]), int(pdf["ox"].iloc[0])
        block = np.zeros((layers, roi, roi), np.uint8)
        block[pdf["layer"].to_numpy(), pdf["y"].to_numpy() - oy, pdf["x"].to_numpy() - ox] = pdf["v"].to_numpy()
        score = scorer(block)
        at = pdf[["y", "x"]].drop_duplicates()
        data = {k: pdf[k].iloc[0] for k in keys}
        data.update({"oy": oy, "ox": ox, "y": at["y"].to_numpy(), "x": at["x"].to_numpy(), "s": score[at["y"].to_numpy() - oy, at["x"].to_numpy() - ox]})
        return pd.DataFrame(data)

    types = dict(tiles.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["oy int", "ox int", "y int", "x int", "s double"])
    return tiles.groupBy(*keys, "oy", "ox").applyInPandas(run, schema)


def blend_tiles(scored: DataFrame, keys: Sequence[str], roi: int, min_weight: float = 1e-3) -> DataFrame:
    """Weighted mean of overlapping tile scores, Hann weights normalised to their peak and floored at ``min_weight``."""
    import math

    peak = max(0.5 - 0.5 * math.cos(2 * math.pi * k / (roi - 1)) for k in range(roi)) if roi > 1 else 1.0
    w = F.greatest(hann_weight(F.col("y") - F.col("oy"), roi) * hann_weight(F.col("x") - F.col("ox"), roi) / (peak * peak), F.lit(min_weight))
    weighted = scored.withColumn("__w", w)
    return weighted.groupBy(*keys, "y", "x").agg((F.sum(F.col("__w") * F.col("s")) / F.greatest(F.sum("__w"), F.lit(1e-6))).alias("s"))


def default_scorer(block):
    """Deterministic stand-in for a model: the layer mean as a 0..1 score."""
    return block.mean(0) / 255.0


def member_mean(maps: DataFrame, keys: Sequence[str], value: str = "s", how: str = "mean") -> DataFrame:
    """Mean or maximum of several maps (arms, directions, depths) at each pixel."""
    f = {"mean": F.avg, "max": F.max}[how]
    return maps.groupBy(*keys, "y", "x").agg(f(value).alias(value))


def fused_views(stack: DataFrame, keys: Sequence[str], read: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Mean of four reads of the same images: as they are, turned by 90 and by 180 degrees, and mirrored; each read is turned back first.

    ``read(stack, keys)`` gives rows (keys, y, x, s); all views go through it at once, ``view`` being one more key.
    """
    keys = list(keys)
    extent = stack.groupBy(*keys).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    sizes = {c: extent.select(c).scalar() for c in ("__h", "__w")} if not keys else {}
    sized = stack.join(extent, keys) if keys else stack.withColumns(sizes)
    y, x, h, w = (F.col(c) for c in ("y", "x", "__h", "__w"))
    there = [(y, x), (w - 1 - x, y), (h - 1 - y, w - 1 - x), (y, w - 1 - x)]
    views = F.explode(F.array(*[F.struct(F.lit(k).alias("view"), a.alias("y"), b.alias("x")) for k, (a, b) in enumerate(there)])).alias("__v")
    rest = [c for c in stack.columns if c not in ("y", "x")]
    turned = sized.select(*rest, views).select(*rest, "__v.*")
    maps = read(turned, [*keys, "view"])
    maps = maps.join(extent, keys) if keys else maps.withColumns(sizes)
    back = [(y, x), (x, w - 1 - y), (h - 1 - y, w - 1 - x), (y, w - 1 - x)]
    at = F.array(*[F.struct(a.cast("int").alias("y"), b.cast("int").alias("x")) for a, b in back])
    home = maps.select(*keys, F.element_at(at, F.col("view") + 1).alias("__at"), "s").select(*keys, "__at.*", "s")
    return member_mean(home, keys)


def layer_window(stack: DataFrame, first: int, count: int, reverse: bool = False) -> DataFrame:
    """Contiguous layers ``first .. first + count - 1``, renumbered from 0, optionally reversed."""
    out = stack.where((F.col("layer") >= first) & (F.col("layer") < first + count))
    at = F.col("layer") - first
    return out.withColumn("layer", (count - 1 - at) if reverse else at)


def shift_layers(stack: DataFrame, dz: int, layers: int) -> DataFrame:
    """Layer L reads layer L + dz; layers shifted out are dropped, the opened ones read as absent (zero)."""
    return stack.withColumn("layer", F.col("layer") - dz).where(F.col("layer").between(0, layers - 1))


def shuffle_layers(stack: DataFrame, first: int, count: int, seed: int = 0) -> DataFrame:
    """Null control: permutes the selected layers in md5 order of (seed, layer) and leaves the others."""
    import hashlib

    order = sorted(range(first, first + count), key=lambda k: (hashlib.md5(f"{seed},{k}".encode()).hexdigest(), k))
    target = F.lit(None).cast("int")
    for place, layer in enumerate(order):
        target = F.when(F.col("layer") == layer, first + place).otherwise(target)
    return stack.withColumn("layer", F.coalesce(target, F.col("layer")).cast("int"))


def line_banding(
    image: DataFrame, keys: Sequence[str], value: str, um_px: float, step_deg: int = 4, floor: float = 127.0, wide_um: float = 9000.0, near_um: float = 2500.0, min_cm2: float = 0.25
) -> DataFrame:
    """How strongly ink is banded: per angle the pixel sums along straight lines, normalised and detrended. A pixel is projected onto the line of each
    angle and shared out linearly between the two bands beside its place, as an image turned with linear interpolation would have it.

    Result per key: ratio of the best to the median standard deviation, its angle and the band spacing from the best
    autocorrelation lag. ``image`` holds the valid (already eroded, smoothed) pixels; too small an area gives no row.
    Band profiles are tiny (one row per band), so only the pixel sums are large, and those combine map-side.
    """
    import math

    from voxtable.operators.ordered import percentiles

    keys = list(keys)
    turns = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(math.cos(math.radians(a))).alias("c"), F.lit(math.sin(math.radians(a))).alias("s")) for a in range(0, 180, step_deg)])
    spun = image.select(*keys, "y", "x", F.greatest(F.col(value) - floor, F.lit(0.0)).alias("__v"), F.explode(turns).alias("t"))
    spun = spun.withColumn("at", F.round(F.col("y") * F.col("t.c") + F.col("x") * F.col("t.s"), 9)).withColumn("low", F.floor("at"))
    shares = F.array(*(F.struct((F.col("low") + k).cast("int").alias("band"), w.alias("w")) for k, w in ((0, F.col("low") + 1 - F.col("at")), (1, F.col("at") - F.col("low")))))
    spread = spun.select(*keys, F.col("t.angle").alias("angle"), "__v", F.explode(shares).alias("b")).where("b.w > 0")
    sums = spread.groupBy(*keys, "angle", F.col("b.band").alias("band")).agg(F.sum(F.col("b.w") * F.col("__v")).alias("s"), F.round(F.sum("b.w"), 6).alias("n"))
    of = Window.partitionBy(*keys, "angle")
    kept = sums.withColumn("__max", F.max("n").over(of)).withColumn("__px", F.sum("n").over(of)).where(F.col("__px") * (um_px / 1e4) ** 2 >= min_cm2)
    kept = kept.where(F.col("n") > 0.5 * F.col("__max")).withColumn("p", F.col("s") / F.col("n"))
    half = max(3, int(wide_um / um_px)) // 2
    flat = kept.withColumn("d", F.col("p") - F.avg("p").over(of.orderBy("band").rangeBetween(-half, half)))
    std = flat.groupBy(*keys, "angle").agg(F.stddev_pop("d").alias("std"))
    best = std.groupBy(*keys).agg(F.max("std").alias("top"), F.min_by("angle", F.struct((-F.round("std", 9)).alias("v"), F.col("angle").alias("a"))).alias("angle"))
    med = percentiles(std, keys, "std", {"mid": 0.5})
    found = best.join(med, keys) if keys else best.withColumn("mid", med.scalar())
    lo, hi = int(near_um / um_px), int(wide_um / um_px)
    prof = flat.join(found.select(*keys, "angle"), [*keys, "angle"], "left_semi").select(*keys, "band", "d")
    lagged = prof.select(*keys, "d", F.explode(F.sequence(F.lit(lo), F.lit(max(hi - 1, lo)))).alias("lag"), F.col("band").alias("b0"))
    other = prof.select(*keys, F.col("band").alias("b1"), F.col("d").alias("d1"))
    met = lagged.withColumn("b1", F.col("b0") + F.col("lag")).join(other, [*keys, "b1"])
    ac = met.groupBy(*keys, "lag").agg(F.sum(F.col("d") * F.col("d1")).alias("ac"))
    lag = ac.groupBy(*keys).agg(F.min_by("lag", F.struct((-F.round("ac", 6)).alias("v"), F.col("lag").alias("l"))).alias("lag"))
    out = found.join(lag, keys, "left") if keys else found.withColumn("lag", lag.scalar())
    return out.select(*keys, (F.col("top") / F.greatest("mid", F.lit(1e-9))).alias("ratio"), "angle", (F.coalesce("lag", F.lit(0)) * um_px / 1000).alias("spacing_mm"))
