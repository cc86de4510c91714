"""Connected components of graphs and of masks.

Graph components use alternating large-star / small-star steps: each step is an aggregate of minimum neighbours and a
join, and a hot node is only ever summarised by its minimum. Mask components are first labelled inside bounded tiles, so
that the graph holds one node per tile component and one edge per touching border pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.operators.tiles import with_halo
from voxtable.session import cut_lineage, stored


def graph_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node."""
    star = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    everyone = star.select(F.col("hi").alias("node")).union(star.select(F.col("lo").alias("node"))).distinct()
    previous = None
    while True:
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(star.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small_min = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rehung = large.join(small_min, "hi")
        # a table, as the expected size of a checkpoint is the product of its joined sides: it would gain digits threefold a round
        star = stored(
            rehung.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(rehung.select("hi", F.col("m").alias("lo"))).where("hi > lo").distinct()
        )
        mark = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == previous:
            break
        previous = mark
    found = star.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    return everyone.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def mask_components(mask: DataFrame, keys: Sequence[str], tile: int = 64) -> DataFrame:
    """4-neighbour component of every TRUE pixel (rows keys, y, x): adds ``component``, the key of its first pixel (y, x)."""
    keys = list(keys)
    px = mask.select(*keys, "y", "x").distinct()
    tiled = with_halo(px, keys, {"y": (tile, 0), "x": (tile, 0)})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        y0, x0 = y.min(), x.min()
        ids = np.full((y.max() - y0 + 3, x.max() - x0 + 3), tile * tile * 4, np.int64)
        on = np.zeros(ids.shape, bool)
        on[y - y0 + 1, x - x0 + 1] = True
        ids[on] = np.arange(on.sum())
        while True:
            low = np.minimum.reduce([ids, np.roll(ids, 1, 0), np.roll(ids, -1, 0), np.roll(ids, 1, 1), np.roll(ids, -1, 1)])
            low = np.where(on, low, ids)
            flat = low[on]
            flat = flat[flat]
            low[on] = flat
            if (low == ids).all():
                break
            ids = low
        yy, xx = np.nonzero(on)
        root = ids[on]
        data = {k: pdf[k].iloc[0] for k in keys}
        data.update({"y": yy - 1 + y0, "x": xx - 1 + x0, "ry": yy[root] - 1 + y0, "rx": xx[root] - 1 + x0})
        return pd.DataFrame(data)

    types = dict(px.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in [*keys, "y", "x"]] + ["ry int", "rx int"])
    local = tiled.groupBy(*keys, "t_y", "t_x").applyInPandas(label, schema)
    local = cut_lineage(local.select(*keys, "y", "x", F.struct(*keys, F.col("ry").cast("int").alias("y"), F.col("rx").cast("int").alias("x")).alias("part")))
    edges = None
    for axis in ("y", "x"):
        rim = local.where(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).select(*keys, *[(F.col(c) + 1 if c == axis else F.col(c)).cast("int").alias(c) for c in ("y", "x")], F.col("part").alias("a"))
        met = rim.join(local.where(F.pmod(F.col(axis), F.lit(tile)) == 0).select(*keys, "y", "x", F.col("part").alias("b")), [*keys, "y", "x"]).select("a", "b").distinct()
        edges = met if edges is None else edges.union(met)
    merged = graph_components(edges)
    joined = local.join(merged.withColumnRenamed("node", "part"), "part", "left")
    return joined.select(*keys, "y", "x", F.coalesce("component", "part").alias("component"))


def component_extents(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box and pixel count per component."""
    return labelled.groupBy(*keys, "component").agg(
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("pixels")
    )


def text_score_side(image: DataFrame, keys: Sequence[str], value: str, um_px: float, edge_mm: float = 0.35, lo_mm: float = 0.3, hi_mm: float = 6.0, threshold: int = 190) -> DataFrame:
    """Share of the valid area in bright components 0.3 to 6 mm across.

    Valid: non-zero, closed twice, eroded by ``edge_mm`` (outside the image counts as empty).
    """
    from voxtable.operators.raster import cross_closing, cross_erosion

    keys = list(keys)
    closed = cross_closing(image.withColumn("__m", (F.col(value) > 0).cast("int")), keys, "__m", 2)
    depth = max(1, int(edge_mm * 1000 / um_px))
    valid = cross_erosion(closed.withColumn("closed", F.col("closed").cast("int")), keys, "closed", depth).where("eroded")
    bright = image.where(F.col(value) > threshold).join(valid.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")
    extents = component_extents(mask_components(bright, keys), keys)
    across = F.greatest(F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1) * um_px / 1000
    kept = extents.where(across.between(lo_mm, hi_mm)).select(*keys, "pixels")
    area = valid.select(*keys, F.lit(1).alias("v"), F.lit(0).cast("long").alias("pixels"))
    both = area.unionByName(kept.withColumn("v", F.lit(0)))
    return both.groupBy(*keys).agg(F.sum("v").alias("valid_px"), F.sum("pixels").alias("kept_px")).where("valid_px > 0").withColumn(
        "share", F.col("kept_px") / F.col("valid_px")
    )


def text_score(image: DataFrame, keys: Sequence[str], side: str, value: str, um_px: float, **limits) -> DataFrame:
    """Difference of the bright-component shares of the two sides (``a`` minus ``b``), with the winning side."""
    per = text_score_side(image, [*keys, side], value, um_px, **limits)

    def of(which: str):
        return F.coalesce(F.max(F.when(F.col(side) == which, F.col("share"))), F.lit(0.0))

    out = per.groupBy(*keys).agg(of("a").alias("ta"), of("b").alias("tb"))
    return out.withColumn("score", F.col("ta") - F.col("tb")).withColumn("side", F.when(F.col("ta") > F.col("tb"), "a").otherwise("b"))


def stroke_share(image: DataFrame, keys: Sequence[str], bright: str, size: int = 13) -> DataFrame:
    """Share of the valid pixels that are bright and lost under an opening with a ``size`` square."""
    from voxtable.operators.raster import box_opening

    flat = image.withColumn("__b", F.col(bright).cast("int"))
    opened = box_opening(flat, keys, "__b", size)
    return opened.groupBy(*keys).agg(F.count(F.lit(1)).alias("valid"), F.count_if((F.col("__b") == 1) & (F.col("opened") == 0)).alias("thin")).withColumn(
        "share", F.col("thin") / F.col("valid")
    )
