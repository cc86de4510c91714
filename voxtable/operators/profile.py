"""Profiles along surface normals: gap probe and seating score, peaks and spacing, depth prediction."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.operators.chunks import ZYX, gather, trilinear
from voxtable.operators.nearest import parts
from voxtable.operators.ordered import percentiles
from voxtable.operators.stats import gaussian_taps, smooth_profile
from voxtable.session import stored


def first_local_minimum(profile: DataFrame, keys: Sequence[str], index: str, value: str, name: str = "gap") -> DataFrame:
    """First interior position not above either neighbour, else the position of the minimum. Profiles are short by construction."""
    w = Window.partitionBy(*keys).orderBy(index)
    dip = (F.col(value) <= F.lag(value).over(w)) & (F.col(value) <= F.lead(value).over(w))
    return profile.withColumn("__dip", dip).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("__dip"), F.col(index))), F.min_by(index, F.struct(value, index))).alias(name)
    )


def seating_score(
    points: DataFrame,
    chunks: DataFrame,
    shape: Sequence[int],
    chunk: Sequence[int],
    keys: Sequence[str],
    steps: Sequence[int] = tuple(range(2, 60, 2)),
    on_level: int = 40,
    min_coverage: float = 0.25,
    volume_keys: Sequence[str] = ("volume_id", "level"),
) -> DataFrame:
    """Seating of surface points (keys, point_id, volume keys, z, y, x, nz, ny, nx) in a volume.

    The mean along +-normals, smoothed by 3 with zero padding, gives the gap; the score is the mean contrast of lit centres
    against both gap sides times the lit share, or -1 below ``min_coverage``. Every distance is read in one gather, whose values are kept as a table:
    the profile, the score and the counts read it.
    """
    keys = list(keys)
    dist = sorted({0, *steps, *[-s for s in steps]})
    probe = points.withColumn("d", F.explode(F.array(*[F.lit(d) for d in dist])))
    for a in ZYX:
        probe = probe.withColumn(a, F.rint(F.col(a) + F.col(f"n{a}") * F.col("d")).cast("int"))
    read = gather(probe.select(*dict.fromkeys([*keys, "point_id", *volume_keys, "d", *ZYX])), chunks, shape, chunk, volume_keys)
    read = stored(read.select(*keys, "point_id", "d", "v", "read"))
    means = read.where("d <> 0").groupBy(*keys, F.abs("d").alias("step"), "d").agg(F.avg("v").alias("m"))
    means = means.groupBy(*keys, "step").agg((F.lit(0.5) * F.sum("m")).alias("m"))
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(-1, 1)
    smooth = means.withColumn("smooth", F.sum("m").over(w) / 3)
    gap = first_local_minimum(smooth, keys, "step", "smooth", "gap")
    rows = read.join(gap, keys).where((F.col("d") == 0) | (F.abs("d") == F.col("gap")))
    per = rows.groupBy(*keys, "point_id", "gap").agg(
        F.max(F.when(F.col("d") == 0, F.col("v"))).alias("centre"),
        F.sum(F.when(F.col("d") != 0, F.col("v"))).alias("sides"),
    )
    lit = F.col("centre") > on_level
    out = per.groupBy(*keys, "gap").agg(
        F.count(F.lit(1)).alias("points"),
        F.avg(lit.cast("double")).alias("coverage"),
        F.avg(F.when(lit, F.col("centre") - 0.5 * F.col("sides"))).alias("contrast"),
        F.avg("centre").alias("mean_all"),
        F.avg(F.when(lit, F.col("centre"))).alias("mean_on"),
    )
    low = F.col("coverage") < min_coverage
    counted = read.groupBy(*keys).agg(F.count_if(F.col("read") == "missing").alias("missing_reads"), F.count_if(F.col("read") == "outside").alias("outside_reads"))
    return out.join(counted, keys).select(
        *keys, "points", F.when(low, -1.0).otherwise(F.col("contrast") * F.col("coverage")).alias("score"),
        F.when(low, F.col("mean_all")).otherwise(F.col("mean_on")).alias("centre_mean"), "coverage", "gap", "missing_reads", "outside_reads",
    )


def find_peaks(profiles: DataFrame, keys: Sequence[str], value: str, height: float = 0.2, distance: int = 4) -> DataFrame:
    """Peaks of array profiles: strict local maxima (plateau middle) of at least ``height``, higher ones claiming +-``distance``."""
    p = F.col(value)
    level = lambda at: F.get(p, at)
    n = F.size(p)
    # where a level begins, and where the next one does; what stands before and behind a level is read from the profile itself
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: (k == 0) | (level(k) != level(k - 1)))
    runs = F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.greatest(n, F.lit(1))), F.array(n)).alias("b"))
    top = lambda x: (x["a"] > 0) & (level(x["a"]) > level(x["a"] - 1)) & (level(x["a"]) > level(x["b"])) & (level(x["a"]) >= height)
    place = lambda x: F.struct((-level(x["a"])).alias("v"), (-F.floor((x["a"] + x["b"] - 1) / 2)).cast("int").alias("at"))
    out = profiles.select(*keys, F.array_sort(F.transform(F.filter(runs, top), place)).alias("__found"))
    # of equal heights the later peak goes first
    take = lambda kept, x: F.when(F.exists(kept, lambda a: F.abs(a + x["at"]) < distance), kept).otherwise(F.array_append(kept, -x["at"]))
    return out.select(*keys, F.array_sort(F.aggregate("__found", F.array().cast("array<int>"), take)).alias("peaks"))


def gap_differences(positions: DataFrame, keys: Sequence[str], peaks: str = "peaks") -> DataFrame:
    """Distances between consecutive peaks of each profile as an array, with their count, mean and population std."""
    p = F.col(peaks)
    gaps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: (b - a).cast("double"))
    g = positions.withColumn("gaps", gaps).withColumn("n_peaks", F.size(p))
    mean = F.aggregate("gaps", F.lit(0.0), lambda s, t: s + t) / F.size("gaps")
    g = g.withColumn("gap_mean", F.when(F.size("gaps") > 0, mean))
    var = F.aggregate("gaps", F.lit(0.0), lambda s, t: s + F.pow(t - F.col("gap_mean"), 2)) / F.size("gaps")
    return g.withColumn("gap_std", F.when(F.size("gaps") > 0, F.sqrt(var)))


def crest_spacing(profiles: DataFrame, keys: Sequence[str], point_keys: Sequence[str], step: float = 0.25, height: float = 0.2, distance: int = 8, min_peaks: int = 3) -> DataFrame:
    """Median over points of the median peak gap, in voxels, from array profiles sampled every ``step``."""
    all_keys = [*keys, *point_keys]
    g = gap_differences(find_peaks(profiles, all_keys, "profile", height, distance), all_keys).where(F.col("n_peaks") >= min_peaks)
    ordered = F.array_sort("gaps")
    n = F.size(ordered)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return percentiles(g.withColumn("m", middle * step), keys, "m", {"spacing": 0.5})


def crest_regularity(profiles: DataFrame, keys: Sequence[str], point_keys: Sequence[str], height: float = 0.2, distance: int = 4, min_peaks: int = 4) -> DataFrame:
    """Median over points of gap std over gap mean."""
    all_keys = [*keys, *point_keys]
    g = gap_differences(find_peaks(profiles, all_keys, "profile", height, distance), all_keys).where(F.col("n_peaks") >= min_peaks)
    return percentiles(g.withColumn("cv", F.col("gap_std") / F.col("gap_mean")), keys, "cv", {"regularity": 0.5})


def normal_profiles(points: DataFrame, chunks: DataFrame, shape, chunk, point_keys: Sequence[str], reach: float, step: float, volume_keys=("volume_id", "level")) -> DataFrame:
    """Array profile of trilinear samples along each point's normal from -reach to reach.

    Points are dealt over tasks by the number of their samples: a file of few bytes has few splits.
    """
    n = int(round(2 * reach / step)) + 1
    tasks = parts(points.sparkSession, points.count() * n)
    at = points.repartition(tasks, *point_keys).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for a in ZYX:
        at = at.withColumn(a, F.col(a) + F.col(f"n{a}") * (F.col("k") * step - reach))
    values = trilinear(at, chunks, shape, chunk, [*point_keys, "k"], volume_keys)
    return values.groupBy(*point_keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda e: e["value"]).alias("profile"))


def depth_prediction(
    stack: DataFrame, keys: Sequence[str], quarter: str, layers: int, sigma: float = 3.0, reach: int = 48, grid: Sequence[int] = tuple(range(-48, 49, 4))
) -> DataFrame:
    """Layer offset (from the middle layer) of the strongest smoothed mean profile per quarter, and the nearest grid offset."""
    middle = (layers - 1) // 2
    prof = stack.groupBy(*keys, quarter, "layer").agg(F.avg("v").alias("m"))
    smooth = smooth_profile(prof, [*keys, quarter], "layer", "m", gaussian_taps(sigma), "s", (0, layers - 1))
    off = F.col("layer") - middle
    near = smooth.where(F.abs(off) <= reach)
    best = near.groupBy(*keys, quarter).agg(F.min_by("layer", F.struct((-F.round("s", 9)).alias("v"), F.col("layer").alias("l"))).alias("layer"))
    snap = F.array_min(F.array(*[F.struct(F.abs(off - g).alias("d"), F.lit(k).alias("k"), F.lit(g).alias("g")) for k, g in enumerate(grid)]))
    return best.select(*keys, quarter, off.alias("predicted"), snap["g"].alias("snapped"))


def match_rate(predictions: DataFrame, labels: DataFrame, keys: Sequence[str], constant: int = 0) -> DataFrame:
    """How often the snapped prediction, and a constant, equal the labelled offset (unlabelled rows do not count)."""
    j = predictions.join(labels.where("label is not null"), list(keys))
    return j.agg(
        F.count(F.lit(1)).alias("scorable"), F.count_if(F.col("snapped") == F.col("label")).alias("matches"), F.count_if(F.col("label") == constant).alias("constant_matches")
    )
