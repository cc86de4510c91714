"""Correlation, histogram, block and profile statistics as algebraic (partial + final) aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ncc(a: str, b: str, eps: float = 1e-12, min_n: int = 1) -> Column:
    """Mean-removed correlation as an aggregate column; ``eps`` makes constant inputs 0, under ``min_n`` rows NULL."""
    n = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)).cast("double"), F.when(both, F.col(b)).cast("double")
    value = F.covar_pop(x, y) * n / F.sqrt(F.var_pop(x) * n * F.var_pop(y) * n + F.lit(eps))
    return F.when(n >= min_n, value)


def guarded_corr(a: str, b: str, min_n: int = 3) -> Column:
    """Pearson correlation, NULL when either side is constant or fewer than ``min_n`` pairs exist."""
    ok = (F.count(F.lit(1)) >= min_n) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(ok, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def block_mean(
    df: DataFrame, keys: Sequence[str], y: str, x: str, value: str, ds: int, full_only: bool = True, name: str = "mean"
) -> DataFrame:
    """Mean over ds x ds blocks; with ``full_only`` the ragged edge (blocks missing a cell) is dropped."""
    out = df.groupBy(*keys, F.floor(F.col(y) / ds).cast("int").alias("by"), F.floor(F.col(x) / ds).cast("int").alias("bx")).agg(
        F.avg(F.col(value).cast("double")).alias(name), F.count(F.lit(1)).alias("cells")
    )
    return out.where(F.col("cells") == ds * ds) if full_only else out


def layer_any(value: str) -> Column:
    """Covered: non-zero on any layer."""
    return F.bool_or(F.col(value) > 0)


def layer_all(value: str, layer: str, layers: int) -> Column:
    """Kept: above zero on every one of ``layers`` layers."""
    return F.bool_and(F.col(value) > 0) & (F.count_distinct(F.col(layer)) == layers)


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """Dense histogram: every group has all ``bins`` values, zero where nothing was counted. A value outside them fails the job; NULL counts nowhere."""
    v = F.col(value).cast("int")
    inside = F.when(v.between(0, bins - 1), v).when(v.isNotNull(), F.raise_error(F.format_string("histogram value %d is not below the number of bins", v)))
    counted = df.where(v.isNotNull()).groupBy(*keys, inside.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    packed = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    dense = packed.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("v"))
    return dense.select(*keys, "v", F.coalesce(F.col("m")[F.col("v")], F.lit(0)).cast("long").alias("n"))


def with_cdf(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running share per histogram (a histogram has a fixed number of bins, so its window is bounded)."""
    run = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return hist.withColumn("cdf", F.sum("n").over(run) / F.sum("n").over(whole))


def histogram_percentile(hist: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """First bin whose cumulative share reaches q (no interpolation)."""
    c = with_cdf(hist, keys)
    return c.groupBy(*keys).agg(*[F.min(F.when(F.col("cdf") >= q, F.col("v"))).alias(name) for name, q in probs.items()])


def histogram_lut(source: DataFrame, reference: DataFrame, keys: Sequence[str], bins: int = 256) -> DataFrame:
    """(keys, v) -> v2: first reference bin whose share reaches the source share, clipped to 1..bins-1.

    Source and reference bins are merged in share order, at most ``2 * bins`` rows per key.
    """
    s = with_cdf(source, keys).select(*keys, "cdf", F.lit(0).alias("kind"), F.col("v").alias("v"), F.lit(None).cast("int").alias("rv"))
    r = with_cdf(reference, keys).select(*keys, "cdf", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("v"), F.col("v").alias("rv"))
    ahead = Window.partitionBy(*keys).orderBy("cdf", "kind", "rv").rowsBetween(0, Window.unboundedFollowing)
    merged = s.unionByName(r).withColumn("v2", F.min("rv").over(ahead))
    v2 = F.least(F.greatest(F.coalesce("v2", F.lit(bins - 1)), F.lit(1)), F.lit(bins - 1))
    return merged.where("kind = 0").select(*keys, "v", v2.alias("v2"))


def remap(pixels: DataFrame, lut: DataFrame, keys: Sequence[str], value: str, mask: str) -> DataFrame:
    """Replace values by the table inside the mask; 0 outside."""
    table = lut.withColumnRenamed("v", value)
    out = pixels.join(table, [*keys, value], "left")
    return out.withColumn(value, F.when(F.col(mask), F.col("v2")).otherwise(0)).drop("v2")


def smooth_profile(
    df: DataFrame, keys: Sequence[str], index: str, value: str, weights: Sequence[float], name: str, reflect: tuple[int, int] | None = None
) -> DataFrame:
    """Weighted sum over neighbouring profile positions: zero outside, or mirrored at the given first and last position.

    Each position is sent to the positions it contributes to, so a profile of any length aggregates in parallel.
    """
    half = len(weights) // 2
    taps = F.array(*[F.struct(F.lit(k - half).alias("d"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)])
    i = F.col(index)
    copies = [F.struct(i.alias("at"), F.lit(True).alias("own"))]
    if reflect:
        copies += [F.struct((2 * reflect[0] - 1 - i).alias("at"), F.lit(False).alias("own")), F.struct((2 * reflect[1] + 1 - i).alias("at"), F.lit(False).alias("own"))]
    sent = df.select(*keys, i, F.col(value), F.explode(F.array(*copies)).alias("c")).select(*keys, value, "c.at", "c.own", F.explode(taps).alias("t"))
    target = F.col("at") - F.col("t.d")
    own = F.when(F.col("own") & (F.col("t.d") == 0), F.col(value))
    out = sent.groupBy(*keys, target.alias(index)).agg(F.sum(F.col(value) * F.col("t.w")).alias(name), F.max(own).alias(value))
    return out.where(F.col(value).isNotNull())


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights out to ``truncate`` sigmas."""
    import math

    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def depth_bin(layer: str, centre0: float, width: float) -> Column:
    """Bin of a layer under half-open bins ``[c - w/2, c + w/2)`` with evenly spaced centres."""
    return F.floor((F.col(layer) - F.lit(centre0) + F.lit(width / 2)) / F.lit(width)).cast("int")


def stretch_between(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Adds ``u8``: the value stretched to 0..255 between two percentiles of its group, cut off beyond them, fractions dropped."""
    from voxtable.operators.ordered import joined_on, percentiles

    edges = percentiles(df, keys, value, {"__low": low, "__high": high})
    share = (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low"))
    out = joined_on(df, edges, keys).withColumn("u8", (F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
    return out.drop("__low", "__high")


def bin_pool(df: DataFrame, bin_column: str, bins: int, value: str) -> DataFrame:
    """bin, n and mean of all bins 0..bins-1, empty ones with n 0 and no mean. A row in no bin fails the job."""
    b = F.col(bin_column)
    inside = F.when(b.between(0, bins - 1), b).otherwise(F.raise_error(F.format_string("bin %s is not one of the bins", b.cast("string"))))
    pooled = df.groupBy(inside.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(pooled, "bin", "left").select(F.col("bin").cast("int").alias("bin"), F.coalesce("n", F.lit(0)).alias("n"), "mean")


def argmax_first(df: DataFrame, keys: Sequence[str], value: str, tie_order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Row with the highest value; ties go to the first in ``tie_order``. A max_by aggregate, so it combines map-side."""
    order = F.struct((-F.col(value)).alias("__v"), *[c.alias(f"__t{k}") for k, c in enumerate(tie_order)])
    best = F.min_by(F.struct(*keep), order)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


def offset_tie_order(offset: str) -> list[Column]:
    """Smaller absolute offset first, then the more negative one."""
    return [F.abs(F.col(offset)), F.col(offset)]
