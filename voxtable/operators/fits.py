"""Least-squares fits per group from centred moments, solved in closed form inside the JVM.

One aggregate holds everything a fit needs (means and covariances), so a group of any size combines map-side and is
never collected. Leave-one-out residuals follow exactly from the leverage of each point.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from voxtable.operators.ordered import percentiles
from voxtable.session import cut_lineage


def determinant(m: Sequence[Sequence[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    total = F.lit(0.0)
    for k in range(len(m)):
        minor = [[v for c, v in enumerate(row) if c != k] for row in m[1:]]
        term = m[0][k] * determinant(minor)
        total = total + term if k % 2 == 0 else total - term
    return total


def inverse(m: Sequence[Sequence[Column]], det: Column | None = None) -> list[list[Column]]:
    """Inverse by cofactors (1x1 to 3x3)."""
    n = len(m)
    det = determinant(m) if det is None else det
    if n == 1:
        return [[F.lit(1.0) / det]]
    out = []
    for r in range(n):
        row = []
        for c in range(n):
            minor = [[v for k, v in enumerate(line) if k != r] for i, line in enumerate(m) if i != c]
            sign = 1.0 if (r + c) % 2 == 0 else -1.0
            row.append(F.lit(sign) * determinant(minor) / det)
        out.append(row)
    return out


def fit_affine(df: DataFrame, by: Sequence[str], src: Sequence[str], dst: Sequence[str], min_points: int | None = None) -> DataFrame:
    """Per group: ``n``, coefficients ``a_<dst>_<src>`` and ``t_<dst>``; NULL under ``min_points`` or if degenerate.

    Also keeps the means and the inverse covariance of the sources (``m_*``, ``p_*``), which give leverages.
    """
    src, dst = list(src), list(dst)
    need = min_points or len(src) + 1
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m_{c}") for c in dict.fromkeys(src + dst)]
    aggs += [F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(src) for b in src[i:]]
    aggs += [F.covar_pop(a, d).alias(f"d_{a}_{d}") for a in src for d in dst]
    mom = df.groupBy(*by).agg(*aggs)

    def cov(i: int, j: int) -> Column:
        a, b = (src[i], src[j]) if i <= j else (src[j], src[i])
        return F.col(f"c_{a}_{b}")

    k = len(src)
    matrix = [[cov(i, j) for j in range(k)] for i in range(k)]
    mom = mom.withColumn("det", determinant(matrix))
    usable = (F.col("n") >= need) & (F.col("det") > 0)
    inv = inverse(matrix, F.when(usable, F.col("det")))
    mom = mom.select("*", *[inv[i][j].alias(f"p_{src[i]}_{src[j]}") for i in range(k) for j in range(i, k)])

    def prec(i: int, j: int) -> Column:
        a, b = (src[i], src[j]) if i <= j else (src[j], src[i])
        return F.col(f"p_{a}_{b}")

    coef = []
    for d in dst:
        for i, a in enumerate(src):
            coef.append(sum((prec(i, j) * F.col(f"d_{src[j]}_{d}") for j in range(1, k)), prec(i, 0) * F.col(f"d_{src[0]}_{d}")).alias(f"a_{d}_{a}"))
    mom = mom.select("*", *coef)
    shift = [(F.col(f"m_{d}") - sum((F.col(f"a_{d}_{a}") * F.col(f"m_{a}") for a in src[1:]), F.col(f"a_{d}_{src[0]}") * F.col(f"m_{src[0]}"))).alias(f"t_{d}") for d in dst]
    keep = [*by, "n"] + [f"m_{a}" for a in src] + [f"p_{src[i]}_{src[j]}" for i in range(k) for j in range(i, k)]
    return mom.select(*keep, *[f"a_{d}_{a}" for d in dst for a in src], *shift)


def with_residuals(df: DataFrame, fit: DataFrame, by: Sequence[str], src: Sequence[str], dst: Sequence[str]) -> DataFrame:
    """Adds ``res`` (residual length) and ``loo`` (residual length if the point had been left out of the fit)."""
    src, dst = list(src), list(dst)
    joined = df.join(fit.withColumnRenamed("n", "__n"), list(by)) if by else df.join(fit.withColumnRenamed("n", "__n"))
    sq = F.lit(0.0)
    for d in dst:
        pred = F.col(f"t_{d}")
        for a in src:
            pred = pred + F.col(f"a_{d}_{a}") * F.col(a)
        sq = sq + F.pow(F.col(d) - pred, 2)
    lever = F.lit(1.0)
    for i, a in enumerate(src):
        for j, b in enumerate(src):
            p = f"p_{a}_{b}" if i <= j else f"p_{b}_{a}"
            lever = lever + F.col(p) * (F.col(a) - F.col(f"m_{a}")) * (F.col(b) - F.col(f"m_{b}"))
    lever = lever / F.col("__n")
    out = joined.withColumn("res", F.sqrt(sq)).withColumn("loo", F.when(lever < 1 - 1e-12, F.col("res") / (1 - lever)))
    return out.select(*df.columns, "res", "loo")


def landmark_errors(df: DataFrame, by: Sequence[str], src: Sequence[str], dst: Sequence[str], loo_min: int = 5) -> DataFrame:
    """Refit RMS and max per group, and the leave-one-out RMS where the group has ``loo_min`` points."""
    res = with_residuals(df, fit_affine(df, by, src, dst), by, src, dst)
    n = F.count(F.lit(1))
    return res.groupBy(*by).agg(
        n.alias("n"),
        F.sqrt(F.avg(F.pow("res", 2))).alias("rms"),
        F.max("res").alias("max_res"),
        F.when(n >= loo_min, F.sqrt(F.avg(F.pow("loo", 2)))).alias("loo_rms"),
    )


def published_errors(df: DataFrame, by: Sequence[str], predicted: Sequence[str], actual: Sequence[str]) -> DataFrame:
    """RMS and max distance between points mapped by a published transform and their landmarks."""
    sq = sum((F.pow(F.col(p) - F.col(a), 2) for p, a in zip(predicted[1:], actual[1:])), F.pow(F.col(predicted[0]) - F.col(actual[0]), 2))
    return df.groupBy(*by).agg(F.sqrt(F.avg(sq)).alias("pub_rms"), F.sqrt(F.max(sq)).alias("pub_max"))


def trimmed_fit(
    df: DataFrame, by: Sequence[str], src: Sequence[str], dst: Sequence[str], limit: float, min_kept: int = 3, times_median: float | None = None, bounded: bool = False
) -> DataFrame:
    """Fit, drop points whose residual exceeds the limit, fit again; the first fit stands if too few points remain.

    The limit is a number (residual ``<=``), or ``times_median * median + limit`` of the group (residual ``<``). Output:
    ``points``, ``kept``, ``used``, the coefficients, ``rms`` and, with a median limit, the median ``residual`` of the points used.
    """
    by = list(by)
    # every step reads the one before it twice: stored, each runs once, and no task holds the sorts of all of them
    first = cut_lineage(with_residuals(df, fit_affine(df, by, src, dst), by, src, dst).drop("loo"))
    if times_median is None:
        marked = first.withColumn("__keep", F.col("res") <= limit)
    else:
        first = first.join(percentiles(first, by, "res", {"__med": 0.5}, bounded=bounded), by)
        marked = cut_lineage(first.withColumn("__keep", F.col("res") < times_median * F.col("__med") + limit))
    tally = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.count_if("__keep").alias("kept"))
    trims = (F.col("kept") >= min_kept) & (F.col("kept") < F.col("points"))
    tally = cut_lineage(tally)
    used = cut_lineage(marked.join(tally, by).where(~trims | F.col("__keep")).select(*df.columns))
    fit = cut_lineage(fit_affine(used, by, src, dst))
    final = with_residuals(used, fit, by, src, dst)
    rms = F.sqrt(F.avg(F.pow("res", 2))).alias("rms")
    if times_median is None:
        errors = final.groupBy(*by).agg(rms)
    elif bounded:
        errors = final.groupBy(*by).agg(rms, F.percentile("res", 0.5).alias("residual"))
    else:
        errors = final.groupBy(*by).agg(rms).join(percentiles(final, by, "res", {"residual": 0.5}), by)
    return tally.join(fit.withColumnRenamed("n", "used"), by, "left").join(errors, by, "left")


@F.pandas_udf(ArrayType(DoubleType()))
def singular_values_3x3(m: pd.Series) -> pd.Series:
    """Singular values (descending) of row-major 3x3 matrices, one batched LAPACK call per Arrow batch."""
    import numpy as np

    if len(m) == 0:
        return pd.Series([], dtype=object)
    return pd.Series(list(np.linalg.svd(np.stack(m.to_numpy()).reshape(-1, 3, 3), compute_uv=False)))


@F.pandas_udf(ArrayType(DoubleType()))
def principal_axes(cov: pd.Series) -> pd.Series:
    """Eigenvalues ascending, then the matching eigenvectors, of symmetric 3x3 matrices given as xx, yy, zz, xy, xz, yz."""
    import numpy as np

    if len(cov) == 0:
        return pd.Series([], dtype=object)
    c = np.stack(cov.to_numpy())
    full = np.stack([c[:, [0, 3, 4]], c[:, [3, 1, 5]], c[:, [4, 5, 2]]], axis=1)
    w, v = np.linalg.eigh(full)
    return pd.Series(list(np.concatenate([w, v.transpose(0, 2, 1).reshape(-1, 9)], axis=1)))


def singular_values_2x2(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Closed-form singular values of [[a, b], [c, d]], larger first."""
    s = (a * a + b * b + c * c + d * d) / 2
    det = a * d - b * c
    root = F.sqrt(F.greatest(s * s - det * det, F.lit(0.0)))
    return F.sqrt(s + root), F.sqrt(F.greatest(s - root, F.lit(0.0)))


def local_frame(points: DataFrame, by: Sequence[str], coords: Sequence[str]) -> DataFrame:
    """Sample covariance of the points of each group and its principal axes; the first axis is the normal."""
    x, y, z = coords
    pairs = [(x, x), (y, y), (z, z), (x, y), (x, z), (y, z)]
    cov = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.covar_samp(a, b) for a, b in pairs]).alias("cov"))
    full = cov.where("n >= 4").withColumn("axes", principal_axes("cov"))
    return full.select(
        *by, "n", "cov", F.slice("axes", 1, 3).alias("w"), F.slice("axes", 4, 3).alias("normal"),
        (F.col("axes")[0] / F.greatest(F.col("axes")[1], F.lit(1e-9))).alias("planarity"),
    )
