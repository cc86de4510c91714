"""Correlation under a shift search.

Correlation is algebraic: a tile of the reference and the matching tile of the other image (with a halo as wide as the
search) give partial sums for every shift, and the sums add up over tiles. What is shuffled is each image once plus
one row of sums per task and key; no pixel is copied per shift.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.operators.stats import ncc
from voxtable.operators.tiles import with_halo

SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def shift_sums(
    ref: DataFrame, other: DataFrame, keys: Sequence[str], axes: Sequence[str], reach: Sequence[int], value: str = "v", tile: int = 32, method: str = "fft", masked: bool = True
) -> DataFrame:
    """Per key and shift: the six sums over reference pixels p and ``other[p + shift]`` (pixels stored in both, > 0 if ``masked``).

    A block is ``tile`` or four times the reach wide, whichever is more, so that its halo stays a small part of it. ``method='fft'`` gets all shifts of a
    block from one transform (overlap-save: the halo keeps wrapped products out), ``'direct'`` from a loop. A block gives one row of arrays; tasks add
    theirs up before they are exchanged.
    """
    keys, axes = list(keys), list(axes)
    tiles = [max(tile, 4 * r) for r in reach]
    a = with_halo(ref.select(*keys, *axes, F.col(value).cast("double").alias("__v")), keys, {c: (t, 0) for c, t in zip(axes, tiles)}).withColumn("__side", F.lit(0))
    b = with_halo(other.select(*keys, *axes, F.col(value).cast("double").alias("__v")), keys, {c: (t, r) for c, t, r in zip(axes, tiles, reach)}).withColumn("__side", F.lit(1))
    shifts = [f"d{c}" for c in axes]
    spans = [2 * r + 1 for r in reach]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        side = pdf["__side"].to_numpy()
        if (side == 0).sum() == 0 or (side == 1).sum() == 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*keys, "sums"]})
        lo = [int(pdf[f"t_{c}"].iloc[0]) * t for c, t in zip(axes, tiles)]
        big = [t + 2 * r for t, r in zip(tiles, reach)]
        x, mx = np.zeros(tiles), np.zeros(tiles)
        y, my = np.zeros(big), np.zeros(big)
        v = pdf["__v"].to_numpy()
        for s, arr, m, pad in ((0, x, mx, [0] * len(axes)), (1, y, my, list(reach))):
            sel = side == s
            at = tuple(pdf[c].to_numpy()[sel] - l + p for c, l, p in zip(axes, lo, pad))
            arr[at] = v[sel]
            m[at] = (v[sel] > 0) if masked else 1.0
        x, y = x * mx, y * my
        small, large = {"m": mx, "a": x, "aa": x * x}, {"m": my, "b": y, "bb": y * y}
        pairs = (("m", "m"), ("a", "m"), ("m", "b"), ("aa", "m"), ("m", "bb"), ("a", "b"))
        sums = np.zeros([len(SUMS), *spans])
        if method == "fft":
            every = range(len(axes))
            f = {k: np.conj(np.fft.rfftn(p, big, every)) for k, p in small.items()}
            g = {k: np.fft.rfftn(q, big, every) for k, q in large.items()}
            for k, (p, q) in enumerate(pairs):
                sums[k] = np.fft.irfftn(g[q] * f[p], big, every)[tuple(slice(0, n) for n in spans)]
        else:
            for d in np.ndindex(*spans):
                cut = tuple(slice(k, k + t) for k, t in zip(d, tiles))
                for k, (p, q) in enumerate(pairs):
                    sums[(k, *d)] = (small[p] * large[q][cut]).sum()
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "sums": [sums.ravel()]})

    types = dict(ref.dtypes)
    typed = [f"`{k}` {types[k]}" for k in keys]
    blocks = a.unionByName(b).groupBy(*keys, *[f"t_{c}" for c in axes]).applyInPandas(run, ", ".join([*typed, "sums array<double>"]))
    added = blocks.mapInPandas(lambda batches: _added(batches, keys), ", ".join([*typed, "sums array<double>"]))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total, first = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.column(batch.schema.get_field_index("sums"))[k].values.to_numpy()
                total = row.copy() if total is None else np.add(total, row, out=total)
                first = batch.slice(k, 1) if first is None else first
        sums = total.reshape(len(SUMS), -1)
        places = np.indices(spans).reshape(len(spans), -1) - np.array(reach)[:, None]
        columns = [pa.array([first.column(first.schema.get_field_index(k))[0].as_py()] * sums.shape[1], first.schema.field(k).type) for k in keys]
        columns += [pa.array(p.astype("int32")) for p in places] + [pa.array(p) for p in sums]
        yield pa.RecordBatch.from_arrays(columns, [*keys, *shifts, *SUMS])

    schema = ", ".join([*typed, *(f"{s} int" for s in shifts), *(f"{n} double" for n in SUMS)])
    added = added if keys else added.withColumn("__all", F.lit(0))
    return added.groupBy(*(keys or ["__all"])).applyInArrow(told, schema)


def _added(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """One row per key of a task: the arrays of its blocks added up."""
    import numpy as np

    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for row in batch.itertuples(index=False):
            key = tuple(row)[:-1]
            total[key] = total[key] + np.asarray(row.sums) if key in total else np.asarray(row.sums)
    if total:
        yield pd.DataFrame({**{k: [key[i] for key in total] for i, k in enumerate(keys)}, "sums": list(total.values())})


def shift_scores(sums: DataFrame, keys: Sequence[str], shifts: Sequence[str], min_n: int = 1, eps: float = 1e-12) -> DataFrame:
    """Correlation per shift from its sums; NULL under ``min_n`` common pixels."""
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    value = cov / F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)) + F.lit(eps))
    return sums.select(*keys, *shifts, "n", F.when(F.round("n") >= min_n, value).alias("ncc"))


def best_shift(scores: DataFrame, keys: Sequence[str], shifts: Sequence[str]) -> DataFrame:
    """Zero-shift value and the first maximum in C order of the shifts."""
    zero = F.lit(True)
    for s in shifts:
        zero = zero & (F.col(s) == 0)
    order = F.struct((-F.col("ncc")).alias("v"), *shifts)
    agg = scores.where("ncc IS NOT NULL").groupBy(*keys).agg(
        F.max(F.when(zero, F.col("ncc"))).alias("ncc0"), F.max("ncc").alias("best"), F.min_by(F.struct(*shifts), order).alias("__s")
    )
    return agg.select(*keys, "ncc0", "best", *[F.col(f"__s.{s}").alias(s) for s in shifts])


def coarse_to_fine(ref: DataFrame, other: DataFrame, keys: Sequence[str], reach_z: int, reach: int, fine: int = 2, min_n: int = 500, tile: int = 32) -> DataFrame:
    """Two-stage search on (layer, y, x) stacks: all shifts on 2x pooled pixels, then +-1 layer and +-``fine`` pixels around it.

    The second stage moves each key by its own coarse shift and searches a small, fixed neighbourhood.
    """
    keys = list(keys)

    def pooled(df: DataFrame) -> DataFrame:
        out = df.groupBy(*keys, "layer", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"))
        return out.agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("c"), F.min("v").alias("lo")).where("c = 4 and lo > 0").drop("c", "lo")

    axes = ("layer", "y", "x")
    names = ["dlayer", "dy", "dx"]
    coarse = best_shift(shift_scores(shift_sums(pooled(ref), pooled(other), keys, axes, (reach_z, reach // 2, reach // 2), tile=tile), keys, names, max(1, min_n // 4)), keys, names)
    centre = coarse.select(*keys, F.col("dlayer").alias("cz"), (2 * F.col("dy")).alias("cy"), (2 * F.col("dx")).alias("cx"))
    moved = other.join(centre, keys).select(
        *keys, (F.col("layer") - F.col("cz")).alias("layer"), (F.col("y") - F.col("cy")).alias("y"), (F.col("x") - F.col("cx")).alias("x"), "v"
    )
    fine_scores = shift_scores(shift_sums(ref, moved, keys, axes, (1, fine, fine), tile=tile), keys, names, min_n)
    shifted = fine_scores.join(centre, keys).select(
        *keys, (F.col("dlayer") + F.col("cz")).alias("dlayer"), (F.col("dy") + F.col("cy")).alias("dy"), (F.col("dx") + F.col("cx")).alias("dx"), "n", "ncc"
    )
    at_zero = shift_scores(shift_sums(ref, other, keys, axes, (0, 0, 0), tile=tile), keys, names, min_n).select(*keys, F.col("ncc").alias("zero"))
    found = best_shift(shifted.where((F.abs("dy") <= reach) & (F.abs("dx") <= reach)), keys, names).drop("ncc0")
    return found.join(at_zero, keys, "left").withColumnRenamed("zero", "ncc0")


def series_shift_scores(ref: DataFrame, other: DataFrame, keys: Sequence[str], index: str, value: str, reach: int, eps: float = 1e-12, min_n: int = 1) -> DataFrame:
    """One-axis search on (already aggregated) series: lags are generated per row and matched by an equi-join."""
    moved = other.select(*keys, F.col(index).alias("__i"), F.col(value).alias("__b"))
    lags = ref.select(*keys, F.col(index), F.col(value).alias("__a"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag"))
    met = lags.withColumn("__i", F.col(index) + F.col("lag")).join(moved, [*keys, "__i"])
    return met.groupBy(*keys, "lag").agg(F.count(F.lit(1)).alias("n"), ncc("__a", "__b", eps, min_n).alias("ncc"))


def grid_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], reach: int = 10, flag: str = "valid", tile: int = 64) -> DataFrame:
    """Best (dy, dx) by the share of equal flags over the overlap, first maximum in C order."""
    def coded(df: DataFrame) -> DataFrame:
        return df.select(*keys, "y", "x", F.when(F.col(flag), 2.0).otherwise(1.0).alias("v"))

    s = shift_sums(coded(a), coded(b), keys, ("y", "x"), (reach, reach), tile=tile)
    # with codes 1 and 2: sum of (a - b)^2 counts the disagreements
    share = s.select(*keys, "dy", "dx", "n", (1 - (F.col("saa") + F.col("sbb") - 2 * F.col("sab")) / F.col("n")).alias("ncc"))
    out = best_shift(share.where("n > 0"), keys, ["dy", "dx"])
    return out.withColumnRenamed("best", "agreement").withColumnRenamed("ncc0", "agreement0")
