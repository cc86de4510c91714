"""Exact Euclidean distance transform of images, separable: along rows, then down columns as the lower envelope of parabolas.

The column pass works on tiles of rows. A tile sends on only the parabolas of its own envelope; those that can reach another tile meet it there, so
that what a tile has to hold is its own cells and the few vertices of envelopes that lie nearer than the best distance it knows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.session import stored


def row_distance(df: DataFrame, keys: Sequence[str], flag: str, name: str = "row") -> DataFrame:
    """Columns to the nearest flagged pixel of the same row; null in a row without one. Windows by row: nothing is collected."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    at = F.when(F.col(flag), F.col("x"))
    left = F.last(at, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(at, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(name, F.least(F.col("x") - left, right - F.col("x")))


def envelope(y, h):
    """Positions (in ascending ``y``) of the parabolas h + (t - y)^2 that are lowest somewhere, and where each begins to be."""
    import numpy as np

    kept: list[int] = []
    start: list[float] = []
    for k in range(len(y)):
        while kept:
            p = kept[-1]
            s = (h[k] + y[k] * y[k] - h[p] - y[p] * y[p]) / (2.0 * (y[k] - y[p]))
            if s > start[-1]:
                break
            kept.pop()
            start.pop()
        kept.append(k)
        start.append(s if len(kept) > 1 else -np.inf)
    return np.array(kept, int), np.array(start)


def lowest(at, y, h):
    """The least h + (t - y)^2 at each place t of ``at``; infinite without parabolas."""
    import numpy as np

    if len(y) == 0:
        return np.full(len(at), np.inf)
    kept, start = envelope(y, h)
    best = kept[np.searchsorted(start, at, side="right") - 1]
    return h[best] + (at - y[best]) ** 2.0


def distance_transform(df: DataFrame, keys: Sequence[str], flag: str, tile: int = 1024, strip: int = 32, name: str = "distance") -> DataFrame:
    """Adds the distance of each stored pixel (keys, y, x) to the nearest flagged one of its image; null in an image without one.

    The image must store every pixel of its extent. The column pass has a group per ``tile`` rows and ``strip`` columns; vertices of envelopes go to the
    tiles whose own best distance they may beat.
    """
    keys = list(keys)
    types = dict(df.dtypes)
    near = row_distance(df.select(*keys, "y", "x", F.col(flag).alias("__f")), keys, "__f", "__row")
    cells = near.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.pow(F.col("__row").cast("double"), 2).alias("h"))
    place = [F.floor(F.col("y") / tile).alias("t"), F.floor(F.col("x") / strip).alias("s")]
    typed = ", ".join(f"`{k}` {types[k]}" for k in keys)
    lead = f"{typed}, " if keys else ""

    def vertices(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each column of a tile: the envelope's vertices, and the greatest distance that is left at any of its cells."""
        parts = []
        for x, part in pdf.sort_values("y").groupby("x", sort=False):
            own = part[part["h"].notna()]
            y, h = own["y"].to_numpy(), own["h"].to_numpy()
            kept = envelope(y, h)[0]
            reach = float(lowest(part["y"].to_numpy(), y, h).max())
            got = own.iloc[kept][[*keys, "y", "x", "h"]] if len(kept) else part.iloc[:1][[*keys, "y", "x"]].assign(h=float("nan"))
            parts.append(got.assign(t=part["t"].iloc[0], reach=reach))
        return pd.concat(parts)

    tiled = cells.select(*keys, "y", "x", "h", *place)
    edges = tiled.groupBy(*keys, "t", "s").applyInPandas(vertices, f"{lead}y long, x long, h double, t long, reach double")
    edges = stored(edges, "envelopes")
    asks = edges.groupBy(*keys, "x", "t").agg(F.max("reach").alias("reach"))
    # the nearest vertices of other tiles bound what a tile without any has to ask for
    low, high = F.col("t") * tile, F.col("t") * tile + tile - 1
    line = Window.partitionBy(*keys, "x").orderBy("t")
    lit = edges.where("h IS NOT NULL").groupBy(*keys, "x", "t").agg(F.min(F.struct("h", "y")).alias("v"))
    known = asks.join(lit, [*keys, "x", "t"], "left")
    bound = None
    for side in (F.last("v", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.first("v", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))):
        worst = side["h"] + F.pow(F.greatest(F.abs(side["y"] - low), F.abs(side["y"] - high)), 2)
        bound = worst if bound is None else F.least(bound, worst)
    known = known.withColumn("reach", F.least("reach", F.coalesce(bound, F.lit(float("inf")))))
    far = F.ceil(F.sqrt("reach") / tile).cast("long")
    ends = edges.groupBy(*keys).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    known = known.join(ends, keys) if keys else known.withColumns({c: ends.select(c).scalar() for c in ("first", "last")})
    span = F.when(F.col("reach") == float("inf"), F.array().cast("array<bigint>")).otherwise(F.sequence(F.greatest(F.col("t") - far, F.col("first")), F.least(F.col("t") + far, F.col("last"))))
    asked = known.select(*keys, "x", F.col("t").alias("to"), F.col("reach").alias("limit"), F.explode(span).alias("t")).where(F.col("t") != F.col("to"))
    sent = edges.where("h IS NOT NULL").join(asked, [*keys, "x", "t"])
    gap = F.greatest(F.col("to") * tile - F.col("y"), F.col("y") - F.col("to") * tile - (tile - 1), F.lit(0))
    sent = sent.where(F.col("h") + gap * gap <= F.col("limit")).select(*keys, "y", "x", "h", F.col("to").alias("t"), F.floor(F.col("x") / strip).alias("s"), F.lit(False).alias("own"))
    both = tiled.withColumn("own", F.lit(True)).unionByName(sent)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        parts = []
        for x, part in pdf.sort_values("y").groupby("x", sort=False):
            on, own = part[part["h"].notna()], part[part["own"]]
            d = np.sqrt(lowest(own["y"].to_numpy(), on["y"].to_numpy(), on["h"].to_numpy()))
            parts.append(own[[*keys, "y", "x"]].assign(d=np.where(np.isfinite(d), d, np.nan)))
        return pd.concat(parts)

    solved = both.groupBy(*keys, "t", "s").applyInPandas(solve, f"{lead}y long, x long, d double")
    out = df.join(solved, [*keys, "y", "x"])
    return out.select(*df.columns, F.col("d").alias(name))
