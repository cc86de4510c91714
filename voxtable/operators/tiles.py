"""Bounded tiles with a halo: the way every neighbourhood operator is partitioned.

A cell is copied into each tile whose core lies within the halo of it. A tile then holds at most
``(tile + 2 * halo) ** axes`` cells whatever the size of the image, so windows and array kernels inside a tile are
bounded, and one shuffle on the tile key serves the windows along all axes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_key(axis: str) -> str:
    return f"t_{axis}"


def with_halo(df: DataFrame, keys: Sequence[str], axes: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Adds ``t_<axis>`` per axis and ``core`` (the row belongs to the tile itself); partitioned by keys and tile."""
    out, core = df, F.lit(True)
    for axis, (tile, halo) in axes.items():
        lo = F.floor((F.col(axis) - halo) / tile).cast("int")
        hi = F.floor((F.col(axis) + halo) / tile).cast("int")
        out = out.withColumn(tile_key(axis), F.explode(F.sequence(lo, hi)))
        core = core & (F.floor(F.col(axis) / tile).cast("int") == F.col(tile_key(axis)))
    out = out.withColumn("core", core)
    return out.repartition(*keys, *[tile_key(a) for a in axes])
