"""Sinks: chunks, meshes, reports and payloads. All of them write through Spark's own committers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.columns import signed4
from voxtable.operators.chunks import to_chunks


def write_chunks(voxels: DataFrame, path: str, chunk: Sequence[int], mode: str = "append") -> None:
    """Chunk buffers partitioned by volume and level; empty chunks are not written."""
    to_chunks(voxels, chunk).write.mode(mode).partitionBy("volume_id", "level").parquet(path)


def export_mesh(mesh: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Trims to the bounding rows and columns of the valid vertices and writes -1 where invalid."""
    keys = list(keys)
    spans = [f(F.when(F.col("valid"), F.col(a))).alias(f"{t}_{a}") for a in ("i", "j") for t, f in (("lo", F.min), ("hi", F.max))]
    box = mesh.groupBy(*keys).agg(*spans)
    inside = F.col("i").between(F.col("lo_i"), F.col("hi_i")) & F.col("j").between(F.col("lo_j"), F.col("hi_j"))
    joined = mesh.join(box, keys) if keys else mesh.withColumns({c: box.select(c).scalar() for c in ("lo_i", "hi_i", "lo_j", "hi_j")})
    cut = joined.where(inside)
    return cut.select(*keys, (F.col("i") - F.col("lo_i")).alias("i"), (F.col("j") - F.col("lo_j")).alias("j"), *[F.when(F.col("valid"), F.col(c)).otherwise(-1.0).alias(c) for c in cols], "valid")


def mesh_meta(mesh: DataFrame, keys: Sequence[str], step: float, cols: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Bounding box, valid count, area ``n * step^2`` and scale ``1 / step``."""
    spans = [f(c).alias(f"{t}_{c}") for c in cols for t, f in (("min", F.min), ("max", F.max))]
    return mesh.where("valid").groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), *spans).withColumn("area_vx2", F.col("nodes") * step * step).withColumn("scale", F.lit(1 / step))


def sub_mesh(mesh: DataFrame, i0: int, i1: int, j0: int, j1: int, margin: int, rows: int, cols: int) -> DataFrame:
    """Window plus margin, clipped to the grid and re-based."""
    r0, r1, c0, c1 = max(0, i0 - margin), min(rows, i1 + margin), max(0, j0 - margin), min(cols, j1 + margin)
    cut = mesh.where((F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1))
    return cut.withColumn("i", F.col("i") - r0).withColumn("j", F.col("j") - c0)


def write_report(df: DataFrame, path: str, order: Sequence[Column], sep: str = "\t") -> None:
    """Ordered text table; ``orderBy`` range-partitions, so the part files are in order."""
    df.orderBy(*order).write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def write_rows(df: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    df.write.mode("append").json(path)


def report_columns(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[signed4(v).alias(v) for v in values])


def patch_payload(nodes: DataFrame, patches: DataFrame, every: int = 16) -> DataFrame:
    """Viewer rows: centroid of the tracked nodes, patch attributes and the nodes of every ``every``-th row and column."""
    keep = (F.pmod("i", F.lit(every)) == 0) & (F.pmod("j", F.lit(every)) == 0)
    pts = F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("i", "j", *[F.col(c).cast("int").alias(c) for c in "zyx"])))), lambda p: F.array(p["z"], p["y"], p["x"]))
    agg = nodes.where("ok").groupBy("patch").agg(*[F.avg(c).cast("int").alias(f"c{c}") for c in "zyx"], F.count(F.lit(1)).alias("nodes"), F.flatten(pts).alias("pts"))
    return agg.join(patches, "patch")
