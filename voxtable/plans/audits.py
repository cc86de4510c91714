"""Audits of inventories, pyramids and placements, as reports over flag columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.functions.columns import ceil_div
from voxtable.operators.ordered import percentiles_of, row_median
from voxtable.session import stored
from voxtable.operators.stats import guarded_corr


def pyramid_levels(levels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per volume: metadata flags of its levels (rows by, level, d, h, w, zscale). A pyramid has few levels, so its window is small.

    Levels must run 0, 1, 2, ...; rows and columns halve (rounded up) and depth follows the declared z scale, each within 1.
    """
    w = Window.partitionBy(*by).orderBy("level")
    first = Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = levels.withColumns({"ph": F.lag("h").over(w), "pw": F.lag("w").over(w), "d0": F.first("d").over(first), "z0": F.first("zscale").over(first), "expected": F.row_number().over(w) - 1})
    ratio = F.greatest(F.rint(F.coalesce(F.col("zscale") / F.col("z0"), F.lit(1.0))), F.lit(1.0))
    tag = F.concat(F.lit("_L"), F.col("level").cast("string"))
    deep = (F.col("level") > 0) & (F.abs(F.col("d") - F.ceil(F.col("d0") / ratio)) > 1)
    flat = (F.col("level") > 0) & ((F.abs(F.col("h") - ceil_div("ph", F.lit(2))) > 1) | (F.abs(F.col("w") - ceil_div("pw", F.lit(2))) > 1))
    gap = F.col("expected") != F.col("level")
    flags = F.array_compact(F.array(F.when(gap, F.concat(F.lit("META_GAP"), tag)), F.when(deep, F.concat(F.lit("META_DEPTH"), tag)), F.when(flat, F.concat(F.lit("META_XY"), tag)), F.when(F.col("zscale").isNull(), F.lit("META_NO_SCALES"))))
    return p.withColumn("f", flags).groupBy(*by).agg(
        F.count(F.lit(1)).alias("levels"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("flags")
    )


def depth_flags(layer_share: DataFrame, by: Sequence[str], depth_min: float = 0.9) -> DataFrame:
    """Depth flags from (by, level, frac): a level under ``depth_min`` counts only if level 0 reaches it; NULL frac = missing chunk."""
    w = Window.partitionBy(*by)
    base = F.max(F.when(F.col("level") == 0, F.col("frac"))).over(w)
    tag = F.concat(F.lit("_L"), F.col("level").cast("string"))
    flag = F.when(F.col("frac").isNull(), F.concat(F.lit("CHUNK_MISSING"), tag)).when((base >= depth_min) & (F.col("frac") < depth_min), F.concat(F.lit("DEPTH"), tag))
    return layer_share.withColumn("f", flag).groupBy(*by).agg(F.array_sort(F.collect_list("f")).alias("flags"))


def layer_share(stack: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of layers with any non-zero pixel, per volume and level."""
    per = stack.groupBy(*by, "level", "layer").agg(F.max("v").alias("m"))
    return per.groupBy(*by, "level").agg(F.avg((F.col("m") > 0).cast("double")).alias("frac"))


def cross_level(fine: DataFrame, coarse: DataFrame, by: Sequence[str], corr_min: float = 0.9) -> DataFrame:
    """Correlation of a level with the 2x2 mean of the level below over their common window; NULL if either is constant."""
    pooled = fine.groupBy(*by, "layer", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"))
    pooled = pooled.agg(F.avg("v").alias("a"), F.count(F.lit(1)).alias("c")).where("c = 4").drop("c")
    met = pooled.join(coarse.select(*by, "layer", "y", "x", F.col("v").cast("double").alias("b")), [*by, "layer", "y", "x"])
    out = met.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), guarded_corr("a", "b", 1).alias("xcorr"))
    return out.withColumn("flags", F.when(F.col("xcorr") < corr_min, F.array(F.lit("XLEVEL_L1"))).otherwise(F.array().cast("array<string>")))


def audit_rows(volumes: DataFrame, parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """One row per volume: the flags of all checks, and OK, FLAGGED, or ERROR for a volume that no check has a row of."""
    merged = merge_flags(parts, by)
    out = volumes.select(*by).distinct().join(merged, list(by), "left")
    status = F.when(F.col("flags").isNull(), "ERROR").when(F.size("flags") > 0, "FLAGGED").otherwise("OK")
    return out.withColumn("status", status).withColumn("flags", F.coalesce("flags", F.array(F.lit("ERROR"))))


def merge_flags(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """The flags of several checks, each once and in order, per volume."""
    out = None
    for p in parts:
        q = p.select(*by, "flags")
        out = q if out is None else out.unionByName(q)
    return out.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"))


def probe_chunk(chunks: DataFrame, by: Sequence[str], probes: Sequence[Column], size: str, max_value: str) -> DataFrame:
    """First probe chunk with data in the given order, else the largest chunk (``fallback``), else ``PROBE_EMPTY``."""
    rank = F.lit(None).cast("int")
    for k, p in reversed(list(enumerate(probes))):
        rank = F.when(p & (F.col(max_value) > 0), k).otherwise(rank)
    c = chunks.withColumn("__r", rank)
    key = F.struct("cy", "cx")
    out = c.groupBy(*by).agg(F.min_by(key, F.when(F.col("__r").isNotNull(), F.struct("__r", "cy", "cx"))).alias("a"), F.min("__r").alias("r"), F.max_by(F.struct("cy", "cx", F.col(max_value).alias("m")), F.struct(F.col(size), -F.col("cy"), -F.col("cx"))).alias("b"))
    empty = F.col("r").isNull() & (F.col("b.m") <= 0)
    pick = F.when(F.col("r").isNotNull(), F.col("a")).otherwise(F.struct(F.col("b.cy").alias("cy"), F.col("b.cx").alias("cx")))
    return out.select(*by, F.when(~empty, pick).alias("probe"), (F.col("r").isNull() & ~empty).alias("fallback"), F.when(empty, F.array(F.lit("PROBE_EMPTY"))).otherwise(F.array().cast("array<string>")).alias("flags"))


LEVEL_FREE = "^(DEPTH|CHUNK|META_D|META_X)"


def flag_counts(audit: DataFrame, by: Sequence[str] = (), flags: str = "flags") -> DataFrame:
    """Rows per flag, the level suffix dropped where the flag family counts all levels together."""
    f = audit.select(*by, F.explode(flags).alias("flag"))
    name = F.when(F.col("flag").rlike(LEVEL_FREE), F.regexp_replace("flag", "_L\\d+$", "")).otherwise(F.col("flag"))
    return f.groupBy(*by, name.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def status_counts(rows: DataFrame, status: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per status word (text after the first blank, such as an error message, is dropped)."""
    return rows.groupBy(*by, F.substring_index(F.coalesce(status, F.lit("?")), " ", 1).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def placement_report(audit: DataFrame) -> DataFrame:
    """Nested audit rows -> per (scroll, reference, other): segments, median NCC without and with shift, median in-plane shift.

    Windows without a shift are skipped reasons or errors and stay out of the medians.
    """
    pairs = audit.select("segment", "reference", F.explode("pairs").alias("other", "p"))
    # the windows of a pair lie in one row, so that their medians need no exchange
    wins = F.filter("p.windows", lambda w: w["shift_um"].isNotNull())
    along = lambda k: F.transform("w", lambda w: w["shift_um"][k].cast("double"))
    shifts = [along(k).alias(f"s{k}") for k in range(3)]
    recs = pairs.select("segment", "reference", "other", "p", wins.alias("w")).where(F.size("w") > 0).select(
        "segment", "reference", "other", F.col("p.median_ncc0").alias("ncc0"), F.col("p.median_best").alias("best"), F.col("p.grid_um").alias("grid"), *shifts
    ).withColumns({f"m{k}": row_median(f"s{k}") for k in range(3)})
    recs = recs.select(
        F.substring_index("segment", "/", 1).alias("scroll"), F.substring_index("reference", "-", 1).alias("ref"), F.substring_index("other", "-", 1).alias("scan"),
        "segment", "ncc0", "best", "grid", F.hypot("m1", "m2").alias("inplane"), F.col("m0").alias("dz"),
    )
    return recs


def group_medians(recs: DataFrame, by: Sequence[str], values: Sequence[str], first: str | None = None, first_key: str | None = None) -> DataFrame:
    """Count and exact median of each value per group, plus one carried attribute."""
    recs = stored(recs, "recs")  # read by the counts and by the medians
    aggs = [F.count(F.lit(1)).alias("n")]
    if first:
        aggs.append(F.min_by(first, first_key).alias(first))
    medians = percentiles_of(recs, by, {v: {f"median_{v}": 0.5} for v in values})
    return recs.groupBy(*by).agg(*aggs).join(medians, list(by), "left")


def exactly_one(inventory: DataFrame, owner: str, kind: str, wanted: Sequence[str]) -> DataFrame:
    """Status per owner: ``ok`` if each wanted kind occurs exactly once, else the first kind that does not."""
    out = inventory.groupBy(owner).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{i}") for i, k in enumerate(wanted)])
    status = F.lit("ok")
    for i, k in reversed(list(enumerate(wanted))):
        status = F.when(F.col(f"n_{i}") == 0, F.lit(f"missing {k}")).when(F.col(f"n_{i}") > 1, F.lit(f"ambiguous {k}")).otherwise(status)
    return out.select(owner, status.alias("status"))


def asset_status(assets: DataFrame, counts: dict[str, str], shapes_agree: Column, unlabelled_test: Column) -> DataFrame:
    """Adds ``status``: the assets (name: column with how many were found) that are not there exactly once; else a mismatch of shapes; else a test
    segment without labels; else ok."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) != 1, F.lit(name)) for name, c in counts.items()]))
    status = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
    return assets.withColumn("status", status.when(unlabelled_test, "unlabelled test segment").when(~F.coalesce(shapes_agree, F.lit(False)), "shape mismatch").otherwise("ok"))


def reference_pairs(stacks: DataFrame, segment: str, stack: str, um: str, target_um: float = 2.4, named: str | None = None) -> DataFrame:
    """Reference stack per segment (a name match if given, else the scale nearest the target, first by name) joined to every other."""
    order = F.struct(F.abs(F.col(um) - target_um).alias("d"), F.col(stack).alias("s"))
    if named:
        order = F.struct((~F.col(stack).contains(named)).alias("miss"), F.abs(F.col(um) - target_um).alias("d"), F.col(stack).alias("s"))
    ref = stacks.groupBy(segment).agg(F.min_by(F.struct(F.col(stack).alias("r"), F.col(um).alias("rum")), order).alias("r"), F.count(F.lit(1)).alias("c")).where("c >= 2")
    out = stacks.join(ref, segment).where(F.col(stack) != F.col("r.r"))
    return out.select(segment, F.col("r.r").alias("reference"), F.col("r.rum").alias("reference_um"), F.col(stack).alias("other"), F.col(um).alias("other_um"), (2 * F.greatest(F.col(um), F.col("r.rum"))).alias("grid_um"))
