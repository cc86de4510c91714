"""Greedy selection, sampling and folds, written as parallel rounds instead of one sequential walk.

A greedy pick in a fixed priority order keeps a candidate unless a better one in its exclusion box was kept. That set is
found in rounds: every candidate that is the best of its own exclusion box is kept at once and its neighbours drop
out, which yields exactly the sequential result. A round is two windowed minima on bounded tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.columns import seeded_order
from voxtable.operators.ordered import numbered
from voxtable.operators.raster import box_sum, map_tiles, sliding
from voxtable.session import cut_lineage, stored


def greedy_separated(
    candidates: DataFrame, keys: Sequence[str], order: Sequence[Column], sep_y: int, sep_x: int, cap: int | None = None, tile: int | None = None
) -> DataFrame:
    """Candidates (keys, y, x) kept by a greedy pass in ``order`` (ascending): none within ``sep_y`` rows and ``sep_x``
    columns of a better kept one. With ``cap`` the first ``cap`` per key, numbered in ``pick``.

    A round is a walk through every tile and its halo, which goes on while the block decides by itself; only what hangs on a chain that crosses its border
    waits for the next round. A key stops taking rounds once ``cap`` of its picks precede everything still undecided.
    """
    keys = list(keys)
    tile = tile or max(64, 4 * max(sep_y, sep_x))
    firsts = {f"__o{k}": c for k, c in enumerate(order)}
    placed = cut_lineage(numbered(candidates.withColumns(firsts), keys, [*firsts, "y", "x"], "__prio").drop(*firsts, "__prio_of"))
    reach = (sep_y - 1, sep_x - 1)

    def decide(block, cut):
        """The walk within a block as far as it is certain: a cell wins if no better one is left around it, and all around it lies in the block."""
        certain = np.ones(block.shape, bool)
        for axis, (half, (below, above)) in enumerate(zip(reach, cut)):
            span = np.moveaxis(certain, axis, 0)
            span[: half if below else 0] = False
            span[len(span) - (half if above else 0) :] = False
        open_, state = block, np.zeros(block.shape, int)
        won = block < 0  # by the round before, in whichever tile
        while True:
            near = won.astype(float)
            for axis, half in enumerate(reach):
                near = sliding(near, half, axis, np.maximum, 0.0)
            state[(near > 0) & np.isfinite(open_)] = 1
            state[won] = 2
            open_ = np.where(near > 0, np.inf, open_)
            best = open_
            for axis, half in enumerate(reach):
                best = sliding(best, half, axis, np.minimum, np.inf)
            won = (best == open_) & np.isfinite(open_) & certain
            if not won.any():
                return {"__state": state}

    left = placed.select(*keys, "y", "x", "__prio")
    kept = won = None
    while True:
        state = map_tiles(left if won is None else left.unionByName(won.withColumn("__prio", F.lit(-1).cast("long"))), keys, ("y", "x"), "__prio", tile, 2 * max(reach), decide, {"__state": "int"}, fill=float("inf"), edges=True)
        state = cut_lineage(state.join(left, [*keys, "y", "x"]))
        won = state.where("__state = 2").drop("__state")
        kept = won if kept is None else kept.unionByName(won)
        left = state.where("__state = 0").drop("__state")
        if cap is not None:
            kept = cut_lineage(kept)
            ahead = left.groupBy(*keys).agg(F.min("__prio").alias("__next"))
            known = kept.join(ahead, keys) if keys else kept.withColumn("__next", ahead.scalar())
            done = known.groupBy(*keys).agg(F.count_if(F.col("__prio") < F.col("__next")).alias("__c")).where(F.col("__c") >= cap)
            if keys:
                left = left.join(done.select(*keys), keys, "left_anti")
            elif not done.isEmpty():
                break
        if left.isEmpty():
            break
    chosen = placed.join(kept.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")
    if cap is None:
        return chosen.drop("__prio")
    # the kept rows of a key are numbered, never its candidates
    return numbered(chosen, keys, ["__prio"], "pick").where(F.col("pick") <= cap).drop("__prio", "pick_of")


def densest_boxes(
    density: DataFrame, keys: Sequence[str], value: str, size_y: int, size_x: int, cap: int, allowed: str | None = None, stop_share: float | None = None
) -> DataFrame:
    """Greedy densest non-overlapping ``size_y`` x ``size_x`` boxes (corner y, x) whose every cell is stored and allowed.

    ``stop_share`` also drops boxes below that share of the best box of the key.
    """
    keys = list(keys)
    cells = density.withColumn("__one", F.coalesce(F.col(allowed).cast("int"), F.lit(0)) if allowed else F.lit(1))
    full = box_sum(cells, keys, size_y, size_x, {"__s": F.sum, "__n": F.sum}, {"__s": value, "__n": "__one"})
    boxes = full.where(F.col("__n") == size_y * size_x).select(
        *keys, (F.col("y") - size_y // 2).alias("y"), (F.col("x") - size_x // 2).alias("x"), (F.col("__s") / (size_y * size_x)).alias("density")
    )
    if stop_share is not None:
        best = boxes.groupBy(*keys).agg(F.max("density").alias("__b"))
        boxes = boxes.join(best, keys) if keys else boxes.withColumn("__b", best.scalar())
        boxes = boxes.where(F.col("density") >= stop_share * F.col("__b")).drop("__b")
    return greedy_separated(boxes.where("density > 0"), keys, [-F.col("density")], size_y, size_x, cap)


def grid_boxes(mask: DataFrame, keys: Sequence[str], size: int, flag: str, min_share: float = 0.9) -> DataFrame:
    """Boxes of a fixed grid with at least ``min_share`` of their cells covered."""
    by = [F.floor(F.col(a) / size).cast("int").alias(f"b{a}") for a in ("y", "x")]
    out = mask.groupBy(*keys, *by).agg((F.sum(F.col(flag).cast("int")) / (size * size)).alias("share"))
    return out.where(F.col("share") >= min_share)


def seeded_sample(df: DataFrame, by: Sequence[str], key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows per group in md5 order of (seed, key)."""
    return numbered(df.withColumn("__h", seeded_order(seed, *key)), by, ["__h", *key]).where(F.col("rn") <= n).drop("__h", "rn_of")


def even_sample(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """``n`` evenly spaced rows of each group: indices ``floor(k (N - 1) / (n - 1))``; groups up to ``n`` stay whole."""
    t = numbered(df, by, order)
    i, total = F.col("rn") - 1, F.col("rn_of")
    step = (total - 1) / (n - 1)
    k = F.ceil(i / step)
    hit = (total <= n) | (F.floor(k * step) == i)
    return t.where(hit).drop("rn_of")


def every_kth(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Every k-th row of the order, starting with the first."""
    return numbered(df, by, order).where(F.pmod(F.col("rn") - 1, F.lit(k)) == 0).drop("rn_of")


def dense_then_fill(df: DataFrame, by: Sequence[str], key: str, ink: str, supervised: str, n: int, min_ink: float = 0.02, min_supervised: float = 0.25, seed: int = 0) -> DataFrame:
    """Rows with ink share above the floor, densest first, then seeded-random others with enough supervision, up to ``n``."""
    cls = F.when(F.col(ink) >= min_ink, 0).when(F.col(supervised) >= min_supervised, 1)
    t = df.withColumn("__class", cls).where("__class is not null")
    t = t.withColumn("__first", F.when(F.col("__class") == 0, -F.col(ink)).otherwise(F.lit(0.0))).withColumn("__h", seeded_order(seed, key))
    return numbered(t, by, ["__class", "__first", "__h", key]).where(F.col("rn") <= n).drop("__first", "__h", "rn_of").withColumnRenamed("__class", "class")


def balanced_weights(df: DataFrame, group: str, mass: str, name: str = "weight") -> DataFrame:
    """Weight proportional to ``mass``, normalised so that every group weighs the same and all sum to one."""
    sums = df.groupBy(group).agg(F.sum(mass).alias("__m"))
    groups = sums.agg(F.count(F.lit(1)).alias("c"))
    return df.join(sums, group).withColumn(name, F.col(mass) / F.col("__m") / groups.scalar()).drop("__m")


def seed_lattice(boxes: DataFrame, spacing: int, shards: int = 1, seed: int = 0) -> DataFrame:
    """Regular seeds from ``lo + S // 2`` step S inside each box (z0, z1, y0, y1, x0, x1), in md5 order, with their shard."""
    out = boxes
    for a in ("z", "y", "x"):
        first = F.col(f"{a}0") + spacing // 2
        last = F.col(f"{a}1") - 1
        out = out.where(first <= last).withColumn(a, F.explode(F.sequence(first, last, F.lit(spacing))))
    out = numbered(out.withColumn("__h", seeded_order(seed, "z", "y", "x")), [], ["__h", "z", "y", "x"])
    return out.withColumn("shard", F.pmod(F.col("rn") - 1, F.lit(shards)).cast("int")).withColumn("id", F.col("rn") - 1).drop("__h", "rn", "rn_of")


def extremes_per_group(df: DataFrame, by: Sequence[str], value: str, key: str, n: int) -> DataFrame:
    """The ``n`` lowest (set L) and ``n`` highest (set W) rows per group; groups with fewer than ``2 n`` rows are an error row."""
    t = numbered(df, by, [value, key])
    low, high = F.col("rn") <= n, F.col("rn") > F.col("rn_of") - n
    label = F.when(F.col("rn_of") < 2 * n, "too_few").when(low, "L").when(high, "W")
    return t.withColumn("set", label).where("set is not null").drop("rn_of")


def fold_members(segments: DataFrame, rows: DataFrame, segment: str, fold: str = "fold") -> DataFrame:
    """Every (held-out fold, row): role ``test`` on the row's own fold, ``train`` on all others."""
    folds = segments.agg(F.collect_set(fold).alias("f")).scalar()
    own = rows.join(segments.select(segment, F.col(fold).alias("__own")), segment)
    out = own.withColumn("held", F.explode(folds))
    return out.withColumn("role", F.when(F.col("held") == F.col("__own"), "test").otherwise("train")).drop("__own")


def fold_violations(members: DataFrame, keys: Sequence[str], held: str = "held") -> DataFrame:
    """Every member of a fold once: whether it is tested, whether it is trained on, and whether it is both."""
    role = F.col("role")
    out = members.groupBy(held, *keys).agg(F.bool_or(role == "test").alias("in_test"), F.bool_or(role == "train").alias("in_train"))
    return out.withColumn("violation", F.col("in_test") & F.col("in_train"))


def guarded_fold_plan(
    patches: DataFrame, vertices: DataFrame, held: DataFrame, need: float, caps: int, coords: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Training patches per fold: not on a held-out segment, every vertex at least ``need`` from every held-out vertex,
    at most ``caps`` per segment in ``order``.

    ``patches``: fold, patch, segment, ...; ``vertices``: patch, vid, coords; ``held``: fold, hid, segment, coords.
    """
    from voxtable.operators.nearest import nearest

    held_segments = held.select("fold", "segment").distinct()
    free = patches.join(held_segments, ["fold", "segment"], "left_anti")
    points = free.select("fold", "patch").join(vertices, "patch").withColumn("vkey", F.struct("patch", "vid"))
    near = nearest(points, held, coords, "vkey", "hid", ["fold"])
    closest = stored(near.groupBy("fold", F.col("vkey.patch").alias("patch")).agg(F.min("distance").alias("min_distance")), "closest")  # ranking reads it three times
    clear = free.join(closest, ["fold", "patch"], "left").where(F.col("min_distance").isNull() | (F.col("min_distance") >= need))
    ranked = clear.withColumns({f"__o{k}": c for k, c in enumerate(order)})
    ranked = numbered(ranked, ["fold", "segment"], [*[f"__o{k}" for k in range(len(order))], "patch"])
    return ranked.where(F.col("rn") <= caps).drop("rn", "rn_of", *[f"__o{k}" for k in range(len(order))])


def weighted_tercile_edges(df: DataFrame, by: Sequence[str], z: str, weight: str, step: int = 10) -> DataFrame:
    """First z whose cumulative weight share reaches 1/3 and 2/3, rounded half-even to ``step``."""
    from voxtable.operators.ordered import running_totals

    sums = df.groupBy(*by, z).agg(F.sum(F.col(weight)).alias("__w"))
    run = running_totals(sums, by, [z], ["__w"])
    share = (F.col("__w_before") + F.col("__w")) / F.col("__w_total")
    edges = run.groupBy(*by).agg(*[F.min(F.when(share >= q, F.col(z))).alias(n) for n, q in (("lower", 1 / 3), ("upper", 2 / 3))])
    return edges.select(*by, *[(F.bround(F.col(n) / step) * step).cast("long").alias(n) for n in ("lower", "upper")])


def band_of(z: Column, lower: Column, upper: Column) -> Column:
    return F.when(z < lower, 0).when(z < upper, 1).otherwise(2)


def band_plan(cells: DataFrame, by: Sequence[str], edges: DataFrame, value: str, size: int, cap: int) -> DataFrame:
    """Densest disjoint windows per band: only cells whose z range (``min_z``, ``max_z``) lies wholly in one band count.

    ``cells``: by, y, x, min_z, max_z and the value; ``edges``: by, lower, upper. Up to ``cap`` windows per group and band.
    """
    keys = [*by, "band"]
    j = cells.join(edges, list(by)) if by else cells.withColumns({c: edges.select(c).scalar() for c in ("lower", "upper")})
    low, high = (band_of(F.col(c), F.col("lower"), F.col("upper")) for c in ("min_z", "max_z"))
    whole = j.where(low == high).withColumn("band", low).select(*keys, "y", "x", value)
    return densest_boxes(whole, keys, value, size, size, cap)


def first_per_band(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 2) -> DataFrame:
    return numbered(df, by, order).where(F.col("rn") <= n).drop("rn_of")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], key: str, name: str = "rank") -> DataFrame:
    """Rank from 1; ties keep the order of ``key``."""
    t = df.withColumns({f"__o{k}": c for k, c in enumerate(order)})
    cols = [f"__o{k}" for k in range(len(order))]
    return numbered(t, by, [*cols, key], name).drop(*cols, f"{name}_of")
