"""Exact nearest-neighbour joins without pairing a query with every target.

Targets are reduced to distinct coordinates and summarised by a pyramid of grid cells, each with the tight bounding box
of its points; the depth is the least at which no cell holds more than ``leaf`` points, so a dense cluster only makes the pyramid
deeper, down to where doubles tell no points apart. Each query first goes down to one cell, whose nearest target bounds its distance from above. Then
queries walk the pyramid together, one equi-join per level: a cell stays a candidate only if its box can still beat the best guaranteed distance. A candidate is a row, never part of a list, and the best distance of
a query is a window over its rows, which spills; candidates go into parts of about ``PART_ROWS`` rows, however many queries there are. The walk is exact for any cell size; ``max_distance`` only prunes earlier.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtable.operators.ordered import numbered
from voxtable.session import cut_lineage, stored

BRANCH = 4
LEAF = 64
#: Cells of extent / 4 ** 25 are as small as doubles tell apart.
MAX_DEPTH = 25
CROWDED = 64
#: Rows of a part, where the number of parts follows the rows.
PART_ROWS = 1 << 20


def _cell(c: str, origin: float, size: float) -> Column:
    return F.floor((F.col(c) - F.lit(origin)) / F.lit(size)).cast("long")


def parts(spark: SparkSession, rows: float) -> int:
    """Into how many parts so many rows go: what the session asks for, and more for many rows, so that a task's memory stays the same."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / PART_ROWS))


def _box_bounds(coords: Sequence[str], low, high) -> tuple[Column, Column]:
    near, far = F.lit(0.0), F.lit(0.0)
    for c in coords:
        q, lo, hi = F.col(c), low(c), high(c)
        near = near + F.pow(F.greatest(lo - q, q - hi, F.lit(0.0)), 2)
        far = far + F.pow(F.greatest(F.abs(q - lo), F.abs(q - hi)), 2)
    return near, far


def nearest(
    left: DataFrame,
    right: DataFrame,
    coords: Sequence[str],
    left_id: str,
    right_id: str,
    on: Sequence[str] = (),
    max_distance: float | None = None,
    leaf: int = LEAF,
) -> DataFrame:
    """Nearest target of each query: ``on``, ``left_id``, ``right_id``, ``distance``. Ties go to the smallest target id.

    Queries without a target (within ``max_distance``) are absent: left-join the result to keep them.
    """
    coords, on = list(coords), list(on)
    known = F.lit(True)
    for c in coords:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    targets = right.where(known).groupBy(*on, *[F.col(c).cast("double").alias(c) for c in coords]).agg(F.min(right_id).alias("__tid"))
    queries = left.where(known).select(*on, F.col(left_id).alias("__qid"), *[F.col(c).cast("double").alias(c) for c in coords])

    # distinct targets are read by every pyramid step: materialise coordinates and ids once; queries are counted and read
    targets = stored(targets, "targets")
    queries = stored(queries, "queries")
    span = targets.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{t}_{c}") for c in coords for t, f in (("lo", F.min), ("hi", F.max))]).first()
    count = span["n"] or 0
    out_schema = (queries.select(*on, F.col("__qid").alias(left_id)), targets.select(F.col("__tid").alias(right_id)))
    if count == 0:
        return out_schema[0].where(F.lit(False)).withColumn(right_id, F.lit(None).cast(out_schema[1].schema[0].dataType)).withColumn(
            "distance", F.lit(None).cast("double")
        )
    origin = {c: float(span[f"lo_{c}"]) for c in coords}
    extent = max(max(float(span[f"hi_{c}"]) - origin[c] for c in coords), 1e-9) * (1 + 1e-9)

    def cells(level: int) -> list[Column]:
        return [_cell(c, origin[c], extent / BRANCH**level).alias(f"k_{c}") for c in coords]

    keys = [f"k_{c}" for c in coords]
    least = max(1, math.ceil(math.log(max(count / leaf, 1.0001)) / (len(coords) * math.log(BRANCH))))
    tried = sorted({min(MAX_DEPTH, least + k) for k in (0, 1, 2, 3, 5, 8, MAX_DEPTH)})
    by_depth = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), *cells(d)) for d in tried])).alias("c")
    # a small table is read by one task, and a cell of each depth for each target is much for it to hold
    dealt = targets.repartition(parts(left.sparkSession, count * len(tried)), *on, *coords)
    held = dealt.select(*on, by_depth).groupBy(*on, "c").count().groupBy("c.depth").agg(F.max("count").alias("most")).collect()  # a row per depth
    depth = min([r.depth for r in held if r.most <= leaf], default=MAX_DEPTH)

    placed = targets.select("*", *cells(depth))
    lows = [F.min(f"lo_{c}").alias(f"lo_{c}") for c in coords]
    highs = [F.max(f"hi_{c}").alias(f"hi_{c}") for c in coords]
    boxes = dealt.select("*", *cells(depth)).groupBy(*on, *keys).agg(*[f(c).alias(f"{t}_{c}") for c in coords for t, f in (("lo", F.min), ("hi", F.max))])
    if depth == 1:
        nodes = {1: boxes}
    else:
        up = boxes.withColumn("__level", F.explode(F.sequence(F.lit(1), F.lit(depth))))
        parents = [F.floor(F.col(k) / F.pow(F.lit(float(BRANCH)), F.lit(depth) - F.col("__level"))).cast("long").alias(k) for k in keys]
        pyramid = up.groupBy(*on, "__level", *parents).agg(*lows, *highs)
        if depth > 2:
            pyramid = cut_lineage(pyramid)
        nodes = {level: pyramid.where(F.col("__level") == level).drop("__level") for level in range(1, depth + 1)}

    limit = F.lit(float(max_distance) ** 2 if max_distance is not None else float("inf"))
    sides = [f"{t}_{c}" for c in coords for t in ("lo", "hi")]
    near, far = _box_bounds(coords, lambda c: F.col(f"lo_{c}"), lambda c: F.col(f"hi_{c}"))
    own = Window.partitionBy(*on, "__qid", *coords)
    asked = queries.count()
    # on random embeddings a query keeps two or three cells of a level; the parts leave room for twice the children of one
    tasks = parts(left.sparkSession, asked * 2.0 * BRANCH ** min(len(coords), 3))
    paths = parts(left.sparkSession, asked * 4.0)

    def survivors(met: DataFrame) -> DataFrame:
        """Of each query the cells that can still hold its nearest target, with the best distance that one of them guarantees."""
        met = met.withColumn("__near", near).where(F.col("__near") <= F.col("__best")).withColumn("__far", far).drop(*sides)
        met = met.repartition(tasks, *on, "__qid")  # not by coordinates: a window over doubles normalises them and would be dealt out again
        met = met.withColumn("__best", F.least("__best", F.min("__far").over(own))).where(F.col("__near") <= F.col("__best"))
        return met.select(*on, "__qid", *coords, "__best", *keys)

    first = nodes[1].select(*on, *keys, *sides)  # BRANCH ** coordinates cells at most
    listed = None if on else first.agg(F.collect_list(F.struct(*keys, *sides)).alias("c")).select("c").scalar()

    def top(asking: DataFrame) -> DataFrame:
        """Queries with every cell of the first level."""
        if on:
            return asking.join(first, on)
        return asking.withColumn("__c", F.explode(listed)).select(*asking.columns, *(F.col(f"__c.{k}").alias(k) for k in (*keys, *sides)))

    # the way down to the nearest box, a nearly equal one by how far it reaches: it matters for speed alone, so a cell's place among its siblings
    # rides on a rounded distance
    slots = BRANCH ** len(coords)
    slot = sum((F.pmod(F.col(k), F.lit(BRANCH)) * BRANCH**i for i, k in enumerate(keys[1:], 1)), F.pmod(F.col(keys[0]), F.lit(BRANCH)))
    rough = (F.least(F.sqrt(near + far * 2.0**-20) / extent, F.lit(2.0**20)) * (2.0**41 / max(slots, 64))).cast("long")

    def nearest_child(met: DataFrame, of: Sequence[str]) -> DataFrame:
        at = F.pmod(F.col("__at"), F.lit(slots))
        digit = [F.pmod(F.floor(at / BRANCH**i), F.lit(BRANCH)) for i in range(len(keys))]
        up = [F.col(f"up_{k}") * BRANCH if of else F.lit(0) for k in keys]
        held = met.groupBy(*on, "__qid", *coords, *of).agg(F.min(rough * slots + slot).alias("__at"))
        return held.select(*on, "__qid", *coords, *((u + d).cast("long").alias(k) for u, d, k in zip(up, digit, keys)))

    def below(level: int) -> DataFrame:
        return nodes[level].select(*on, *[F.floor(F.col(k) / BRANCH).cast("long").alias(f"up_{k}") for k in keys], *keys, *sides).hint("merge")

    ups = [f"up_{k}" for k in keys]
    sq = F.lit(0.0)
    for c in coords:
        sq = sq + F.pow(F.col(c) - F.col(f"t_{c}"), 2)
    leaves = placed.select(*on, *keys, "__tid", *[F.col(c).alias(f"t_{c}") for c in coords]).hint("merge")
    path = nearest_child(top(queries.repartition(paths, *on, "__qid")), [])
    for level in range(2, depth + 1):
        path = nearest_child(path.withColumnsRenamed(dict(zip(keys, ups))).repartition(paths, *on, *ups).join(below(level), [*on, *ups]), ups)
    bound = path.repartition(paths, *on, *keys).join(leaves, [*on, *keys]).groupBy(*on, "__qid", *coords, *keys).agg(F.min(sq).alias("__best"))
    start = stored(bound.select(*on, "__qid", *coords, F.least("__best", limit).alias("__best")), "bounds")
    front = survivors(top(start))
    # candidates and cells both grow with the input, so neither side may be collected for a broadcast
    for level in range(2, depth + 1):
        parents = front.withColumnsRenamed(dict(zip(keys, ups))).repartition(tasks, *on, *ups)
        front = survivors(parents.join(below(level), [*on, *ups]))

    found = front.repartition(tasks, *on, *keys).join(leaves, [*on, *keys]).withColumn("__sq", sq).where(F.col("__sq") <= F.col("__best"))
    best = found.groupBy(*on, "__qid").agg(F.min(F.struct("__sq", "__tid")).alias("__m"))
    return best.select(*on, F.col("__qid").alias(left_id), F.col("__m.__tid").alias(right_id), F.sqrt("__m.__sq").alias("distance"))


def within(left, right, coords, left_id, right_id, radius: float, on=(), clamp: bool = False) -> DataFrame:
    """Bounded nearest join that keeps every query: NULL target beyond ``radius``, distance NULL or clamped to it."""
    found = nearest(left, right, coords, left_id, right_id, on, max_distance=radius)
    kept = left.select(*on, left_id).join(found, [*on, left_id], "left")
    return kept.withColumn("distance", F.coalesce("distance", F.lit(float(radius)))) if clamp else kept


def scope(left, right, coords, left_id, right_id, radius: float, on=()) -> DataFrame:
    """Rows of ``left`` with a target within ``radius`` (semi join)."""
    return left.join(nearest(left, right, coords, left_id, right_id, on, radius).select(*on, left_id), [*on, left_id], "left_semi")


def guarded_groups(
    members: DataFrame, held_out: DataFrame, coords: Sequence[str], member_id: str, held_id: str, group: str, need: float
) -> DataFrame:
    """Groups none of whose members comes nearer than ``need`` to a held-out point (leakage guard)."""
    near = nearest(members, held_out, coords, member_id, held_id, max_distance=need).where(F.col("distance") < need)
    touched = members.join(near.select(member_id), member_id, "left_semi").select(group).distinct()
    return members.select(group).distinct().join(touched, group, "left_anti")


def shared_group_pairs(members: DataFrame, member: str, group: str, min_shared: int, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``a < b`` that share at least ``min_shared`` groups, with the count.

    If the most crowded group is small (``CROWDED``), one self-join and a count do it, in parts of about ``PART_ROWS`` rows however many there are.
    Otherwise a prefix filter keeps crowded
    groups from being expanded: ordering each member's groups from rarest to most common, a qualifying pair must meet before the last
    ``min_shared - 1`` of either list, and the candidates that remain are counted exactly, walking the shorter list.
    """
    m = members.select(F.col(member).alias("m"), F.col(group).alias("g"))
    m = m.repartition(parts(members.sparkSession, m.count()), "m", "g").distinct()
    sizes = m.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    found = sizes.agg(F.max("size").alias("most"), F.sum("size").alias("rows"), F.sum(F.col("size") * (F.col("size") - 1) / 2).alias("pairs")).first()
    if (found.most or 0) <= crowded:
        held = m.repartition(parts(members.sparkSession, found.rows or 0), "g")
        met = held.select("g", F.col("m").alias("a")).join(held.select("g", F.col("m").alias("b")).hint("merge"), "g").where("a < b").select("a", "b")
        met = met.repartition(parts(members.sparkSession, found.pairs or 0), "a", "b")
        return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)
    sized = m.join(sizes, "g")
    ranked = numbered(sized, ["m"], ["size", "g"])
    prefix = ranked.where(F.col("rn") <= F.col("rn_of") - (min_shared - 1)).select("m", "g", F.col("rn_of").alias("len"))
    left = prefix.select("g", F.col("m").alias("a"), F.col("len").alias("la"))
    right = prefix.select("g", F.col("m").alias("b"), F.col("len").alias("lb"))
    pairs = left.join(right, "g").where("a < b").select("a", "b", "la", "lb").distinct()
    walk = pairs.select("a", "b", F.when(F.col("la") <= F.col("lb"), F.col("a")).otherwise(F.col("b")).alias("short"),
                        F.when(F.col("la") <= F.col("lb"), F.col("b")).otherwise(F.col("a")).alias("long"))
    steps = walk.join(m.select(F.col("m").alias("short"), "g"), "short")
    met = steps.join(m.select(F.col("m").alias("long"), "g"), ["long", "g"])
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)
