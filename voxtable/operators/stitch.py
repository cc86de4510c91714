"""Stitching of overlapping patches: overlap links, chained frames and the weighted mosaic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.operators.fits import trimmed_fit
from voxtable.operators.nearest import nearest
from voxtable.session import cut_lineage, stored

ZYX = ("z", "y", "x")
MAP = ("m00", "m01", "m02", "m10", "m11", "m12")


def overlap_links(
    nodes: DataFrame, reach: float = 2.5, min_hits: int = 150, max_residual: float = 2.0, max_det_error: float = 0.25, every: int = 3, cell: float = 16.0
) -> DataFrame:
    """Links a < b between patches whose tracked nodes (patch, i, j, z, y, x) coincide, with the affine map from b's grid to a's.

    Candidate pairs come from shared coarse cells; each pair is then matched exactly (nearest node of a within ``reach``
    of every ``every``-th node of b), fitted with one trim at ``3 * median + 1``, and kept if residual and area scale agree.
    Exact copies of a patch are linked to their first copy by the identity and only that one is searched, so a pile of
    copies costs one link each instead of all their pairs; the frames that follow are the same.
    """
    prints = nodes.groupBy("patch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("i", "j", *ZYX).cast("decimal(38,0)")).alias("h"), F.sum(F.hash("i", "j", *ZYX).cast("long")).alias("g"))
    heads = prints.groupBy("n", "h", "g").agg(F.min("patch").alias("head"))
    copies = cut_lineage(prints.join(heads, ["n", "h", "g"]).where("patch <> head").select("head", "patch", "n"))
    nodes = nodes.join(copies.select("patch"), "patch", "left_anti")
    same = copies.where(F.ceil(F.col("n") / every) >= min_hits).select(
        F.col("head").alias("a"), F.col("patch").alias("b"), *[F.lit(v).alias(c) for c, v in zip(MAP, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))], F.ceil(F.col("n") / every).alias("hits"), F.lit(0.0).alias("residual")
    )
    order = nodes.withColumn("nid", F.struct("i", "j"))
    cells = nodes.select("patch", *[F.floor(F.col(a) / cell).alias(f"c{a}") for a in ZYX]).distinct()
    wide = cells
    for a in ZYX:
        wide = wide.withColumn(f"c{a}", F.explode(F.array(*[F.col(f"c{a}") + k for k in (-1, 0, 1)])))
    a_side = wide.distinct().withColumnRenamed("patch", "a")
    pairs = cells.withColumnRenamed("patch", "b").join(a_side, [f"c{a}" for a in ZYX]).where("a < b").select("a", "b").distinct()

    from voxtable.operators.select import every_kth

    thin = every_kth(order.select("patch", "i", "j", *ZYX), ["patch"], ["i", "j"], every).drop("rn")
    sources = pairs.join(thin.withColumnRenamed("patch", "b"), "b").withColumn("qid", F.struct("i", "j"))
    targets = pairs.join(order.withColumnRenamed("patch", "a"), "a")
    hits = nearest(sources, targets, list(ZYX), "qid", "nid", ["a", "b"], max_distance=reach)
    matched = stored(hits.select("a", "b", F.col("qid.i").alias("bi"), F.col("qid.j").alias("bj"), F.col("nid.i").alias("ai"), F.col("nid.j").alias("aj")), "matched")
    counts = matched.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= min_hits)
    # the matches feed two fits and two medians: materialise them once
    matched = cut_lineage(matched.join(counts, ["a", "b"]).drop("hits"))
    # a pair shares at most the nodes of one patch grid, so its residuals are a bounded group
    fit = trimmed_fit(matched, ["a", "b"], ["bi", "bj"], ["ai", "aj"], 1.0, times_median=3.0, bounded=True)
    m = fit.select(
        "a", "b", F.col("a_ai_bi").alias("m00"), F.col("a_ai_bj").alias("m01"), F.col("t_ai").alias("m02"), F.col("a_aj_bi").alias("m10"), F.col("a_aj_bj").alias("m11"), F.col("t_aj").alias("m12"),
        F.col("points").alias("hits"), "residual",
    )
    det = F.abs(F.col("m00") * F.col("m11") - F.col("m01") * F.col("m10"))
    return m.where((F.col("residual") < max_residual) & (F.abs(det - 1) < max_det_error)).unionByName(same)


def _invert(prefix: str = "m") -> list[Column]:
    a, b, c, d, e, f = (F.col(f"{prefix}{k}") for k in ("00", "01", "02", "10", "11", "12"))
    det = a * e - b * d
    return [e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det]


def _rings(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Breadth-first ring of every patch (root, patch, ring) over the directed edges (root, src, dst) of the groups of ``roots``.

    Runs of patches with two neighbours are walked by pointer doubling, from both ends at once, so a chain of any length takes
    a logarithm of rounds; rings then advance over whole runs, between the root and the patches where runs meet or end.
    What a round leaves is stored as a table: the size that Spark expects of a checkpoint is the product of its joined sides, round after round.
    """
    pairs = stored(edges.select("root", "src", "dst").distinct())
    inner = pairs.groupBy("root", "src").count().where("count = 2 and src <> root").select(F.col("src").alias("patch"))
    # a walk leaves src towards dst and stands at ``end``, which it reached from ``last``; it is open as long as end has just one way on
    walks = pairs.join(inner.withColumnRenamed("patch", "dst").withColumn("open", F.lit(True)), "dst", "left").select(
        "root", "src", "dst", F.col("dst").alias("end"), F.col("src").alias("last"), F.lit(1).alias("steps"), F.coalesce("open", F.lit(False)).alias("open")
    )
    walks = stored(walks)
    while not walks.where("open").isEmpty():
        on = walks.select(F.col("src").alias("end"), F.col("dst").alias("n_dst"), F.col("end").alias("n_end"), F.col("last").alias("n_last"), F.col("steps").alias("n_steps"), F.col("open").alias("n_open"))
        moved = walks.where("open").join(on, "end").where("n_dst <> last").select(
            "root", "src", "dst", F.col("n_end").alias("end"), F.col("n_last").alias("last"), (F.col("steps") + F.col("n_steps")).alias("steps"), F.col("n_open").alias("open")
        )
        walks = stored(walks.where("not open").unionByName(moved))
    runs = stored(walks.join(inner.withColumnRenamed("patch", "src"), "src", "left_anti").groupBy("root", "src", "end").agg(F.min("steps").alias("steps")))
    met = stored(roots.select("root", F.col("root").alias("patch"), F.lit(0).alias("ring")))
    front = met
    while True:
        reached = front.withColumnRenamed("patch", "src").join(runs, ["root", "src"]).groupBy("root", F.col("end").alias("patch")).agg(F.min(F.col("ring") + F.col("steps")).alias("ring"))
        front = stored(reached.join(met.select("patch", F.col("ring").alias("known")), "patch", "left").where("known is null or ring < known").select("root", "patch", "ring"))
        if front.isEmpty():
            break
        met = stored(met.unionByName(front).groupBy("root", "patch").agg(F.min("ring").alias("ring")))
    ends = met.select(F.col("patch").alias("end"), "ring")
    within = walks.join(inner.withColumnRenamed("patch", "src"), "src", "left_semi").join(ends, "end").groupBy("root", F.col("src").alias("patch")).agg(F.min(F.col("ring") + F.col("steps")).alias("ring"))
    return stored(met.unionByName(within))


def chain_frames(links: DataFrame, scores: DataFrame, top: int) -> DataFrame:
    """Frames of all patches reachable from a root: patch grid -> root grid, composed along breadth-first links.

    Every group is rooted at its best-scored patch; groups without one of the ``top`` patches are left out. A patch reached
    by several parents takes the smallest parent id. The maps to the parents are composed by pointer doubling.
    """
    from voxtable.operators.components import graph_components
    from voxtable.operators.select import ranked

    links = stored(links)
    forward = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), *MAP)
    backward = links.select(F.col("b").alias("src"), F.col("a").alias("dst"), *[c.alias(n) for c, n in zip(_invert(), MAP)])
    groups = graph_components(links, "a", "b")
    order = ranked(scores, [], [-F.col("ts")], "patch").select("patch", "rank")
    member = stored(groups.join(order, groups.node == order.patch).select("patch", "component", "rank"))
    best = member.groupBy("component").agg(F.min(F.struct("rank", "patch")).alias("r")).where(F.col("r.rank") <= top)
    roots = stored(best.select("component", F.col("r.patch").alias("root")))
    rooted = member.join(roots, "component").select("root", F.col("patch").alias("src"))
    edges = stored(forward.unionByName(backward).join(rooted, "src"))
    rings = _rings(edges, roots)
    above = rings.select(F.col("patch").alias("src"), (F.col("ring") + 1).alias("ring"))
    parent = edges.join(above, "src").join(rings.select(F.col("patch").alias("dst"), "ring"), ["dst", "ring"]).groupBy("root", F.col("dst").alias("patch"), "ring").agg(F.min(F.struct("src", *MAP)).alias("s"))
    identity = roots.select("root", F.col("root").alias("patch"), F.lit(0).alias("ring"), F.col("root").alias("up"), *[F.lit(v).alias(n) for n, v in zip(MAP, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))])
    placed = stored(identity.unionByName(parent.select("root", "patch", "ring", F.col("s.src").alias("up"), *[F.col(f"s.{n}").alias(n) for n in MAP])))
    a = {n[1:]: F.col(n) for n in MAP}
    o = {n[1:]: F.col(f"t{n[1:]}") for n in MAP}
    made = [
        o["00"] * a["00"] + o["01"] * a["10"], o["00"] * a["01"] + o["01"] * a["11"], o["00"] * a["02"] + o["01"] * a["12"] + o["02"],
        o["10"] * a["00"] + o["11"] * a["10"], o["10"] * a["01"] + o["11"] * a["11"], o["10"] * a["02"] + o["11"] * a["12"] + o["12"],
    ]
    while not placed.where("up <> root").isEmpty():
        t = placed.select(F.col("patch").alias("up"), F.col("up").alias("next"), *[F.col(n).alias(f"t{n[1:]}") for n in MAP])
        placed = stored(placed.join(t, "up").select("root", "patch", "ring", F.col("next").alias("up"), *[c.alias(n) for c, n in zip(made, MAP)]))
    return placed.drop("up")


def mosaic(images: DataFrame, frames: DataFrame, faces: DataFrame) -> DataFrame:
    """Weighted mosaic per root: pixels (patch, face, i, j, v, ok) warped to the root grid and averaged by validity.

    ``faces``: patch, n0 (array), side. A member shows the same face as the root when their normals agree. Output: root, layer (ink/back), y, x, v, weight.
    """
    extent = images.groupBy("patch").agg((F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w"))
    placed = frames.join(extent, "patch")
    corners = placed.select("root", "patch", *MAP, F.explode(F.array(*[F.struct((F.col("h") * a).alias("i"), (F.col("w") * b).alias("j")) for a in (0, 1) for b in (0, 1)])).alias("c"))
    spot = corners.select("root", "patch", (F.col("m00") * F.col("c.i") + F.col("m01") * F.col("c.j") + F.col("m02")).alias("y"), (F.col("m10") * F.col("c.i") + F.col("m11") * F.col("c.j") + F.col("m12")).alias("x"))
    span = spot.groupBy("root", "patch").agg(*[f(a).alias(f"{t}_{a}") for a in "yx" for t, f in (("plo", F.min), ("phi", F.max))])
    ref = faces.select(F.col("patch").alias("root"), F.col("n0").alias("rn"), F.col("side").alias("rside"))
    own = placed.join(span, ["root", "patch"]).join(faces, "patch").join(ref, "root")
    agree = F.aggregate(F.zip_with("n0", "rn", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t) * F.when(F.col("rside") == "a", 1.0).otherwise(-1.0) > 0
    own = own.withColumn("ink_face", F.when(agree, "a").otherwise("b"))
    t = own.withColumn("y", F.explode(F.sequence(F.floor("plo_y").cast("int"), F.ceil("phi_y").cast("int"))))
    t = t.withColumn("x", F.explode(F.sequence(F.floor("plo_x").cast("int"), F.ceil("phi_x").cast("int"))))
    inv = _invert()
    t = t.select("root", "patch", "ink_face", "y", "x", *[c.alias(n) for c, n in zip(inv, MAP)])
    source = images.select("patch", "face", F.col("i").alias("y"), F.col("j").alias("x"), F.col("v").cast("double").alias("v"), F.col("ok").cast("double").alias("w"))
    both = t.withColumn("face", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = [[F.col("m00"), F.col("m01"), F.col("m02")], [F.col("m10"), F.col("m11"), F.col("m12")]]
    values = _warp(both, source, rows)
    layer = F.when(F.col("face") == F.col("ink_face"), "ink").otherwise("back")
    out = values.groupBy("root", layer.alias("layer"), "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("num"), F.sum("w").alias("weight"))
    return out.select("root", "layer", "y", "x", (F.col("num") / F.greatest("weight", F.lit(1e-3))).alias("v"), "weight").where("weight > 0")


def _warp(targets: DataFrame, source: DataFrame, rows: Sequence[Sequence[Column]]) -> DataFrame:
    """Linear read of value and weight at the inverse-mapped position of every canvas pixel."""
    t = targets.withColumnsRenamed({"y": "oy", "x": "ox"})
    for a, row in zip(("y", "x"), rows):
        t = t.withColumn(a, row[0] * F.col("oy") + row[1] * F.col("ox") + row[2])
    entries = []
    for dy in (0, 1):
        for dx in (0, 1):
            ty, tx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
            entries.append(F.struct((F.floor("y").cast("int") + dy).alias("y"), (F.floor("x").cast("int") + dx).alias("x"), ((ty if dy else 1 - ty) * (tx if dx else 1 - tx)).alias("k")))
    spread = t.select("root", "patch", "ink_face", "face", "oy", "ox", F.explode(F.array(*entries)).alias("c")).where("c.k > 0")
    hit = spread.select("root", "patch", "ink_face", "face", "oy", "ox", "c.y", "c.x", "c.k").join(source, ["patch", "face", "y", "x"])
    return hit.groupBy("root", "patch", "ink_face", "face", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.col("k") * F.col("v")).alias("v"), F.sum(F.col("k") * F.col("w")).alias("w"))
