"""Surface growth: the seeds of all volumes advance together, one wave per round.

A wave is a table of its own, keyed by volume, level, patch and node. A node that is not visited yet can only border nodes of the last wave, and what lies
beyond these belongs to the last two; so a wave reads two tables and the keys of rejected nodes, and nothing that was grown is written again.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.functions.columns import cross, dot, unit
from voxtable.operators.chunks import ZYX, box_pieces, put_together, trilinear
from voxtable.session import scratch_path, stored

P, N, U, V = (tuple(f"{p}{a}" for a in ZYX) for p in ("p", "n", "u", "v"))
STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1))
SEED = ("volume_id", "level", "patch")
NODE = (*SEED, "i", "j")
FRAME = "volume_id string, level int, patch long, " + ", ".join(f"{c} double" for c in (*P, *N, *U, *V)) + ", distance double, voxels long, planarity double"


def seed_frames(seeds: DataFrame, chunks: DataFrame, chunk: Sequence[int], radius: int = 14, threshold: int = 127) -> DataFrame:
    """Snap each seed (volume_id, level, patch, z, y, x) to the nearest sheet sample of the cube around it and fit the local frame there.

    The 26-connected sheet at the snapped place is labelled within its cube; of it, what lies in the ball gives the covariance. The normal is its
    smallest axis, V the projected z axis (y if z is nearly normal), U completes the frame. A seed meets only the chunks of its cube, by key, and seeds
    without sheet or with fewer than four voxels have no row.
    """
    r = int(radius)
    reach = 2 * r + 1
    asked = seeds.select(*SEED, *ZYX, *(e.alias(f"{a}{k}") for a in ZYX for k, e in ((0, (F.floor(a) - reach).cast("int")), (1, (F.floor(a) + reach + 2).cast("int")))))
    rows = asked.select(*SEED, *(F.col(a).cast("double").alias(a) for a in ZYX)).unionByName(box_pieces(asked, chunks, chunk, SEED), allowMissingColumns=True)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = [f.split()[0] for f in FRAME.split(", ")]
        p = pdf.loc[pdf["z"].notna(), list(ZYX)].to_numpy(float)[0]
        bad = pdf["error"].dropna()
        if len(bad):
            raise ValueError(min(bad))
        low = np.floor(p).astype(int)
        box = put_together(pdf, [2 * reach + 2] * 3).astype(float)
        for axis, t in enumerate(p - low):  # samples at the seed plus whole steps: one mix of neighbours an axis
            n = box.shape[axis] - 1
            box = np.take(box, range(n), axis) * (1 - t) + np.take(box, range(1, n + 1), axis) * t
        on = box > threshold
        steps = np.indices([2 * r + 1] * 3).reshape(3, -1).T - r
        hits = steps[on[tuple((steps + reach).T)]]
        if len(hits) == 0:
            return pd.DataFrame(columns=names)
        far = np.linalg.norm(hits, axis=1)
        snap = hits[far.argmin()]
        cube = on[tuple(slice(reach + s - r, reach + s + r + 1) for s in snap)]
        member = _component(cube, r)
        idx = np.argwhere(member) - r
        idx = idx[(idx**2).sum(axis=1) <= r * r]
        if len(idx) < 4:
            return pd.DataFrame(columns=names)
        w, axes = np.linalg.eigh(np.cov(idx.T))
        n = axes[:, 0]
        v = np.eye(3)[0] - n * n[0]
        if np.linalg.norm(v) < 0.3:
            v = np.eye(3)[1] - n * n[1]
        v /= np.linalg.norm(v)
        u = np.cross(v, n)
        return pd.DataFrame([(*key, *(p + snap), *n, *(u / np.linalg.norm(u)), *v, far.min(), len(idx), w[0] / max(w[1], 1e-9))], columns=names)

    tasks = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as pieces take so few bytes that they would be put into one task
    return rows.repartition(tasks, *SEED).groupBy(*SEED).applyInPandas(fit, FRAME)


def _component(on, centre: int):
    """The 26-connected part of a cube of flags that holds its middle."""
    import numpy as np

    reached = np.zeros_like(on)
    reached[(centre,) * 3] = on[(centre,) * 3]
    while True:
        wide = np.pad(reached, 1)
        for axis in range(3):
            wide = wide | np.roll(wide, 1, axis) | np.roll(wide, -1, axis)
        wide = wide[1:-1, 1:-1, 1:-1] & on
        if (wide == reached).all():
            return reached
        reached = wide


def _messages(last: DataFrame, two: DataFrame, rejected: DataFrame, half_nodes: int) -> DataFrame:
    """What the nodes around an unvisited node tell it: near and far neighbours by direction, and whether it was visited. One exchange by node."""
    blank = [F.lit(None).cast("double").alias(c) for c in (*P, *N, *U, *V)]
    own = [F.col(c).alias(c) for c in (*P, *N, *U, *V)]
    to = lambda k: F.explode(F.array(*(F.struct((F.col("i") - k * a).alias("i"), (F.col("j") - k * b).alias("j"), F.lit(d).alias("d")) for d, (a, b) in enumerate(STEPS)))).alias("c")
    near = last.where("ok").select(*SEED, *own, to(1)).select(*SEED, "c.i", "c.j", "c.d", F.lit("near").alias("kind"), *own)
    far = two.where("ok").select(*SEED, *own, to(2)).select(*SEED, "c.i", "c.j", "c.d", F.lit("far").alias("kind"), *own)
    seen = two.select(*NODE).unionByName(rejected.select(*NODE)).select(*NODE, F.lit(0).alias("d"), F.lit("seen").alias("kind"), *blank)
    inside = (F.abs("i") <= half_nodes) & (F.abs("j") <= half_nodes)
    return near.unionByName(far).unionByName(seen).where(inside)


def _predicted(messages: DataFrame, step: float) -> DataFrame:
    """Place, normal and axes of every node that has a near neighbour and was not visited: extrapolated from each side, then averaged."""
    when = lambda kind, d, c: F.max(F.when((F.col("kind") == kind) & (F.col("d") == d), F.col(c)))
    seen = F.max((F.col("kind") == "seen").cast("int")).alias("seen")
    sides = [when("near", d, c).alias(f"{c}{d}") for d in range(4) for c in (*P, *N, *U, *V)] + [when("far", d, c).alias(f"far_{c}{d}") for d in range(4) for c in P]
    met = messages.groupBy(*NODE).agg(seen, *sides)
    there = [F.col(f"{P[0]}{d}").isNotNull() for d in range(4)]
    count = sum((t.cast("int") for t in there[1:]), there[0].cast("int"))
    met = met.where((F.col("seen") == 0) & (count > 0))
    total = lambda terms: sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0)))
    place = []
    for p, v, u in zip(P, V, U):
        guesses = []
        for d, (a, b) in enumerate(STEPS):
            linear = F.col(f"{p}{d}") - step * (a * F.col(f"{v}{d}") + b * F.col(f"{u}{d}"))
            guesses.append(F.coalesce(0.5 * linear + 0.5 * (2 * F.col(f"{p}{d}") - F.col(f"far_{p}{d}")), linear))
        place.append((total(guesses) / count).alias(p))
    return met.select(*NODE, *place, *(total([F.col(f"{c}{d}") for d in range(4)]).alias(c) for c in (*N, *U, *V)))


def grow_patches(
    frames: DataFrame, chunks: DataFrame, shape: Sequence[int], chunk: Sequence[int], half_nodes: int = 96, step: float = 4.0, search: float = 2.5, max_jump: float = 1.75, threshold: float = 90.0
) -> DataFrame:
    """Grows every seed frame (volume_id, level, patch, p*, n*, u*, v*) into a grid of (2 half + 1)^2 nodes at most.

    Rows: volume_id, level, patch, i, j, p*, n*, ok, wave; rejected nodes have ok false. Normals of tracked nodes are blended with those of the grid
    (``blended``). All volumes have the given shape and chunk.
    """
    path = scratch_path(frames.sparkSession, "grown")
    seeds = frames.select(*SEED, F.lit(0).alias("i"), F.lit(0).alias("j"), *P, *N, *U, *V, F.lit(True).alias("ok"))
    spark, schema = frames.sparkSession, seeds.schema

    def wave_table(number: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/wave={number}")

    seeds.write.parquet(f"{path}/wave=0")
    probes = [search * (2 * k / (2 * search / 0.5) - 1) for k in range(int(2 * search / 0.5) + 1)]
    rejected = None
    for wave in itertools.count(1):
        last = wave_table(wave - 1)
        two = last if wave == 1 else last.unionByName(wave_table(wave - 2))
        old = last.where("not ok") if rejected is None else rejected
        guess = stored(_predicted(_messages(last, two, old, half_nodes), step), "front")
        if guess.isEmpty():
            break
        guess = guess.withColumns(dict(zip(N, unit(list(N)))))
        probe = guess.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in probes])))
        at = probe.select(*NODE, "w", *[(F.col(p) + F.col("w") * F.col(n)).alias(a) for a, p, n in zip(ZYX, P, N)])
        values = trilinear(at, chunks, shape, chunk, [*NODE, "w"])
        weight = F.col("value") * F.exp(-0.5 * F.pow(F.col("w") / 1.5, 2))
        snap = values.groupBy(*NODE).agg(F.max("value").alias("peak"), (F.sum(weight * F.col("w")) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("off"))
        snap = stored(snap, "snapped")  # the algebra below is code of its own
        new = guess.join(snap, list(NODE)).withColumn("ok", (F.col("peak") >= threshold) & (F.abs("off") <= max_jump))
        new = new.withColumns({p: F.col(p) + F.col("off") * F.col(n) for p, n in zip(P, N)})
        lean = dot(list(U), list(N))
        new = new.withColumns({f"lean_{u}": F.col(u) - lean * F.col(n) for u, n in zip(U, N)})
        new = new.withColumns(dict(zip([f"t_{u}" for u in U], unit([f"lean_{u}" for u in U]))))
        new = new.withColumns(dict(zip([f"s_{v}" for v in V], cross(list(N), [f"t_{u}" for u in U]))))
        sign = F.when(dot([f"s_{v}" for v in V], list(V)) < 0, -1.0).otherwise(1.0)
        new = new.select(*NODE, *P, *N, *[F.col(f"t_{u}").alias(u) for u in U], *[(F.col(f"s_{v}") * sign).alias(v) for v in V], "ok")
        new.write.parquet(f"{path}/wave={wave}")
        gone = wave_table(wave).where("not ok").select(*NODE)
        rejected = gone if rejected is None else rejected.unionByName(gone)
        if wave % 16 == 0:
            rejected = stored(rejected, "rejected")
    nodes = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, wave int").parquet(path)
    return blended(nodes.drop(*U, *V))


def blended(nodes: DataFrame) -> DataFrame:
    """Normals of tracked nodes, drawn to those of the grid: every second wave halves the angle between them wherever all four neighbours are tracked.

    No wave reads a normal that was drawn before, as a node with four tracked neighbours borders no node still to come; so all halvings are done at
    once, by turning the normal through its share of the angle.
    """
    to = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in STEPS])
    sent = nodes.where("ok").select(*SEED, *P, "wave", F.explode(to).alias("c"))
    sides = [F.sum(-F.col(f"c.{k}") * F.col(p)).alias(f"{d}_{p}") for d, k in (("di", "a"), ("dj", "b")) for p in P]
    full = sent.groupBy(*SEED, F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(F.count(F.lit(1)).alias("k"), F.max("wave").alias("since"), *sides).where("k = 4")
    ends = nodes.groupBy(*SEED).agg(F.max("wave").alias("end"))
    full = full.join(ends, list(SEED)).withColumns(dict(zip([f"x_{n}" for n in N], cross([f"dj_{p}" for p in P], [f"di_{p}" for p in P]))))
    full = full.withColumns(dict(zip([f"g_{n}" for n in N], unit([f"x_{n}" for n in N]))))
    # even waves from the one that completed the neighbours, or the node itself, to the last of the patch
    g = nodes.join(full.select(*NODE, "since", "end", *(f"g_{n}" for n in N)), list(NODE), "left")
    since = F.greatest("since", "wave")
    times = F.greatest(F.floor(F.col("end") / 2) - F.floor((since - 1) / 2), F.lit(0))
    flip = F.when(dot([f"g_{n}" for n in N], list(N)) < 0, -1.0).otherwise(1.0)
    g = g.withColumns({f"g_{n}": F.col(f"g_{n}") * flip for n in N}).withColumn("angle", F.acos(F.least(dot([f"g_{n}" for n in N], list(N)), F.lit(1.0))))
    left = F.col("angle") * F.pow(F.lit(0.5), times)
    turned = [(F.sin(left) * F.col(n) + F.sin(F.col("angle") - left) * F.col(f"g_{n}")) / F.sin("angle") for n in N]
    use = F.col("ok") & (F.col("angle") > 1e-6)
    return g.select(*NODE, *P, *(F.when(use, t).otherwise(F.col(n)).alias(n) for n, t in zip(N, turned)), "ok", "wave")


def drop_covered(nodes: DataFrame, priority: Column, radius: float = 6.0) -> DataFrame:
    """Keeps, among patches whose seed node lies within ``radius`` of another patch, the ones with no better-placed cover.

    Order independent: a patch is covered if its seed sits on a tracked node of a patch with a smaller priority. (A scan
    that adds one patch at a time would depend on the scan order.)
    """
    tracked = nodes.where("ok").withColumn("prio", priority)
    r = float(radius)
    keyed = tracked.select(F.col("patch").alias("other"), F.col("prio").alias("other_prio"), *[F.col(p).alias(f"o_{p}") for p in P], *[F.floor(F.col(p) / r).alias(f"c{p}") for p in P])
    seeds = tracked.where("i = 0 and j = 0").select("patch", "prio", *P)
    for p in P:
        seeds = seeds.withColumn(f"c{p}", F.explode(F.array(*[F.floor(F.col(p) / r) + k for k in (-1, 0, 1)])))
    best = keyed.groupBy(*[f"c{p}" for p in P], "other").agg(F.min("other_prio").alias("other_prio"), F.collect_list(F.struct(*[f"o_{p}" for p in P])).alias("pts"))
    met = seeds.join(best, [f"c{p}" for p in P]).where(F.col("other_prio") < F.col("prio"))
    close = F.exists("pts", lambda q: sum((F.pow(q[f"o_{p}"] - F.col(p), 2) for p in P[1:]), F.pow(q[f"o_{P[0]}"] - F.col(P[0]), 2)) < r * r)
    covered = met.where(close).select("patch").distinct()
    return nodes.join(covered, "patch", "left_anti")
