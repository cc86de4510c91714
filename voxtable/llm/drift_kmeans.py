"""Exact k-means on integer vectors with bounds that are loosened by planar geometry instead of by the whole drift of the centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import free
from voxtable.session import scratch_path

#: Components beyond this would let a squared distance leave 64 bits.
LARGEST = 1 << 27
#: What the bounds give away so that rounding in doubles never decides: a share of the value, and an absolute part (distances are roots of integers).
SHARE, LEAST = 1e-9, 1e-6


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[i, j]: by how much the distance to centroid j can shrink at most, for any point of the sphere around the old centroid i with its radius.

    In the plane of the sphere's centre and of the two places of j, the points that come nearer by s lie on a branch of the hyperbola with these two
    as foci, and within the angle arccos(s / drift) of its asymptote, seen from the middle of the two. So the least angle under which the middle sees a
    point of the sphere bounds s by drift * cos(angle); it is the whole drift only if the sphere reaches the axis beyond the middle.
    """
    old, new = old.astype(float), new.astype(float)
    step = new - old
    drift = np.sqrt((step**2).sum(axis=1))
    away = old[:, None, :] - (old + step / 2)[None, :, :]
    far = np.sqrt((away**2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = np.clip(np.nan_to_num((away * step[None]).sum(axis=2) / (far * drift[None])), -1, 1)
        sin_r = np.nan_to_num(radius[:, None] / far, nan=1.0, posinf=1.0)
    out = np.broadcast_to(drift, cos.shape).copy()
    apart = sin_r < 1  # else the sphere holds the middle
    angle = np.arccos(cos) - np.arcsin(np.where(apart, sin_r, 0.0))
    out[apart] = (drift[None] * np.where(angle > 0, np.maximum(np.cos(np.minimum(angle, np.pi / 2)), 0), 1.0))[apart]
    return out * (1 + SHARE) + LEAST


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((vectors - centroid) ** 2).sum(axis=1)


class Move:
    """What a round needs of the centroids: their new places, and what the change does to the bounds of the vectors of each cluster."""

    def __init__(self, old: np.ndarray | None, new: np.ndarray, radius: np.ndarray | None) -> None:
        self.new, k = new, len(new)
        self.up = self.down = None
        if old is not None:
            drift = np.sqrt(((new - old).astype(float) ** 2).sum(axis=1))
            loose = loosening(old, new, radius)
            np.fill_diagonal(loose, 0)
            self.up, self.down = drift * (1 + SHARE) + LEAST, loose.max(axis=1, initial=0)
        gaps = np.sqrt(((new[:, None] - new[None]).astype(float) ** 2).sum(axis=2)) + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.half = gaps.min(axis=1, initial=np.inf) / 2 * (1 - SHARE) - LEAST

    def scan(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid of each vector (ties: the smaller number), and bounds of the distances to it and to all others."""
        best = squared(vectors, self.new[0])
        second = np.full(len(vectors), np.iinfo(np.int64).max)
        cluster = np.zeros(len(vectors), np.int32)
        for j in range(1, len(self.new)):
            d = squared(vectors, self.new[j])
            less = d < best
            second = np.where(less, best, np.minimum(second, d))
            cluster[less] = j
            best = np.minimum(best, d)
        return cluster, np.sqrt(best.astype(float)) * (1 + SHARE) + LEAST, np.sqrt(second.astype(float)) * (1 - SHARE) - LEAST

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings cluster and bounds of a block up to the new centroids, in place; the number of vectors that were scanned."""
        upper += self.up[cluster]
        lower -= self.down[cluster]
        safe = np.maximum(lower, self.half[cluster])
        doubtful = np.flatnonzero(upper >= safe)
        if len(doubtful):
            exact = np.sqrt(((vectors[doubtful] - self.new[cluster[doubtful]]) ** 2).sum(axis=1).astype(float)) * (1 + SHARE) + LEAST
            upper[doubtful] = exact
            doubtful = doubtful[exact >= safe[doubtful]]
        if len(doubtful):
            cluster[doubtful], upper[doubtful], lower[doubtful] = self.scan(vectors[doubtful])
        return len(doubtful)


def _floats(column: Column) -> Column:
    return F.transform(column, lambda x: x.cast("double"))


def _packed(dim: int, scale: int, rows: int):
    """Blocks of at most ``rows`` vectors: block, ids, and the integers of all components as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                block = part.column(0)[0].as_py() << 33 if block is None else block + 1
                values = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                whole = np.floor(values * scale)
                if np.abs(whole).max(initial=0) > LARGEST:
                    raise ValueError(f"a component beyond {LARGEST} / {scale} does not fit 64-bit squared distances")
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int64()), "ids": pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), "data": pa.array([whole.astype("<i4").tobytes()], pa.binary()),
                })

    return pack


STATE = "block bigint, bounds binary, sums array<struct<cluster:int,n:bigint,radius:double,sums:array<bigint>>>, scanned bigint"


def _round(move: Move, dim: int):
    """A round over blocks: new clusters and bounds, and by cluster what the block adds to its sums (from the second round on, the change)."""
    k = len(move.new)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"block": batch.column("block").to_pylist(), "bounds": [], "sums": [], "scanned": []}
            for data, state in zip(batch.column("data").to_pylist(), batch.column("bounds").to_pylist() if "bounds" in batch.schema.names else [None] * batch.num_rows):
                vectors = np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.int64)
                if state is None:
                    cluster, upper, lower = move.scan(vectors)
                    moved, before, scanned = np.arange(len(vectors)), None, len(vectors)
                else:
                    cluster, upper, lower = unpacked(state)
                    before = cluster.copy()
                    scanned = move.assign(vectors, cluster, upper, lower)
                    moved = np.flatnonzero(cluster != before)
                counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
                for weight, of in ((1, cluster), (-1, before)):
                    if of is not None:
                        np.add.at(counts, of[moved], weight)
                        np.add.at(sums, of[moved], weight * vectors[moved])
                radius = np.zeros(k)
                np.maximum.at(radius, cluster, upper)
                out["bounds"].append(cluster.astype("<i4").tobytes() + upper.tobytes() + lower.tobytes())
                out["sums"].append([{"cluster": j, "n": int(counts[j]), "radius": float(radius[j]), "sums": sums[j].tolist()} for j in range(k) if radius[j] > 0 or counts[j] or sums[j].any()])
                out["scanned"].append(scanned)
            sums_type = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("radius", pa.float64()), ("sums", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(out["block"], pa.int64()), "bounds": pa.array(out["bounds"], pa.binary()), "sums": pa.array(out["sums"], sums_type), "scanned": pa.array(out["scanned"], pa.int64()),
            })

    return step


def unpacked(state: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(state) // 20
    return np.frombuffer(state, "<i4", n).copy(), np.frombuffer(state, "<f8", n, 4 * n).copy(), np.frombuffer(state, "<f8", n, 12 * n).copy()


def _final(centroids: np.ndarray, dim: int):
    """vec_id, cluster and squared distance of each vector of a block."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, state in zip(*(batch.column(c).to_pylist() for c in ("ids", "data", "bounds"))):
                vectors = np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.int64)
                cluster = unpacked(state)[0]
                distance = ((vectors - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return told


class Clustering:
    """``rows``: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. ``centroids``: integers. ``scanned``: vectors scanned in each round."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, scanned: list[int]) -> None:
        self.rows, self.centroids, self.scanned = rows, centroids, scanned


def clusters(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3, block_rows: int = 2048
) -> Clustering:
    """Lloyd's rounds from the ``k`` vectors with the smallest sha256 of "seed:vec_id", with the results of plain rounds.

    Only vectors with exactly ``dim`` components count, none null or not finite; component x is the integer floor(scale * x). Ties go to the
    smaller cluster number, a cluster without vectors keeps its centroid. Vectors with a null id are clustered as all others and start no cluster; of
    starting vectors with the same id the smaller components go first. With fewer than ``k`` vectors there are fewer clusters, with none there are no
    rows. Other columns are not read. A component beyond 2**27 / scale ends the job with ValueError: squared distances have 64 bits.

    Vectors lie in blocks in a table of buckets; a round writes a table with the clusters and bounds alone, by the same buckets, so that no round moves
    a vector between tasks. The driver holds k centroids.
    """
    spark = vectors.sparkSession
    i, x = free(vectors, "i", "x")
    fits = (F.size(x) == dim) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = vectors.select(F.col(vec_id).cast("bigint").alias(i), _floats(F.col(embedding)).alias(x)).where(fits)
    whole = F.transform(x, lambda v: F.floor(v * scale))
    starts = good.where(F.col(i).isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(i).cast("string")), 256).alias("h"), whole.alias("c")).orderBy("h", "c").limit(k).collect()
    if not starts:
        empty = spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        return Clustering(empty, np.zeros((0, dim), np.int64), [])
    new = np.array([s.c for s in starts], np.int64)
    path = scratch_path(spark, "blocks")
    run = path.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = good.select(F.spark_partition_id().cast("bigint").alias("part"), i, x).mapInArrow(_packed(dim, scale, block_rows), "block bigint, ids array<bigint>, data binary")
    blocks.repartition(buckets, "block").write.format("parquet").option("path", path).bucketBy(buckets, "block").saveAsTable(f"blocks_{run}")
    data = spark.table(f"blocks_{run}")

    def written(rows: DataFrame, number: int) -> DataFrame:
        rows.write.format("parquet").option("path", scratch_path(spark, "bounds")).bucketBy(buckets, "block").saveAsTable(f"bounds_{run}_{number}")
        return spark.table(f"bounds_{run}_{number}")

    def joined(state: DataFrame, *columns: str) -> DataFrame:
        return data.join(state.select("block", "bounds").hint("merge"), "block").select("block", *columns)

    old = radius = state = None
    counts, sums, scanned = np.zeros(len(new), np.int64), np.zeros((len(new), dim), np.int64), []
    for number in range(rounds + 1):
        source = data.select("block", "data") if state is None else joined(state, "data", "bounds")
        state = written(source.mapInArrow(_round(Move(old, new, radius), dim), STATE), number)
        radius = np.zeros(len(new))
        each = state.select("scanned", F.explode_outer("sums").alias("s"))
        parts = each.select("s.cluster", "s.n", "s.radius", F.posexplode("s.sums").alias("at", "sum"))
        # k times dim rows
        for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max("radius").alias("radius")).collect():
            sums[r.cluster, r.at] += r["sum"]
            radius[r.cluster] = r.radius
            if r.at == 0:
                counts[r.cluster] += r.n
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if number < rounds:
            old, new = new, np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], new)
    found = joined(state, "ids", "data", "bounds").mapInArrow(_final(new, dim), "vec_id bigint, cluster int, distance bigint")
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in new.tolist()]
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    rows = found.select(
        "vec_id", "cluster", "distance", pick([inertia.get(j, 0) for j in range(len(new))]).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), pick(digests).alias("centroid_sha256"),
    )
    return Clustering(rows, new, scanned)
