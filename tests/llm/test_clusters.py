"""Clustering against plain rounds in integers, and the bound that loosens the lower bounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from voxtable.llm import drift_kmeans


def plain(rows, dim, scale, k, rounds, seed=3):
    """Rows as the query gives them, by rounds that compute every distance."""
    rows = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)[:k]
    centroids = [x for _, x in starts]
    for number in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in rows]
        if number < rounds:
            for j in range(len(centroids)):
                mine = [x for (_, x), (_, c) in zip(rows, near) if c == j]
                if mine:
                    centroids[j] = [sum(v) // len(mine) for v in zip(*mine)]
    by = [sum(d for d, c in near if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, by[c], sum(by), digest[c]) for (i, _), (d, c) in zip(rows, near)), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (5, 6))
    rows = [(k, [float(np.float32(v)) for v in centres[k % 5] + rng.normal(0, 0.3, 6)]) for k in range(500)]
    hot = [float(np.float32(v)) for v in centres[0]]
    rows += [(1000 + k, hot) for k in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (2000, None), (2001, []), (2002, rows[3][1][:5]), (2003, [*rows[3][1], 0.0])]
    rows += [(2004, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2005, [math.nan, *[0.0] * 5]), (2006, [math.inf, *[0.0] * 5]), (2007, [-math.inf, *[0.0] * 5])]
    return rows


@pytest.mark.parametrize("k, block", [(8, 2048), (3, 17), (1, 100)])
def test_rounds_are_the_plain_ones(spark, vectors, k, block):
    df = spark.createDataFrame([(*r, 1, 2) for r in vectors], "vec_id bigint, embedding array<float>, cluster int, i int").repartition(5)
    found = drift_kmeans.clusters(df, dim=6, k=k, rounds=6, block_rows=block)
    got = sorted((tuple(r) for r in found.rows.collect()), key=repr)
    assert got == plain(vectors, 6, 1024, k, 6)
    if k == 3:  # clear clusters: bounds decide for most vectors once the centroids hardly move
        assert found.scanned[0] == len(got) and found.scanned[-1] < len(got) / 2


def test_ties_copies_and_fewer_vectors_than_clusters(spark):
    rows = [(k, [float(k % 2), 0.0]) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = drift_kmeans.clusters(df, dim=2, k=8, rounds=3).rows.collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, 2, 1024, 8, 3)
    assert drift_kmeans.clusters(df.limit(0), dim=2).rows.count() == 0
    assert drift_kmeans.clusters(df, dim=3).rows.columns == drift_kmeans.clusters(df, dim=2).rows.columns


def test_a_component_too_large_is_named(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        drift_kmeans.clusters(df, dim=2, k=1, rounds=1).rows.collect()


def test_loosening_bounds_the_approach_and_is_less_than_the_drift():
    rng = np.random.default_rng(0)
    for dim in (2, 5):
        old = rng.integers(-60, 60, (7, dim))
        new = old + rng.integers(-12, 12, (7, dim))
        new[2] = old[2]
        radius = rng.uniform(0, 40, 7)
        bound = drift_kmeans.loosening(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        for i in range(7):
            v = rng.normal(size=(20_000, dim))
            x = old[i] + v / np.linalg.norm(v, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (20_000, 1)) ** (1 / dim)
            for j in range(7):
                nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert nearer.max() <= bound[i, j] <= drift[j] * (1 + 1e-6) + 1e-5
        off = ~np.eye(7, dtype=bool)
        assert (bound[off] < 0.9 * np.broadcast_to(drift, (7, 7))[off]).mean() > 0.3
