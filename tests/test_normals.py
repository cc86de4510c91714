"""Normals of chunk stores against the plain computation on the whole volume."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxtable.operators import chunks as ch
from voxtable.operators import normals

CHUNK = (8, 8, 8)
SHAPE = (30, 27, 40)


def store(spark, volumes):
    rows = []
    for name, block in volumes.items():
        full = np.zeros([-(-s // c) * c for s, c in zip(block.shape, CHUNK)], np.uint8)
        full[tuple(slice(0, s) for s in block.shape)] = block
        for k in np.ndindex(*(s // c for s, c in zip(full.shape, CHUNK))):
            data = full[tuple(slice(i * c, i * c + c) for i, c in zip(k, CHUNK))]
            if data.any():
                rows.append((name, 2, *k, data.tobytes()))
    frame = pd.DataFrame(rows, columns=["volume_id", "level", "cz", "cy", "cx", "data"])
    return ch.lay_out(spark.createDataFrame(frame, "volume_id string, level int, cz int, cy int, cx int, data binary"))


def test_tiles_agree_with_the_whole_volume(spark):
    z, y, x = np.indices(SHAPE)
    a = np.rint(200 * np.exp(-0.5 * (z - 12 - 0.3 * y + 0.1 * x) ** 2)).astype(np.uint8)
    b = np.where((x < 9) & (y < 9), a, 0).astype(np.uint8)
    got = normals.volume_normals(store(spark, {"a": a, "b": b}), SHAPE, CHUNK, rho=1.5, rho_wide=3.0, tile=16).toPandas()
    for name, block in {"a": a, "b": b}.items():
        mine = got[got.volume_id == name]
        want, coherence, ok = normals.tile_tensor((block / 255).astype(np.float32), [slice(0, s) for s in SHAPE], 1.0, 1.5, 3.0, 1e-6)
        at = tuple(mine[c].to_numpy() for c in "zyx")
        seen = np.zeros(SHAPE, bool)
        seen[at] = True
        assert len(mine) == ok.sum() and (seen == ok).mean() == 1
        assert (block[at] == 0).any()  # zeros beside the sheet have normals
        dots = abs((mine[["nz", "ny", "nx"]].to_numpy() * want[at]).sum(axis=1))
        clear = coherence[at] > 0.2
        assert (dots[clear] > 0.99).mean() > 0.999


def test_encoded_chunks(spark):
    z, y, x = np.indices(SHAPE)
    a = np.rint(200 * np.exp(-0.5 * (z - 14) ** 2)).astype(np.uint8)
    out = normals.normal_chunks(store(spark, {"a": a}), SHAPE, CHUNK, 20.0, rho=1.5, rho_wide=3.0, tile=16)
    v = ch.explode_chunks(out.withColumn("volume_id", out.channel), CHUNK).toPandas()
    assert set(v[v.volume_id == "grad_mag"].v) == {23} and set(v[v.volume_id == "nx"].v) == {128} == set(v[v.volume_id == "ny"].v)
    assert v.z.max() < SHAPE[0] and v.y.max() == SHAPE[1] - 1 and len(set(v.groupby("volume_id").size())) == 1
    assert normals.volume_normals(out.limit(0), SHAPE, CHUNK).count() == 0


def test_copies_of_a_voxel_stay_below_six(spark):
    """A store of 128-voxel tiles with the registered halo."""
    assert ((128 + 2 * normals.tensor_halo(1.0, 10.0)) / 128) ** 3 < 6


def test_tiles_are_dealt_over_tasks(spark):
    """Slabs take few bytes when exchanged; the tiles must not end up in one task for that."""
    z = np.indices(SHAPE)[0]
    a = np.rint(200 * np.exp(-0.5 * (z - 14) ** 2)).astype(np.uint8)
    out = normals.volume_normals(store(spark, {"a": a}), SHAPE, CHUNK, rho=1.5, rho_wide=3.0, tile=8)
    assert out.select(F.spark_partition_id()).distinct().count() > 8
