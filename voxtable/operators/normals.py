"""Surface normals of chunk stores: structure tensors of tiles, put together from slabs that each chunk cuts for the tiles around it.

A chunk is opened once, where it lies, and gives every tile whose halo reaches it the part that it needs, as bytes; slabs of zeros are not sent. With
tiles of 128 and a halo of 45 a voxel goes to five tiles at the mean.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.operators.chunks import ZYX
from voxtable.operators.stats import gaussian_taps

SLAB = "volume_id string, level int, tz int, ty int, tx int, oz int, oy int, ox int, nz int, ny int, nx int, data binary"
TILE = ("volume_id", "level", "tz", "ty", "tx")
#: Tasks for the tiles of a shape; with more tiles a task has several.
MOST_TASKS = 2048
Shape = Sequence[int]


def halo_slabs(chunks: DataFrame, shape: Shape, chunk: Shape, tile: int, halo: int) -> DataFrame:
    """What each tile and its halo hold of each chunk: tile numbers, where the slab begins in the volume, its size and its bytes."""
    top = [-(-s // tile) - 1 for s in shape]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        names = [f.split()[0] for f in SLAB.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                block = np.frombuffer(r.data, np.uint8).reshape(chunk)
                lo = [k * c for k, c in zip((r.cz, r.cy, r.cx), chunk)]
                hi = [min(a + c, s) for a, c, s in zip(lo, chunk, shape)]
                reach = [range(max((a - halo) // tile, 0), min((b - 1 + halo) // tile, t) + 1) for a, b, t in zip(lo, hi, top)]
                for at in np.ndindex(*(len(q) for q in reach)):
                    t = [q[k] for q, k in zip(reach, at)]
                    start = [max(a, k * tile - halo) for a, k in zip(lo, t)]
                    stop = [min(b, (k + 1) * tile + halo) for b, k in zip(hi, t)]
                    slab = block[tuple(slice(p - a, q - a) for p, q, a in zip(start, stop, lo))]
                    if slab.any():
                        rows.append((r.volume_id, r.level, *t, *start, *slab.shape, slab.tobytes()))
            yield pd.DataFrame(rows, columns=names)

    return chunks.select("volume_id", "level", "cz", "cy", "cx", "data").mapInPandas(cut, SLAB)


def smoothed(block, taps, spans: Sequence[slice]):
    """Convolution along all axes, edges mirrored with the edge itself; only the cells within ``spans`` are worked out, axis by axis."""
    import numpy as np

    half = len(taps) // 2
    for axis, span in enumerate(spans):
        n = block.shape[axis]
        # the mirror may need more than one fold
        wide = np.pad(block, [(half, half) if k == axis else (0, 0) for k in range(block.ndim)], mode="symmetric")
        start, stop, _ = span.indices(n)
        out = None
        for k, w in enumerate(taps):
            part = wide[tuple(slice(start + k, stop + k) if a == axis else slice(None) for a in range(block.ndim))]
            out = part * np.float32(w) if out is None else np.add(out, part * np.float32(w), out=out)
        block = out
    return block


def tile_tensor(block, core: Sequence[slice], sigma: float, rho: float, rho_wide: float, trace_min: float):
    """Top eigenvectors (nz, ny, nx), coherence and support of the core of a block in [0, 1]. The wide kernel serves where the narrow one has no energy."""
    import numpy as np

    whole = [slice(None)] * 3
    smooth = smoothed(block, gaussian_taps(sigma), whole)
    slopes = [np.gradient(smooth, axis=k) if smooth.shape[k] > 1 else np.zeros_like(smooth) for k in range(3)]
    size = [len(range(*s.indices(n))) for s, n in zip(core, block.shape)]
    normal, coherence, ok = np.zeros([*size, 3]), np.zeros(size), np.zeros(size, bool)
    for taps in (gaussian_taps(rho), gaussian_taps(rho_wide)):
        parts = {(a, b): smoothed(slopes[a] * slopes[b], taps, core) for a in range(3) for b in range(a, 3)}
        new = (parts[0, 0] + parts[1, 1] + parts[2, 2] > trace_min) & ~ok
        tensor = np.empty((int(new.sum()), 3, 3))
        for (a, b), p in parts.items():
            tensor[:, a, b] = tensor[:, b, a] = p[new]
        values, vectors = np.linalg.eigh(tensor)
        normal[new] = vectors[:, :, 2]
        coherence[new] = (values[:, 2] - values[:, 1]) / (values[:, 2] + values[:, 1] + 1e-9)
        ok |= new
        if ok.all():
            break
    return normal, coherence, ok


def map_volume_tiles(chunks: DataFrame, shape: Shape, chunk: Shape, tile: int, halo: int, work: Callable, schema: str) -> DataFrame:
    """``work(key, origin, block, core)`` on every tile that has data within its halo: the block in [0, 1] is cut at the volume's shape, ``core`` are the
    tile's own spans in it and ``origin`` the volume's place of the core. It returns a pandas frame of ``schema``."""
    top = [-(-s // tile) - 1 for s in shape]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        t = key[2:]
        lo = [max(k * tile - halo, 0) for k in t]
        hi = [min((k + 1) * tile + halo, s) for k, s in zip(t, shape)]
        block = np.zeros([b - a for a, b in zip(lo, hi)], np.float32)
        for r in pdf.itertuples(index=False):
            at = tuple(slice(o - a, o - a + n) for o, a, n in zip((r.oz, r.oy, r.ox), lo, (r.nz, r.ny, r.nx)))
            block[at] = np.frombuffer(r.data, np.uint8).reshape(r.nz, r.ny, r.nx)
        block /= np.float32(255)
        origin = [k * tile for k in t]
        core = [slice(o - a, min(o + tile, s) - a) for o, a, s in zip(origin, lo, shape)]
        return work(key, origin, block, core)

    # slabs are small when compressed and costly to work on, so the number of tasks follows the tiles, not the bytes exchanged
    tiles = math.prod(t + 1 for t in top)
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tiles, MOST_TASKS))
    slabs = halo_slabs(chunks, shape, chunk, tile, halo).repartition(tasks, *TILE)
    return slabs.groupBy(*TILE).applyInPandas(run, schema)


def tensor_halo(sigma: float, rho_wide: float) -> int:
    return len(gaussian_taps(sigma)) // 2 + 1 + len(gaussian_taps(rho_wide)) // 2


def volume_normals(
    chunks: DataFrame, shape: Shape, chunk: Shape, sigma: float = 1.0, rho: float = 3.0, rho_wide: float = 10.0, trace_min: float = 1e-6, tile: int = 128
) -> DataFrame:
    """A row per supported voxel inside the volume's shape, stored or zero: volume_id, level, z, y, x, nz, ny, nx, coherence."""

    def work(key, origin, block, core):
        import numpy as np

        normal, coherence, ok = tile_tensor(block, core, sigma, rho, rho_wide, trace_min)
        at = np.nonzero(ok)
        out = {"volume_id": key[0], "level": key[1]} | {a: (p + o).astype("int32") for a, p, o in zip(ZYX, at, origin)}
        return pd.DataFrame(out | {f"n{a}": normal[..., k][ok] for k, a in enumerate(ZYX)} | {"coherence": coherence[ok]})

    schema = "volume_id string, level int, z int, y int, x int, nz double, ny double, nx double, coherence double"
    return map_volume_tiles(chunks, shape, chunk, tile, tensor_halo(sigma, rho_wide), work, schema)


def normal_chunks(
    chunks: DataFrame, shape: Shape, chunk: Shape, spacing: float, k: float = 0.464, sigma: float = 1.0, rho: float = 3.0, rho_wide: float = 10.0, trace_min: float = 1e-6, tile: int = 128,
    channels: Sequence[str] = ("nx", "ny", "grad_mag"),
) -> DataFrame:
    """The encoded normals as chunk rows of three channels: volume_id, level, channel, cz, cy, cx, data.

    nx and ny are ``round(127 n + 128)`` of the normal turned to nz >= 0, grad_mag is ``clip(round(1000 k / spacing), 1, 255)``; all are 0 without
    support. Chunks of zeros are not written, those at the end of the volume are padded. ``tile`` must be a multiple of the chunk.
    """
    if any(tile % c for c in chunk):
        raise ValueError("a tile must consist of whole chunks")
    level = int(min(max(round(1000 * k / spacing), 1), 255))

    def work(key, origin, block, core):
        import numpy as np

        normal, _, ok = tile_tensor(block, core, sigma, rho, rho_wide, trace_min)
        turned = np.where(normal[..., :1] < 0, -normal, normal)
        coded = [np.where(ok, np.clip(np.round(turned[..., a] * 127 + 128), 0, 255), 0).astype(np.uint8) for a in (2, 1)]
        rows = []
        for name, plane in zip(channels, [*coded, np.where(ok, level, 0).astype(np.uint8)]):
            full = np.zeros([-(-n // c) * c for n, c in zip(plane.shape, chunk)], np.uint8)
            full[tuple(slice(0, n) for n in plane.shape)] = plane
            for at in np.ndindex(*(n // c for n, c in zip(full.shape, chunk))):
                data = full[tuple(slice(i * c, i * c + c) for i, c in zip(at, chunk))]
                if data.any():
                    rows.append((key[0], key[1], name, *(o // c + i for o, c, i in zip(origin, chunk, at)), data.tobytes()))
        return pd.DataFrame(rows, columns=["volume_id", "level", "channel", "cz", "cy", "cx", "data"])

    schema = "volume_id string, level int, channel string, cz int, cy int, cx int, data binary"
    return map_volume_tiles(chunks, shape, chunk, tile, tensor_halo(sigma, rho_wide), work, schema)
