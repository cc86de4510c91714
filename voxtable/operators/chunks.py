"""Chunked volumes: box reads, point gathers, trilinear samples and layer renders.

``chunks`` rows hold one raw uint8 C-order buffer each. A read first narrows the chunk key (so partition and row-group
pruning apply), and bytes are only opened inside the task that owns the chunk. An absent chunk row reads as zero.
A store written by ``lay_out`` is read where it lies: requests go to its buckets, and no exchange carries a buffer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.session import scratch_path

Shape = Sequence[int]
ZYX = ("z", "y", "x")
KEYS = ("volume_id", "level", "cz", "cy", "cx")


def chunk_keys(chunk: Shape) -> list[Column]:
    return [F.floor(F.col(a) / c).cast("int").alias(f"c{a}") for a, c in zip(ZYX, chunk)]


def chunk_offset(chunk: Shape) -> Column:
    inner = [F.pmod(F.col(a), F.lit(c)) for a, c in zip(ZYX, chunk)]
    return ((inner[0] * chunk[1] + inner[1]) * chunk[2] + inner[2]).cast("int")


def to_chunks(voxels: DataFrame, chunk: Shape) -> DataFrame:
    """Voxel rows to chunk buffers. Zero voxels are not stored, so all-zero chunks vanish; edge chunks are padded."""
    size = chunk[0] * chunk[1] * chunk[2]
    keyed = voxels.where("v > 0").select("volume_id", "level", *chunk_keys(chunk), chunk_offset(chunk).alias("o"), F.col("v").cast("int").alias("v"))
    packed = keyed.groupBy("volume_id", "level", "cz", "cy", "cx").agg(F.collect_list("o").alias("o"), F.collect_list("v").alias("v"))

    @F.pandas_udf("binary")
    def fill(offsets: pd.Series, values: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for o, v in zip(offsets, values):
            block = np.zeros(size, np.uint8)
            block[o] = v
            out.append(block.tobytes())
        return pd.Series(out, dtype=object)

    return packed.select("volume_id", "level", "cz", "cy", "cx", fill("o", "v").alias("data"))


def lay_out(chunks: DataFrame, path: str | None = None, buckets: int | None = None, row_group: int = 8 << 20) -> DataFrame:
    """The chunks as a store of files by chunk key: hashed into buckets, sorted within, in small row groups with bounds of the keys.

    Joins on the five keys move their other side only. ``path`` names a shared folder; without it the store is one of the session's scratch tables.
    """
    path = path or scratch_path(chunks.sparkSession, "chunks")
    buckets = buckets or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = "chunks_" + uuid.uuid4().hex
    rows = chunks.select(*KEYS, "data").repartition(buckets, *KEYS)
    rows.write.format("parquet").option("path", path).option("parquet.block.size", row_group).bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(name)
    return chunks.sparkSession.table(name)


def _within(chunks: DataFrame, wanted: DataFrame, spans: dict[str, tuple[Column, Column]]) -> DataFrame:
    """The chunks between the least and the greatest wanted value of each key: subqueries that reach the scan, so that row groups outside are skipped.

    ``spans`` has, for a row of ``wanted``, the first and the last value of a key. One aggregate has all bounds, and no row is exploded for it.
    """
    ends = [c for k, (first, last) in spans.items() for c in (F.min(first).alias(f"first_{k}"), F.max(last).alias(f"last_{k}"))]
    bounds = wanted.agg(F.struct(*ends).alias("bounds"))
    for k in spans:
        chunks = chunks.where((F.col(k) >= bounds.scalar()[f"first_{k}"]) & (F.col(k) <= bounds.scalar()[f"last_{k}"]))
    return chunks


def _same(keys: Sequence[str]) -> dict[str, tuple[Column, Column]]:
    return {k: (F.col(k), F.col(k)) for k in keys}


def decode_files(files: DataFrame, decoder: Callable[[bytes], bytes], chunk: Shape, pattern: str) -> DataFrame:
    """Chunk rows from ``binaryFile`` rows. ``pattern`` has groups volume, level, cz, cy, cx; ``decoder`` undoes the codec.

    A buffer that doesn't have the length of a chunk fails the job: read as zeros it would be lost without a trace.
    """
    size = chunk[0] * chunk[1] * chunk[2]

    @F.pandas_udf("binary")
    def decode(content: pd.Series) -> pd.Series:
        out = []
        for c in content:
            raw = decoder(bytes(c))
            if len(raw) != size:
                raise ValueError(f"a chunk of {len(raw)} bytes, not {size}")
            out.append(raw)
        return pd.Series(out, dtype=object)

    part = [F.regexp_extract("path", pattern, k) for k in range(1, 6)]
    return files.where(F.col("path").rlike(pattern)).select(
        part[0].alias("volume_id"), part[1].cast("int").alias("level"), *[part[k].cast("int").alias(f"c{a}") for k, a in zip((2, 3, 4), ZYX)],
        decode("content").alias("data"),
    )


def explode_chunks(chunks: DataFrame, chunk: Shape, keep_zero: bool = False, lo: Shape | None = None, hi: Shape | None = None) -> DataFrame:
    """Chunk rows to voxel rows, one vectorised unpack per Arrow batch; a NULL buffer counts as zeros. Only voxels of ``[lo, hi)`` become rows."""
    cz, cy, cx = chunk

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for row in batch.itertuples(index=False):
                block = np.zeros(cz * cy * cx, np.uint8) if row.data is None else np.frombuffer(row.data, np.uint8)
                at = np.arange(block.size) if keep_zero else np.flatnonzero(block)
                z, rest = np.divmod(at, cy * cx)
                y, x = np.divmod(rest, cx)
                if lo is not None:
                    own = np.ones(at.size, bool)
                    for p, c, size, low, high in zip((z, y, x), (row.cz, row.cy, row.cx), chunk, lo, hi):
                        own &= (p + c * size >= low) & (p + c * size < high)
                    at, z, y, x = at[own], z[own], y[own], x[own]
                if at.size == 0:
                    continue
                yield pd.DataFrame(
                    {
                        "volume_id": row.volume_id, "level": row.level, "z": z + row.cz * cz, "y": y + row.cy * cy, "x": x + row.cx * cx,
                        "v": block[at].astype("int16"), "missing": row.data is None,
                    }
                )

    schema = "volume_id string, level int, z int, y int, x int, v smallint, missing boolean"
    return chunks.select("volume_id", "level", "cz", "cy", "cx", "data").mapInPandas(unpack, schema)


def chunk_range(chunks: DataFrame, lo: Shape, hi: Shape, chunk: Shape) -> DataFrame:
    """Only the chunks a half-open voxel box touches: the key predicate the optimizer cannot derive by itself."""
    out = chunks
    for a, l, h, c in zip(ZYX, lo, hi, chunk):
        out = out.where(F.col(f"c{a}").between(l // c, (h - 1) // c))
    return out


def box(chunks: DataFrame, volume_id: str, level: int, lo: Shape, hi: Shape, chunk: Shape, pad: bool = False, shape: Shape | None = None) -> DataFrame:
    """Voxels of ``[lo, hi)``. ``pad=False`` yields the stored non-zero voxels of the clipped box; ``pad=True`` every
    voxel of the box, zero outside the volume or in an absent chunk (``missing``)."""
    held = chunk_range(chunks.where((F.col("volume_id") == volume_id) & (F.col("level") == level)), lo, hi, chunk)
    if shape is not None and not pad:
        hi = [min(h, s) for h, s in zip(hi, shape)]
        lo = [max(l, 0) for l in lo]
    lo, hi = tuple(lo), tuple(hi)
    if not pad:
        return explode_chunks(held, chunk, lo=lo, hi=hi)
    grid = chunks.sparkSession.range(lo[0] // chunk[0], (hi[0] - 1) // chunk[0] + 1).select(F.col("id").cast("int").alias("cz"))
    for a, l, h, c in zip(("y", "x"), lo[1:], hi[1:], chunk[1:]):
        grid = grid.withColumn(f"c{a}", F.explode(F.sequence(F.lit(l // c), F.lit((h - 1) // c))))
    full = grid.join(held.select("cz", "cy", "cx", "data"), ["cz", "cy", "cx"], "left").withColumns(
        {"volume_id": F.lit(volume_id), "level": F.lit(level)}
    )
    return explode_chunks(full, chunk, keep_zero=True, lo=lo, hi=hi)


def box_pieces(requests: DataFrame, chunks: DataFrame, chunk: Shape, ids: Sequence[str]) -> DataFrame:
    """What each chunk holds of each requested box, cut out where the buffer lies: ids, piece, where it begins in the box (pz, py, px), its size (lz, ly,
    lx), and an error in place of the piece if the buffer has a wrong length.

    ``requests`` has ids, volume_id, level and the half-open box z0, z1, y0, y1, x0, x1. Absent chunks give no piece.
    """
    asked = requests.select(*ids, "volume_id", "level", *(f"{a}{e}" for a in ZYX for e in (0, 1)))
    spans, wanted = _same(KEYS[:2]), asked
    for a, c in zip(ZYX, chunk):
        first = F.floor(F.col(f"{a}0") / c).cast("int")
        spans[f"c{a}"] = first, F.greatest(F.floor((F.col(f"{a}1") - 1) / c).cast("int"), first)
        wanted = wanted.withColumn(f"c{a}", F.explode(F.sequence(*spans[f"c{a}"])))
    met = wanted.hint("merge").join(_within(chunks.select(*KEYS, "data"), asked, spans), list(KEYS))
    size = chunk[0] * chunk[1] * chunk[2]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            pieces, errors, at = [], [], {f"{n}{a}": [] for n in "pl" for a in ZYX}
            for r in batch.itertuples(index=False):
                bad = r.data is None or len(r.data) != size
                errors.append(f"a chunk of {0 if r.data is None else len(r.data)} bytes, not {size}" if bad else None)
                spans = []
                for a, c in zip(ZYX, chunk):
                    corner = getattr(r, f"c{a}") * c
                    lo, hi = max(getattr(r, f"{a}0"), corner), min(getattr(r, f"{a}1"), corner + c)
                    spans.append(slice(lo - corner, max(hi, lo) - corner))
                    at[f"p{a}"].append(lo - getattr(r, f"{a}0"))
                    at[f"l{a}"].append(max(hi - lo, 0))
                pieces.append(None if bad else np.frombuffer(r.data, np.uint8).reshape(chunk)[tuple(spans)].tobytes())
            yield batch[list(ids)].assign(piece=pieces, error=errors, **at)

    types = dict(requests.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in ids), "piece binary", "error string", *(f"{n}{a} int" for n in "pl" for a in ZYX)])
    return met.select(*ids, *(f"{a}{e}" for a in ZYX for e in (0, 1)), "cz", "cy", "cx", "data").mapInPandas(cut, schema)


def put_together(pieces: pd.DataFrame, size: Shape, corner: Shape | None = None):
    """The box of ``size`` from the rows of its pieces; zero where there is none. With ``corner``, the box begins there in the volume, and so do the
    pieces at (az, ay, ax); what they have beside the box is left out."""
    import numpy as np

    out = np.zeros(size, np.uint8)
    for r in pieces[pieces["piece"].notna()].itertuples(index=False):
        held = np.frombuffer(r.piece, np.uint8).reshape([int(n) for n in (r.lz, r.ly, r.lx)])
        at = [int(p) for p in (r.pz, r.py, r.px)]
        if corner is not None:
            at = [p + int(a) - c for p, a, c in zip(at, (r.az, r.ay, r.ax), corner)]
        spans = [(max(p, 0), min(p + n, s)) for p, n, s in zip(at, held.shape, size)]
        if all(lo < hi for lo, hi in spans):
            out[tuple(slice(lo, hi) for lo, hi in spans)] = held[tuple(slice(lo - p, hi - p) for (lo, hi), p in zip(spans, at))]
    return out


def footprint(points: DataFrame, chunk: Shape) -> DataFrame:
    """Distinct chunks a set of integer points touches, with the number of points in each."""
    return points.groupBy(*chunk_keys(chunk)).agg(F.count(F.lit(1)).alias("points"))


def gather(points: DataFrame, chunks: DataFrame, shape: Shape, chunk: Shape, keys: Sequence[str] = ("volume_id", "level")) -> DataFrame:
    """Adds ``v`` and ``read`` (ok / missing / outside) for integer points z, y, x.

    Requests are reduced to distinct voxels first (at most one chunk volume per chunk), so any number of points may ask
    for the same chunk; the buffer meets one short list of offsets, and values return by an equi-join.
    """
    keys = list(keys)
    inside = None
    for a, s in zip(ZYX, shape):
        here = (F.col(a) >= 0) & (F.col(a) < s)
        inside = here if inside is None else inside & here
    keyed = points.withColumn("__in", inside)
    for a, c in zip(ZYX, chunk):
        keyed = keyed.withColumn(f"c{a}", F.floor(F.col(a) / c).cast("int"))
    keyed = keyed.withColumn("__o", chunk_offset(chunk))
    ck = [*keys, "cz", "cy", "cx"]
    wanted = keyed.where("__in").groupBy(*ck).agg(F.collect_set("__o").alias("o"))

    @F.pandas_udf("array<smallint>")
    def take(data: pd.Series, offsets: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([np.frombuffer(d, np.uint8)[o].astype("int16") for d, o in zip(data, offsets)], dtype=object)

    held = _within(chunks.select(*ck, "data"), keyed.where("__in"), _same(ck))
    found = wanted.hint("merge").join(held, ck).withColumn("__v", take("data", "o"))
    values = found.select(*ck, F.explode(F.arrays_zip("o", "__v")).alias("p")).select(*ck, F.col("p.o").alias("__o"), F.col("p.__v").alias("__v"))
    out = keyed.join(values, [*ck, "__o"], "left")
    read = F.when(~F.col("__in"), "outside").when(F.col("__v").isNull(), "missing").otherwise("ok")
    value = F.when(F.col("__in"), F.coalesce("__v", F.lit(0))).otherwise(0).cast("int")
    return out.withColumn("v", value).withColumn("read", read).select(*points.columns, "v", "read")


def _up_to(top: int) -> Callable[[Column], Column]:
    return lambda k: (k >= 0) & (k <= top)


def cell_corners(points: DataFrame, chunks: DataFrame, shape: Shape, chunk: Shape, keys: Sequence[str] = ("volume_id", "level")) -> DataFrame:
    """Adds ``corners``: the eight values of the cell above integer points z, y, x, one byte each, the last axis running fastest; zero outside.

    Requests are distinct cells, of which nearly all lie in one chunk, that of the point; only the few at a border are exploded and meet each chunk that holds
    a corner, and what these give is put together by OR. Neither a point nor a buffer is copied for a corner.
    """
    keys = list(keys)
    ck = [*keys, "cz", "cy", "cx"]
    radix = [c + 1 for c in chunk]
    last = [(s - 1) // c for s, c in zip(shape, chunk)]
    cells = points.select(*keys, *ZYX)
    spans, inner, border = _same(keys), cells, F.lit(False)
    for a, c, top in zip(ZYX, chunk, last):
        spans[f"c{a}"] = F.floor(F.col(a) / c).cast("int"), F.floor((F.col(a) + 1) / c).cast("int")
        border = border | (F.pmod(F.col(a), F.lit(c)) == c - 1)
        inner = inner.where(F.col(a).between(0, (top + 1) * c - 1)).withColumn(f"c{a}", spans[f"c{a}"][0])
    outer = cells.where(border)
    for a, top in zip(ZYX, last):
        outer = outer.withColumn(f"c{a}", F.explode(F.filter(F.array_distinct(F.array(*spans[f"c{a}"])), _up_to(top))))
    keyed = inner.where(~border).unionByName(outer)
    local = [F.col(a) - F.col(f"c{a}") * c + 1 for a, c in zip(ZYX, chunk)]
    keyed = keyed.withColumn("__o", ((local[0] * radix[1] + local[1]) * radix[2] + local[2]).cast("int"))
    wanted = keyed.groupBy(*ck).agg(F.collect_set("__o").alias("o"))

    @F.pandas_udf("array<bigint>")
    def take(data: pd.Series, codes: pd.Series, cz: pd.Series, cy: pd.Series, cx: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for d, o, *at in zip(data, codes, cz, cy, cx):
            block = np.zeros([c + 2 for c in chunk], np.uint8)
            inside = tuple(slice(0, min(c, s - k * c)) for c, s, k in zip(chunk, shape, at))
            block[1:-1, 1:-1, 1:-1][inside] = np.frombuffer(d, np.uint8).reshape(chunk)[inside]
            rest, x = np.divmod(np.asarray(o), radix[2])
            z, y = np.divmod(rest, radix[1])
            packed = np.zeros(len(x), np.uint64)
            for k, (dz, dy, dx) in enumerate(np.ndindex(2, 2, 2)):
                packed |= block[z + dz, y + dy, x + dx].astype(np.uint64) << np.uint64(8 * k)
            out.append(packed.view(np.int64))
        return pd.Series(out, dtype=object)

    held = _within(chunks.select(*ck, "data"), cells, spans)
    found = wanted.hint("merge").join(held, ck).withColumn("__v", take("data", "o", "cz", "cy", "cx"))
    code = F.col("p.o")
    base = (F.floor(code / (radix[1] * radix[2])), F.pmod(F.floor(code / radix[2]), F.lit(radix[1])), F.pmod(code, F.lit(radix[2])))
    read = found.select(*ck, F.explode(F.arrays_zip("o", "__v")).alias("p"))
    read = read.select(*keys, *((b + F.col(f"c{a}") * c - 1).cast("int").alias(a) for a, b, c in zip(ZYX, base, chunk)), F.col("p.__v").alias("__v"))
    read = read.groupBy(*keys, *ZYX).agg(F.bit_or("__v").alias("corners"))
    return points.join(read.hint("merge"), [*keys, *ZYX], "left").select(*points.columns, F.coalesce("corners", F.lit(0).cast("bigint")).alias("corners"))


def trilinear(
    points: DataFrame, chunks: DataFrame, shape: Shape, chunk: Shape, point_keys: Sequence[str], keys: Sequence[str] = ("volume_id", "level")
) -> DataFrame:
    """Eight-corner weighted value at real points z, y, x; ``point_keys`` identify a point. Zero outside."""
    cells = points.select(
        *dict.fromkeys([*point_keys, *keys]), *(F.floor(F.col(a)).cast("int").alias(a) for a in ZYX), *((F.col(a) - F.floor(F.col(a))).alias(f"__t{a}") for a in ZYX)
    )
    value = F.lit(0.0)
    for k in range(8):
        w = F.lit(1.0)
        for a, d in zip(ZYX, (k >> 2, k >> 1 & 1, k & 1)):
            w = w * (F.col(f"__t{a}") if d else 1 - F.col(f"__t{a}"))
        value = value + w * F.shiftrightunsigned("corners", 8 * k).bitwiseAND(F.lit(255))
    return cell_corners(cells, chunks, shape, chunk, keys).select(*point_keys, value.alias("value"))


def render_layers(
    surface: DataFrame, chunks: DataFrame, shape: Shape, chunk: Shape, half: int, point_keys: Sequence[str], keys: Sequence[str] = ("volume_id", "level")
) -> DataFrame:
    """Samples at ``p + d * n`` for d in -half..half; ``surface`` has z, y, x, nz, ny, nx. Layer 0 is the lowest d."""
    steps = surface.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(2 * half))))
    for a in ZYX:
        steps = steps.withColumn(a, F.col(a) + (F.col("layer") - half) * F.col(f"n{a}"))
    return trilinear(steps, chunks, shape, chunk, [*point_keys, "layer"], keys)


def level_for(levels: DataFrame, by: Sequence[str], scale: str, grid_um: float | str) -> DataFrame:
    """Last pyramid level whose scale is at most 1.05 grid steps, else level 0."""
    grid = F.col(grid_um) if isinstance(grid_um, str) else F.lit(grid_um)
    return levels.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col(scale) <= grid * 1.05, F.col("level"))), F.lit(0)).alias("level"))


def surface_coverage(stack: DataFrame, keys: Sequence[str], factor_num: int, factor_den: int, cells: DataFrame) -> DataFrame:
    """Looks each mesh cell up in the any-layer coverage of a coarse stack at ``cell * num // den``, clipped to its extent."""
    cover = stack.groupBy(*keys, "y", "x").agg(F.bool_or(F.col("v") > 0).alias("covered"))
    extent = cover.groupBy(*keys).agg(F.max("y").alias("__ym"), F.max("x").alias("__xm"))
    at = cells.join(extent, list(keys)) if keys else cells.withColumns({"__ym": extent.select("__ym").scalar(), "__xm": extent.select("__xm").scalar()})
    at = at.withColumn("y", F.least(F.floor(F.col("i") * factor_num / factor_den).cast("int"), "__ym")).withColumn(
        "x", F.least(F.floor(F.col("j") * factor_num / factor_den).cast("int"), "__xm")
    )
    return at.join(cover, [*keys, "y", "x"], "left").select(*cells.columns, F.coalesce("covered", F.lit(False)).alias("covered"))
