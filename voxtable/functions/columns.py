"""Scalar, vector, array, bit and hash expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(a: ColumnLike, b: int) -> Column:
    """Floor division, also for negative operands."""
    return F.floor(col(a) / F.lit(b)).cast("int")


def ceil_div(a: ColumnLike, b: ColumnLike) -> Column:
    return F.ceil(col(a) / col(b)).cast("int")


def clip(a: ColumnLike, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(a), F.lit(lo)), F.lit(hi))


def null_if_nan(a: ColumnLike) -> Column:
    return F.when(~F.isnan(col(a)), col(a))


def seeded_order(seed: int, *keys: ColumnLike) -> Column:
    """Order that replaces a seeded permutation: md5 of the seed and the key, repeatable in any SQL engine."""
    return F.md5(F.concat_ws(",", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def dot(a: Sequence[ColumnLike], b: Sequence[ColumnLike]) -> Column:
    total = col(a[0]) * col(b[0])
    for p, q in zip(a[1:], b[1:]):
        total = total + col(p) * col(q)
    return total


def norm(a: Sequence[ColumnLike]) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Sequence[ColumnLike], floor: float = 1e-9) -> list[Column]:
    n = F.greatest(norm(a), F.lit(floor))
    return [col(p) / n for p in a]


def cross(a: Sequence[ColumnLike], b: Sequence[ColumnLike]) -> list[Column]:
    a0, a1, a2 = (col(p) for p in a)
    b0, b1, b2 = (col(p) for p in b)
    return [a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0]


def stretch_u8(score: ColumnLike, valid: ColumnLike, lo: float = 0.25, width: float = 0.5) -> Column:
    """Contrast stretch to 0..255 with truncation; invalid pixels are 0."""
    return F.when(col(valid), (clip((col(score) - lo) / width, 0.0, 1.0) * 255).cast("int")).otherwise(0)


def encode_normal(nz: ColumnLike, component: ColumnLike, ok: ColumnLike) -> Column:
    """Unit-normal component as 0..255, flipped so that nz >= 0 and rounded half to even; 0 without support."""
    flip = F.when(col(nz) < 0, -1.0).otherwise(1.0)
    return F.when(col(ok), clip(F.rint(col(component) * flip * 127 + 128), 0.0, 255.0).cast("int")).otherwise(0)


def label_class(share: ColumnLike, full: ColumnLike, near_ink: ColumnLike, pos_min: float = 0.5, neg_max: float = 0.05) -> Column:
    """pos / neg / NULL: only fully valid blocks count, negatives must lie near ink."""
    return F.when(col(full) & (col(share) >= pos_min), F.lit("pos")).when(
        col(full) & (col(share) < neg_max) & col(near_ink), F.lit("neg")
    )


def teacher_class(value: ColumnLike, on: int = 160, off: int = 50) -> Column:
    """1 at or above ``on``, 0 at or below ``off``, -1 (ignored) between."""
    return F.when(col(value) >= on, 1).when(col(value) <= off, 0).otherwise(-1)


def signed4(value: ColumnLike) -> Column:
    """Signed four-decimal text as C's ``%+.4f`` writes it, ``n/a`` for NULL: the double's exact value is rounded, a true half to even.

    Java's formatter rounds the shortest decimal text of the double instead. The fraction times 10^4 is taken with its
    rounding error (Dekker's product), which decides at an apparent half.
    """
    x = col(value)
    java = F.format_string("%+.4f", x)
    # from 2^53 on there is no fraction; such values, infinities and NaN stay with the formatter
    odd = F.isnan(x) | (F.abs(x) >= 2.0**53)
    size = F.when(odd, 0.0).otherwise(F.abs(x))
    whole = F.floor(size)
    f = size - whole.cast("double")
    p = f * 1e4
    top = f * 134217729.0 - (f * 134217729.0 - f)
    error = (top * 1e4 - p) + (f - top) * 1e4
    n = F.floor(p)
    rest = p - n.cast("double")
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (n % 2 == 1))))
    digits = n + F.when(up, 1).otherwise(0)
    text = F.concat(F.substring(java, 1, 1), (whole + F.when(digits == 10000, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((digits % 10000).cast("string"), 4, "0"))
    return F.when(x.isNull(), F.lit("n/a")).when(odd, java).otherwise(text)


def exact_sum(value: ColumnLike) -> Column:
    """Sum of a DOUBLE column that does not depend on the order of its rows: the decimal values are added exactly and rounded once.

    Groups with NaN, infinities or values of 10^20 and more keep the floating-point sum. Values are read to 18 decimals.
    """
    x = col(value)
    d = x.try_cast("decimal(38,18)")
    return F.coalesce(F.when(F.count(x) == F.count(d), F.try_sum(d).cast("double")), F.sum(x))


def exact_avg(value: ColumnLike) -> Column:
    """Mean by ``exact_sum``: equal means are equal doubles, whatever the layout of the table."""
    return exact_sum(value) / F.nullif(F.count(col(value)), F.lit(0))


def unpack_bits(packed: ColumnLike) -> Column:
    """Array of 0/1 from a BINARY column, most significant bit of each byte first."""
    hexed = F.hex(col(packed))
    nibbles = F.transform(F.sequence(F.lit(1), F.length(hexed)), lambda k: F.conv(F.substring(hexed, k, F.lit(1)), 16, 10).cast("int"))
    return F.flatten(F.transform(nibbles, lambda n: F.array(*[F.shiftright(n, s).bitwiseAND(1) for s in (3, 2, 1, 0)])))


def pack_bits(bits: ColumnLike) -> Column:
    """BINARY from an array of 0/1, zero-padded to whole bytes, most significant bit first."""
    b = col(bits)
    padded = F.concat(b, F.array_repeat(F.lit(0), ((F.lit(8) - F.size(b) % 8) % 8).cast("int")))
    nib = F.transform(
        F.sequence(F.lit(0), (F.size(padded) / 4 - 1).cast("int")),
        lambda k: F.hex(F.aggregate(F.slice(padded, k * 4 + 1, F.lit(4)), F.lit(0), lambda s, t: s * 2 + t).cast("long")),
    )
    return F.unhex(F.array_join(nib, ""))
