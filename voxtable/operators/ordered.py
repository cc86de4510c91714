"""Order-dependent aggregates that stay parallel when one group holds most of the rows.

A window over a hot key is one task. Here the order is first cut into value ranges by a few split points, the same for
all groups, so a group of any size is spread over all ranges. Each (group, range) is summed once with map-side combine,
the range totals (at most groups x ranges rows) give every range its starting offset, and the ordinary window runs only
inside a (group, range) pair. There is one route for inputs of every size, and NULL grouping keys form a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.session import stored

SAMPLE_ROWS = 8192
MAX_RANGES = 256


def _ranges(df: DataFrame, ranges: int | None) -> int:
    if ranges:
        return ranges
    return max(8, min(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def split_points(df: DataFrame, order: Sequence[str], unique: Sequence[str], ranges: int) -> list:
    """At most ``ranges - 1`` ordered split keys from a hash sample of ``SAMPLE_ROWS`` rows (only the splits reach the driver).

    ``unique`` names the columns that make a row distinct, so that no repeated key can fill the sample.
    """
    sample = df.select(F.struct(*order).alias("k"), F.xxhash64(*unique).alias("h")).orderBy("h").limit(SAMPLE_ROWS)
    found = sample.agg(F.array_sort(F.collect_list("k")).alias("k")).select(
        F.transform(F.sequence(F.lit(1), F.lit(max(ranges - 1, 1))), lambda i: F.get(F.col("k"), F.floor(i * F.size("k") / ranges).cast("int"))).alias("k")
    ).first()
    distinct: list = []
    for k in found["k"] or []:
        if k is not None and (not distinct or distinct[-1] != k):
            distinct.append(k)
    return distinct


def joined_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join on same-named keys in which NULL meets NULL; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__on_{k}"))
    return left.join(other, match).drop(*[f"__on_{k}" for k in keys])


def range_id(order: Sequence[str], splits: list, schema) -> Column:
    """Number of split keys at or below the row's key, as a balanced tree of comparisons (log2 per row)."""
    key = F.struct(*order)

    def literal(row) -> Column:
        return F.struct(*[F.lit(v).cast(schema[c].dataType).alias(c) for c, v in zip(order, row)])

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < literal(splits[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(splits))


def in_order(df: DataFrame, by: Sequence[str], place: Sequence[str], tasks: int) -> DataFrame:
    """The same rows, those of a group together in one task and in the order of ``place``.

    An aggregate by the same keys that follows adds the doubles of a group one by one in that order, as an engine does that reads the table on
    one thread. Such a sum is a chain, so a hot group takes one task, which sorts its rows on disk and holds a total alone.
    """
    return df.repartition(tasks, *by).sortWithinPartitions(*by, *place)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    unique: Sequence[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Adds ``<value>_before`` (sum over the rows of the group that come earlier) and ``<value>_total`` for each value.

    ``order`` must be a total order within the group and ascending.
    """
    by, order, values = list(by), list(order), list(values)
    splits = split_points(df, order, unique or by + order, _ranges(df, ranges))
    tagged = df.withColumn("__range", range_id(order, splits, df.schema))
    sums = tagged.groupBy(*by, "__range").agg(*[F.sum(v).alias(f"__{v}_sum") for v in values])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sums.select(
        *by,
        "__range",
        *[F.coalesce(F.sum(f"__{v}_sum").over(earlier), F.lit(0)).alias(f"__{v}_off") for v in values],
        *[F.sum(f"__{v}_sum").over(whole).alias(f"{v}_total") for v in values],
    )
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = joined_on(tagged, offsets, [*by, "__range"])
    for v in values:
        joined = joined.withColumn(f"{v}_before", F.col(f"__{v}_off") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return joined.select(*df.columns, *[f"{v}_before" for v in values], *[f"{v}_total" for v in values])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rn", ranges: int | None = None) -> DataFrame:
    """Row number from 1 within each group; ``order`` ascending and unique within the group."""
    out = running_totals(df.withColumn("__one", F.lit(1).cast("long")), by, order, ["__one"], ranges=ranges)
    return out.withColumn(name, F.col("__one_before") + 1).withColumn(f"{name}_of", F.col("__one_total")).drop(
        "__one", "__one_before", "__one_total"
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their counts: the map-side combined form every order statistic starts from."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], ranges: int | None = None, bounded: bool = False
) -> DataFrame:
    """Exact linear-interpolated percentiles per group; ``probs`` maps output names to fractions.

    ``bounded`` says that groups are small by construction, so the built-in aggregate may hold one group's values.
    """
    if bounded:
        return df.groupBy(*by).agg(*[F.percentile(value, float(q)).alias(name) for name, q in probs.items()])
    return percentiles_of(df, by, {value: probs}, ranges)


def percentiles_of(
    df: DataFrame, by: Sequence[str], wanted: dict[str, dict[str, float]], ranges: int | None = None
) -> DataFrame:
    """Exact percentiles of several columns in one pass: ``{column: {output name: fraction}}``."""
    by = list(by)
    columns = list(wanted)
    if len(columns) == 1:
        long = df.select(*by, F.lit(0).alias("__c"), F.col(columns[0]).alias("__v"))
    else:
        entries = [F.struct(F.lit(k).alias("__c"), F.col(c).cast("double").alias("__v")) for k, c in enumerate(columns)]
        long = df.select(*by, F.inline(F.array(*entries)))
    # a NULL value counts 0, so that groups of nothing else stay, with NULL percentiles
    counts = stored(long.groupBy(*by, "__c", "__v").agg(F.count("__v").alias("n")), "counts")  # read by the sample, the range totals and the windows
    ranked = _around(counts, [*by, "__c"], {(k, float(q)) for k, c in enumerate(columns) for q in wanted[c].values()}, ranges)
    v, before, n, total, which = F.col("__v"), F.col("n_before"), F.col("n"), F.col("n_total"), F.col("__c")
    picks, out = [], []
    for k, c in enumerate(columns):
        size = f"__total_{k}"
        picks.append(F.max(F.when(which == k, total)).alias(size))
        for name, q in wanted[c].items():
            for side, f in (("lo", F.floor), ("hi", F.ceil)):
                at = f(F.lit(float(q)) * (total - 1))
                picks.append(F.max(F.when((which == k) & (before <= at) & (at < before + n), v)).alias(f"__{name}_{side}"))
            lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
            pos = F.lit(float(q)) * (F.col(size) - 1)
            out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *out)


def _around(counts: DataFrame, by: Sequence[str], fractions: set[tuple[int, float]], ranges: int | None) -> DataFrame:
    """``running_totals`` of the counts ``n`` of values ``__v``, for those ranges alone that hold the rank of a fraction (of column ``__c``) of their
    group. A group without a value keeps its row."""
    splits = split_points(counts, ["__v"], [*by, "__v"], _ranges(counts, ranges))
    tagged = counts.withColumn("__range", range_id(["__v"], splits, counts.schema))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = tagged.groupBy(*by, "__range").agg(F.sum("n").alias("__sum")).select(
        *by, "__range", "__sum", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__off"), F.sum("__sum").over(Window.partitionBy(*by)).alias("n_total")
    )
    held = F.col("n_total") == 0
    for k, q in sorted(fractions):
        for side in (F.floor, F.ceil):
            at = side(F.lit(q) * (F.col("n_total") - 1))
            held = held | ((F.col("__c") == k) & (F.col("__off") <= at) & (at < F.col("__off") + F.col("__sum")))
    inside = Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    out = joined_on(tagged, sums.where(held).drop("__sum"), [*by, "__range"])
    return out.withColumn("n_before", F.col("__off") + F.coalesce(F.sum("n").over(inside), F.lit(0))).select(*counts.columns, "n_before", "n_total")


def row_median(values: str) -> Column:
    """Exact interpolated median of the values of an array, NULLs left out; NULL if there is none."""
    kept = F.sort_array(F.array_compact(values))
    at = F.lit(0.5) * (F.size(kept) - 1)
    low, high = (F.get(kept, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def top_share_mean(df: DataFrame, by: Sequence[str], value: str, share: float = 0.05, name: str = "top_mean") -> DataFrame:
    """Mean of the highest ``ceil(share * n)`` (at least one) values per group, ties split exactly."""
    counts = value_counts(df, by, value).withColumn("__neg", -F.col(value))
    ranked = running_totals(counts, by, ["__neg"], ["n"])
    k = F.greatest(F.ceil(F.lit(share) * F.col("n_total")), F.lit(1))
    taken = F.greatest(F.least(F.col("n"), k - F.col("n_before")), F.lit(0))
    return ranked.groupBy(*by).agg((F.sum(F.col(value) * taken) / F.sum(taken)).alias(name))


def neighbours_in_order(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Adds ``prev_<c>`` and ``next_<c>`` along the order of each group, without one task per group.

    Range edges are carried over by a table of first and last rows per (group, range).
    """
    by, order, columns = list(by), list(order), list(columns)
    splits = split_points(df, order, by + order, _ranges(df, ranges))
    tagged = df.withColumn("__range", range_id(order, splits, df.schema))
    row = F.struct(*columns)
    edges = tagged.groupBy(*by, "__range").agg(
        F.min_by(row, F.struct(*order)).alias("__first"), F.max_by(row, F.struct(*order)).alias("__last")
    )
    w = Window.partitionBy(*by).orderBy("__range")
    edges = edges.select(*by, "__range", F.lag("__last").over(w).alias("__edge_prev"), F.lead("__first").over(w).alias("__edge_next"))
    inside = Window.partitionBy(*by, "__range").orderBy(*order)
    out = joined_on(tagged, edges, [*by, "__range"]).withColumns(
        {
            "__p": F.coalesce(F.lag(row).over(inside), F.col("__edge_prev")),
            "__q": F.coalesce(F.lead(row).over(inside), F.col("__edge_next")),
        }
    )
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.col(f"__p.{c}")).withColumn(f"next_{c}", F.col(f"__q.{c}"))
    return out.drop("__range", "__edge_prev", "__edge_next", "__p", "__q")


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[str], payload: str, name: str, ranges: int | None = None) -> DataFrame:
    """Adds ``name``: the last non-NULL ``payload`` at or before each row of its group (the as-of value).

    Ranges of a hot group inherit the last payload of the ranges before them, so no group is walked by one task.
    """
    by, order = list(by), list(order)
    splits = split_points(df, order, by + order, _ranges(df, ranges))
    tagged = df.withColumn("__range", range_id(order, splits, df.schema))
    edges = tagged.groupBy(*by, "__range").agg(F.max_by(payload, F.when(F.col(payload).isNotNull(), F.struct(*order))).alias("__last"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*by, "__range", F.last("__last", ignorenulls=True).over(before).alias("__edge"))
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined_on(tagged, edges, [*by, "__range"])
    return out.withColumn(name, F.coalesce(F.last(payload, ignorenulls=True).over(inside), F.col("__edge"))).drop("__range", "__edge")
