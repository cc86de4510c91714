"""Rank AUC with both tie rules, pooled over any coarser grouping.

Pixels are first reduced to (group, score) -> (positives, negatives), which combines map-side; ranks then come from
cumulative counts over distinct scores, so no task ever sorts the raw pixels of one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.operators.ordered import running_totals
from voxtable.session import stored

ALL = "ALL"


def score_counts(df: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    hit = F.col(positive).cast("boolean")
    return (
        df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & hit.isNotNull())
        .groupBy(*by, score)
        .agg(F.sum(hit.cast("long")).alias("pos"), F.sum((~hit).cast("long")).alias("neg"))
    )


def pool_counts(counts: DataFrame, by: Sequence[str], score: str, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Counts of every grouping level; columns not in a level read ``ALL``. Pools the pixels, not the AUCs."""
    keep = [F.array(*[(F.col(c).cast("string") if c in level else F.lit(ALL)) for c in by]) for level in levels]
    out = counts.withColumn("__k", F.explode(F.array(*keep)))
    for i, c in enumerate(by):
        out = out.withColumn(c, F.col("__k")[i])
    return out.groupBy(*by, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def rank_auc(counts: DataFrame, by: Sequence[str], score: str, ties: str = "mid", min_each: int = 200) -> DataFrame:
    """AUC per group from ``score_counts`` rows: ``ties='mid'`` averages ranks, ``'against'`` counts a tie as a miss.

    Groups with fewer than ``min_each`` of either class get NULL.
    """
    share = {"mid": 0.5, "against": 0.0}[ties]
    ranked = running_totals(stored(counts, "counts"), by, [score], ["neg"])  # read by the sample, the range totals and the windows
    summed = ranked.groupBy(*by).agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.lit(share) * F.col("neg"))).alias("__u"),
    )
    enough = (F.col("pos") >= min_each) & (F.col("neg") >= min_each)
    return summed.select(*by, "pos", "neg", F.when(enough, F.col("__u") / (F.col("pos") * F.col("neg"))).alias("auc"))
