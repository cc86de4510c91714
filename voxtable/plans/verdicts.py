"""Registered verdict rules. Each is one or two grouped boolean aggregates over paired scores.

Every threshold is a keyword whose default is the registered value. Rules differ on purpose in how they count a win and
whether the needed share is rounded up; see the argument names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.operators.ordered import numbered, percentiles
from voxtable.operators.stats import guarded_corr


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by)


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Join per-group values; without grouping columns both sides are single rows."""
    if by:
        return left.join(right.select(*by, *columns), list(by))
    return left.withColumns({c: right.select(c).scalar() for c in columns})


def paired_gain_rule(
    rows: DataFrame, by: Sequence[str], scroll: str, base: str, new: str, n_min: int = 20, gain_min: float = 0.05, win_share: float = 0.70, scroll_min: int = 3
) -> DataFrame:
    """PASS iff the mean gain reaches ``gain_min``, strict wins reach ``win_share * n`` (not rounded up) and no scroll with
    ``scroll_min`` windows has a negative mean; UNKNOWN under ``n_min``."""
    by = list(by)
    g = rows.where(F.col(base).isNotNull() & F.col(new).isNotNull()).withColumn("gain", F.col(new) - F.col(base))
    per = g.groupBy(*by, scroll).agg(F.count(F.lit(1)).alias("k"), F.sum("gain").alias("s"), F.count_if(F.col("gain") > 0).alias("w"))
    out = _grouped(per, by).agg(
        F.sum("k").alias("n"), (F.sum("s") / F.sum("k")).alias("mean_gain"), F.sum("w").alias("wins"),
        F.bool_and((F.col("k") < scroll_min) | (F.col("s") / F.col("k") >= 0)).alias("scrolls_ok"),
    )
    ok = (F.col("mean_gain") >= gain_min) & (F.col("wins") >= win_share * F.col("n")) & F.col("scrolls_ok")
    return out.withColumn("verdict", F.when(F.col("n") < n_min, "UNKNOWN").when(ok, "PASS").otherwise("FAIL"))


def group_rule(rows: DataFrame, levels: Sequence[str], a: str, b: str, n_min: int = 10, win_share: float = 0.7, mean_min: float = 0.0) -> DataFrame:
    """Non-inferiority of ``a``: wins (``>=``) reach ``ceil(win_share n)`` and the mean difference is at least ``mean_min``.

    ``rollup`` over ``levels`` (study, scroll): per scroll, pooled per study and over everything, from one aggregate.
    """
    d = F.col(a) - F.col(b)
    named = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in levels], a, b)
    out = named.rollup(*levels).agg(
        F.count(d).alias("n"), F.count(F.lit(1)).alias("n_rows"), F.count_if(d >= 0).alias("wins"), F.avg(d).alias("mean_diff"),
        F.avg(F.when(d.isNotNull(), F.col(a))).alias("mean_a"), F.avg(F.when(d.isNotNull(), F.col(b))).alias("mean_b"),
    )
    need = F.ceil(F.lit(win_share) * F.col("n"))
    verdict = F.when(F.col("n") < n_min, "UNKNOWN").when((F.col("wins") >= need) & (F.col("mean_diff") >= mean_min), "PASS").otherwise("FAIL")
    return out.select(*[F.coalesce(c, F.lit("ALL")).alias(c) for c in levels], "n", "n_rows", "wins", need.alias("need"), "mean_diff", "mean_a", "mean_b", verdict.alias("verdict"))


def planned_coverage(planned: DataFrame, scored: DataFrame, by: Sequence[str], key: str, score: str) -> DataFrame:
    """Planned, scored and unscored counts per group; any planned row without a score makes the group incomplete."""
    j = planned.join(scored.select(key, score), key, "left")
    out = j.groupBy(*by).agg(F.count(F.lit(1)).alias("planned"), F.count(score).alias("scored"), F.count_if(F.col(score).isNull()).alias("unscored"))
    return out.withColumn("status", F.when(F.col("unscored") > 0, "UNKNOWN").otherwise("COMPLETE"))


def finetune_rule(
    rows: DataFrame, by: Sequence[str], base: str, tuned: str, third: str, fold: str, planned: str, skipped: str,
    folds_min: int = 3, n_min: int = 30, skip_max: float = 0.01, win_share: float = 0.7, gain_min: float = 0.02, split: float = 0.75,
) -> DataFrame:
    """Fine-tune verdict with strata. ``rows`` holds one row per planned window; ``planned`` marks it comparable, a NULL ``base``
    means not scored, ``skipped`` is the fold's skipped share. Precedence: UNKNOWN, UNKNOWN, INVALID, PASS / FAIL."""
    got = F.col(base).isNotNull()
    gain = F.when(got & F.col(tuned).isNotNull(), F.col(tuned) - F.col(base))
    bad = got & (F.col(tuned).isNull() | F.isnan(tuned) | (F.col(tuned) == 0))
    low = F.col(base) < split
    out = _grouped(rows, by).agg(
        F.count_if(got).alias("n"), F.count_if(got | F.col(planned)).alias("comparable"), F.count_distinct(F.when(got, F.col(fold))).alias("folds"),
        F.count_if(bad).alias("bad"), F.max(F.when(got, F.col(skipped))).alias("skipped"), F.count_if(gain > 0).alias("above"), F.avg(gain).alias("mean_gain"),
        F.avg(F.when(low, gain)).alias("gain_low"), F.avg(F.when(~low, gain)).alias("gain_high"), F.count_if(got & low).alias("n_low"),
        F.count_if(got & (F.col(base) >= F.col(third))).alias("base_vs_third"), F.count_if(got & (F.col(tuned) >= F.col(third))).alias("tuned_vs_third"),
    )
    need = F.ceil(F.lit(win_share) * F.col("n"))
    verdict = (
        F.when((F.col("folds") < folds_min) | (F.col("n") < F.col("comparable")), "UNKNOWN")
        .when(F.col("n") < n_min, "UNKNOWN")
        .when((F.col("bad") > 0) | (F.coalesce("skipped", F.lit(0.0)) > skip_max), "INVALID")
        .when((F.col("above") >= need) & (F.col("mean_gain") >= gain_min), "PASS")
        .otherwise("FAIL")
    )
    return out.withColumn("need", need).withColumn("verdict", verdict)


def segment_means(rows: DataFrame, segment: str, base: str, tuned: str, third: str, gate: float = 0.75) -> DataFrame:
    """Per segment: scored windows, arm means and whether the mean base score is below the adaptation gate."""
    out = rows.where(F.col(base).isNotNull()).groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"), F.avg(base).alias("mean_base"), F.avg(tuned).alias("mean_tuned"), F.avg(third).alias("mean_third")
    )
    return out.withColumn("gate_adapts", F.col("mean_base") < gate)


def gap_closed_rule(rows: DataFrame, by: Sequence[str], group: str, at_zero: str, best: str, reference: str, tolerance: float = 0.03, close_share: float = 0.5, margin: float = 0.05) -> DataFrame:
    """Sets L (loss) and W (control): PASS iff the gap closes on ``ceil(close_share n)`` loss windows and the median gain of
    L exceeds that of W by ``margin``; UNKNOWN if any planned L or W window is undefined."""
    by = list(by)
    defined = F.col(at_zero).isNotNull() & F.col(best).isNotNull() & F.col(reference).isNotNull()
    g = rows.withColumn("defined", defined).withColumn("gain", F.when(defined, F.col(best) - F.col(at_zero)))
    counts = g.groupBy(*by, group).agg(
        F.count(F.lit(1)).alias("planned"), F.count_if("defined").alias("defined"),
        F.count_if(F.col("defined") & (F.col(best) >= F.col(reference) - tolerance)).alias("closed"),
    )
    med = percentiles(g.where("defined"), [*by, group], "gain", {"median_gain": 0.5})
    per = counts.join(med, [*by, group], "left")

    def of(name: str, which: str) -> Column:
        return F.max(F.when(F.col(group) == which, F.col(name))).alias(f"{name}_{which}")

    wide = _grouped(per, by).agg(*[of(c, s) for s in ("L", "W") for c in ("planned", "defined", "closed", "median_gain")])
    need = F.ceil(F.lit(close_share) * F.col("planned_L"))
    diff = F.col("median_gain_L") - F.col("median_gain_W")
    complete = (F.col("defined_L") == F.col("planned_L")) & (F.col("defined_W") == F.col("planned_W")) & (F.col("planned_L") > 0)
    verdict = F.when(~F.coalesce(complete, F.lit(False)), "UNKNOWN").when((F.col("closed_L") >= need) & (diff >= margin), "PASS").otherwise("FAIL")
    return wide.withColumn("need", need).withColumn("median_diff", diff).withColumn("verdict", verdict)


def chooser_rule(
    scores: DataFrame, chosen: DataFrame, by: Sequence[str], window: str, group: str, offset: str, auc: str, gain_share: float = 0.5, harm_max: float = -0.01, wins_min: int = 8
) -> DataFrame:
    """Label-free chooser: scores (window, set, offset, auc) against chosen offsets (by, window, chosen).

    PASS iff the mean gain on L reaches ``gain_share`` of the oracle gain, the mean gain on W is at least ``harm_max`` and the
    choice beats offset 0 on ``wins_min`` L windows. Also the expectation of a random offset and oracle matches.
    """
    by = list(by)
    order = F.struct((-F.col(auc)).alias("v"), F.abs(F.col(offset)).alias("a"), F.col(offset).alias("o"))
    wide = scores.groupBy(window, group).agg(
        F.max(F.when(F.col(offset) == 0, F.col(auc))).alias("auc0"), F.max(auc).alias("best"), F.min_by(offset, F.when(F.col(auc).isNotNull(), order)).alias("best_offset"),
        F.avg(auc).alias("mean_auc"),
    )
    pick = scores.select(window, F.col(offset).alias("chosen"), F.col(auc).alias("chosen_auc"))
    j = chosen.join(wide, window).join(pick, [window, "chosen"], "left").withColumn("gain", F.col("chosen_auc") - F.col("auc0"))

    def mean_in(expr: Column, which: str) -> Column:
        return F.avg(F.when(F.col(group) == which, expr))

    def holes(which: str) -> Column:
        return F.count_if((F.col(group) == which) & F.col("gain").isNull())

    out = _grouped(j, by).agg(
        mean_in(F.col("gain"), "L").alias("gain_L"), mean_in(F.col("gain"), "W").alias("gain_W"), mean_in(F.col("best") - F.col("auc0"), "L").alias("oracle_gain_L"),
        F.count_if((F.col(group) == "L") & (F.col("gain") > 0)).alias("wins_L"), mean_in(F.col("mean_auc") - F.col("auc0"), "L").alias("random_gain_L"),
        F.count_if(F.col("chosen") == F.col("best_offset")).alias("oracle_matches"), (holes("L") + holes("W")).alias("undefined"),
    )
    known = (F.col("undefined") == 0) & F.col("gain_L").isNotNull() & F.col("gain_W").isNotNull() & F.col("oracle_gain_L").isNotNull()
    ok = (F.col("gain_L") >= gain_share * F.col("oracle_gain_L")) & (F.col("gain_W") >= harm_max) & (F.col("wins_L") >= wins_min)
    return out.withColumn("verdict", F.when(~known, "UNKNOWN").when(ok, "PASS").otherwise("FAIL"))


def three_way_rule(rows: DataFrame, by: Sequence[str], diff: str, margin: float = 0.02, share: float = 0.6, names: Sequence[str] = ("REAL_INPUT_MATTERS", "SIM_BETTER", "NO_CLEAR_DIFFERENCE")) -> DataFrame:
    """First name if the mean reaches ``margin`` with ``share`` of windows up, second if mirrored, else third."""
    out = _grouped(rows.where(F.col(diff).isNotNull()), by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean"), F.count_if(F.col(diff) > 0).alias("up"), F.count_if(F.col(diff) < 0).alias("down")
    )
    up = (F.col("mean") >= margin) & (F.col("up") >= share * F.col("n"))
    down = (F.col("mean") <= -margin) & (F.col("down") >= share * F.col("n"))
    return out.withColumn("outcome", F.when(up, names[0]).when(down, names[1]).otherwise(names[2]))


def threshold_rule(rows: DataFrame, by: Sequence[str], diff: str, n_min: int, mean_min: float, wins_min_share: float, loss_at: float = 0.0) -> DataFrame:
    """Count / mean / wins / losses verdict used for transform and mesh comparisons."""
    out = _grouped(rows.where(F.col(diff).isNotNull()), by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean"), F.count_if(F.col(diff) > 0).alias("wins"), F.count_if(F.col(diff) < loss_at).alias("losses")
    )
    ok = (F.col("mean") >= mean_min) & (F.col("wins") >= F.ceil(wins_min_share * F.col("n")))
    return out.withColumn("verdict", F.when(F.col("n") < n_min, "UNKNOWN").when(ok, "PASS").otherwise("FAIL"))


def replication(a: DataFrame, b: DataFrame, by: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """REPLICATED iff both PASS or both FAIL, NOT_REPLICATED for one of each, else UNKNOWN."""
    j = a.select(*by, F.col(verdict).alias("verdict_a")).join(b.select(*by, F.col(verdict).alias("verdict_b")), list(by))
    firm = F.col("verdict_a").isin("PASS", "FAIL") & F.col("verdict_b").isin("PASS", "FAIL")
    out = F.when(firm & (F.col("verdict_a") == F.col("verdict_b")), "REPLICATED").when(firm, "NOT_REPLICATED").otherwise("UNKNOWN")
    return j.withColumn("outcome", out)


def gain_agreement(a: DataFrame, b: DataFrame, by: Sequence[str], window: str, gain: str) -> DataFrame:
    """Windows scored in both runs: their number, gain correlation (guarded) and mean absolute gain difference."""
    j = a.select(*by, window, F.col(gain).alias("ga")).join(b.select(*by, window, F.col(gain).alias("gb")), [*by, window]).where("ga is not null and gb is not null")
    return _grouped(j, by).agg(F.count(F.lit(1)).alias("n"), guarded_corr("ga", "gb").alias("gain_corr"), F.avg(F.abs(F.col("ga") - F.col("gb"))).alias("mean_abs_diff"))


def reproduction_check(old: DataFrame, new: DataFrame, by: Sequence[str], key: str, score: str, counts: Sequence[str], tolerance: float = 0.005) -> DataFrame:
    """REPRODUCED iff the largest score difference is within tolerance and all pixel counts are identical."""
    j = old.select(*by, key, F.col(score).alias("s0"), *[F.col(c).alias(f"{c}0") for c in counts]).join(new.select(*by, key, F.col(score).alias("s1"), *[F.col(c).alias(f"{c}1") for c in counts]), [*by, key])
    same = F.lit(True)
    for c in counts:
        same = same & F.col(f"{c}0").eqNullSafe(F.col(f"{c}1"))
    out = _grouped(j, by).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("s0") - F.col("s1"))).alias("max_diff"), F.bool_and(same).alias("same_counts"))
    return out.withColumn("verdict", F.when((F.col("max_diff") <= tolerance) & F.col("same_counts"), "REPRODUCED").otherwise("DIFFERS"))


def null_control(auc: Column, verdict: Column, tolerance: float = 0.1) -> Column:
    """The verdict stands only if the shuffled-input AUC exists and lies within ``tolerance`` of one half."""
    return F.when(auc.isNull() | (F.abs(auc - 0.5) > tolerance), "INVALID").otherwise(verdict)


def texture_outcome(corr: Column, texture_min: float = 0.5, depth_max: float = 0.2) -> Column:
    return F.when(corr >= texture_min, "TEXTURE_DRIVEN").when(corr <= depth_max, "DEPTH_DEPENDENT").otherwise("MIXED")


def placement_gate(crops: DataFrame, by: Sequence[str], best: str, ncc_ok: float = 0.4, need: int = 5) -> DataFrame:
    """Placement holds if enough crops correlate; otherwise the refit branch applies."""
    out = _grouped(crops, by).agg(F.count(F.lit(1)).alias("crops"), F.count_if(F.col(best) >= ncc_ok).alias("good"))
    return out.withColumn("verdict", F.when(F.col("good") >= need, "PLACED").otherwise("REFIT"))


def fitted_placement(fit: DataFrame, used_min: int = 8, rms_max: float = 2.0) -> DataFrame:
    """PLACE_OK iff the trimmed fit kept enough crops with a small enough RMS."""
    ok = F.coalesce((F.col("used") >= used_min) & (F.col("rms") <= rms_max), F.lit(False))
    return fit.withColumn("verdict", F.when(ok, "PLACE_OK").otherwise("PLACE_FAIL"))


def carry_gate(rows: DataFrame, by: Sequence[str], residual: str, carried_ink: str, total_ink: str, scale: str, residual_max: float = 4.0, share_min: float = 0.5, scale_tol: float = 0.1) -> DataFrame:
    """Carry holds if the median residual, the carried ink share and the local scale all pass."""
    by = list(by)
    med = percentiles(rows, by, residual, {"median_residual": 0.5})
    agg = _grouped(rows, by).agg((F.sum(carried_ink) / F.sum(total_ink)).alias("ink_share"), F.avg(scale).alias("scale"))
    out = _attach(agg, med, by, ["median_residual"])
    ok = (F.col("median_residual") <= residual_max) & (F.col("ink_share") >= share_min) & (F.abs(F.col("scale") - 1) <= scale_tol)
    return out.withColumn("verdict", F.when(F.coalesce(ok, F.lit(False)), "CARRY_OK").otherwise("CARRY_FAIL"))


def bucket_verdict(audit: DataFrame, by: Sequence[str], flags: str = "flags") -> DataFrame:
    """BUCKET_CLEAN iff no row carries a DEPTH, META, CHUNK, XLEVEL or ERROR flag (an empty probe alone is allowed)."""
    hard = F.exists(F.col(flags), lambda f: f.rlike("^(DEPTH|META|CHUNK|XLEVEL)") | (f == "ERROR"))
    out = _grouped(audit, by).agg(F.count(F.lit(1)).alias("volumes"), F.count_if(F.size(flags) > 0).alias("flagged"), F.bool_or(hard).alias("defects"))
    return out.withColumn("verdict", F.when(F.col("defects"), "BUCKET_DEFECTS").otherwise("BUCKET_CLEAN"))


def known_text_gate(stats: DataFrame, order: str, median: str, share: str, top: int = 15, median_max: float = 30.0, share_min: float = 0.10, side: int = 2, reach: float = 10.0) -> DataFrame:
    """Per winding: ``chosen`` if among the ``top`` nearest with a small median or a large share, or within ``side`` places of
    the nearest in index order; ``gate`` says whether the nearest reaches the surface. One row per winding, so it is small."""
    by_median = numbered(stats, [], [median, order], "near_rank").drop("near_rank_of")
    placed = numbered(by_median, [], [order], "place").drop("place_of")
    best = placed.where("near_rank = 1")
    spot, low = best.select("place").scalar(), best.select(median).scalar()
    near = (F.col("near_rank") <= top) & ((F.col(median) <= median_max) | (F.col(share) >= share_min))
    chosen = near | F.col("place").between(spot - side, spot + side)
    return placed.withColumn("chosen", chosen).withColumn("gate", F.when(low < reach, "MESH_REACHES").otherwise("MESH_MISS"))


def screen_report(patches: DataFrame, status: str, done: str, hi: str, lo: str, hi_min: float = 0.02, ratio: float = 3.0) -> DataFrame:
    """One row: how many patches have each status, how many of those that are done are one-sided candidates, and HITS or NOTHING."""
    found = screen_verdict(patches.where(F.col(status) == done), hi, lo, hi_min, ratio).agg(F.count(F.lit(1)).alias("candidates"))
    counts = patches.groupBy(status).agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws("=", F.col(status), F.col("n").cast("string")))).alias("statuses"))
    verdict = F.when(F.col("candidates") > 0, "HITS").otherwise("NOTHING")
    return found.withColumns({"statuses": F.array_join(counts.scalar(), ","), "verdict": verdict})


def window_statistics(blocks: DataFrame, window: str, offset: str, value: str, min_blocks: int = 100, share: float = 0.05) -> DataFrame:
    """window, offset, blocks, std, mean and top (mean of the highest ``share``); a window with fewer than ``min_blocks`` blocks has no statistics."""
    from voxtable.operators.ordered import top_share_mean

    base = blocks.where(F.col(value).isNotNull()).groupBy(window, offset).agg(F.count(F.lit(1)).alias("blocks"), F.stddev_pop(value).alias("std"), F.avg(value).alias("mean"))
    out = base.join(top_share_mean(blocks, [window, offset], value, share, "top"), [window, offset])
    return out.select(window, offset, "blocks", *[F.when(F.col("blocks") >= min_blocks, F.col(c)).alias(c) for c in ("std", "mean", "top")])


def chosen_offsets(statistics: DataFrame, window: str, offset: str, by: str) -> DataFrame:
    """window, chosen: the offset with the highest statistic, ties to the smaller absolute and then the more negative one; 0 if one is missing."""
    best = F.min_by(F.col(offset), F.struct((-F.col(by)).alias("v"), F.abs(F.col(offset)).alias("a"), F.col(offset).alias("o")))
    return statistics.groupBy(window).agg(F.when(F.count(by) == F.count(F.lit(1)), best).otherwise(0).alias("chosen"))


def screen_verdict(candidates: DataFrame, hi: str, lo: str, hi_min: float = 0.02, ratio: float = 3.0, extra: Column | None = None) -> DataFrame:
    """One-sided candidates: the better side reaches ``hi_min`` and the other stays under a third of it."""
    side_hi, side_lo = F.greatest(hi, lo), F.least(hi, lo)
    out = candidates.withColumns({"hi": side_hi, "lo": side_lo, "side": F.when(F.col(hi) >= F.col(lo), "a").otherwise("b")})
    out = out.where((F.col("hi") >= hi_min) & (F.col("lo") < F.col("hi") / ratio))
    return out.where(extra) if extra is not None else out
