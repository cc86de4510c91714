"""Quality rules with thresholds that adapt to language and source: mergeable quantile sketches, then a join and a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import checkpoint, free

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: metric: (numerator, denominator, units per 1, spreads between the median and the limit, least and greatest upper limit, whether it has a lower limit)
METRICS = {
    "symbols": ("n_symbols", "word_chars", 10_000, 6, 500, 2_000, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 6, 5_000, 8_000, False),
    "repeats": ("n_repeat_words", "n_words", 10_000, 6, 3_000, 4_500, False),
    "word_length": ("word_chars", "n_words", 100, 6, 0, 2_500, True),
}
#: Tenth, half and nine tenths, in twentieths; the least distance of a limit from the median, in steps of the sketch there (1/32 of it); and how many
#: rows of its language a source is given besides its own (a language: of all).
TWENTIETHS, LEAST_STEPS, BORROWED = (2, 10, 18), 12, 200


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """The columns of df with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words in place of the text."""
    t, w, lines, windows, pairs, starts = free(df, "t_", "w_", "l_", "h_", "p_", "s_")
    keep = [F.col(f"`{c}`") for c in df.columns if c != text]
    df = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t))
    df = df.withColumns({
        w: F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""),
        lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.translate(t, WHITE, "")).cast("bigint"),
        "n_plain": F.length(F.translate(t, WHITE + SYMBOLS, "")).cast("bigint"),
    })
    n = F.size(w)
    df = df.select(
        *keep, w, n.cast("bigint").alias("n_words"), "word_chars", (F.col("word_chars") - F.col("n_plain")).alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")).alias(windows),
    )
    numbers = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    # only texts with a window that comes again need their windows in order
    again = F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.select(*numbers, again.alias(pairs))
    same = lambda x, k: (x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"])
    df = df.select(*numbers, F.sort_array(F.filter(F.transform(pairs, lambda x, k: F.when(same(x, k), x["i"])), lambda x: x.isNotNull())).alias(starts))
    ahead = F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3))))
    return df.select(*numbers, F.coalesce(F.aggregate(ahead, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint").alias("n_repeat_words"))


def rounded(value: Column) -> Column:
    """The value a sketch keeps for a non-negative integer: its five leading bits after the first, so within 1/32 below it."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 6, F.lit(0)))
    return (F.floor(value / step) * step).cast("bigint")


def metric(name: str) -> Column:
    above, below, units, *_ = METRICS[name]
    return F.floor(F.lit(units) * F.col(above) / F.greatest(F.col(below), F.lit(1))).cast("bigint")


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, metric, value, n: how many rows that pass the base rules have the value, rounded. Sketches merge by adding n."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), rounded(metric(m)).alias("value")) for m in METRICS)))
    rows = counts.where(~F.col("base_failed")).select("lang", "source", each.alias("e"))
    return rows.groupBy("lang", "source", "e.metric", "e.value").agg(F.count("*").alias("n"))


def limits(sketch: DataFrame, borrowed: int) -> DataFrame:
    """lang, source, metric, low, high, from the quantiles of the sketches.

    The quantiles of a source are averaged with those of its language, and these with those of all rows, weighted by rows, the wider group as if it had
    ``borrowed`` rows. A limit lies some spreads away from the median, a spread being the nearer of the tenth and the ninth decile: junk on one side
    moves neither it nor, up to nearly half of the rows, the median by much. Where values hardly differ the distance is ``LEAST_STEPS`` steps of the sketch.
    """
    from pyspark.sql import Window

    levels = []
    for depth, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketch.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "metric")
        up_to = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        steps = merged.select(*keys, "metric", "value", up_to.alias("up_to"), F.sum("n").over(group).alias("rows"))
        q = [F.min(F.when(F.col("up_to") * 20 >= F.col("rows") * k, F.col("value"))).alias(f"q{k}_{depth}") for k in TWENTIETHS]
        levels.append((keys, steps.groupBy(*keys, "metric").agg(F.first("rows").alias(f"rows_{depth}"), *q)))
    out = sketch.select("lang", "source", "metric").distinct()
    for depth, (keys, level) in enumerate(levels):
        named = level.select(*(F.col(k).alias(f"{k}_{depth}") for k in keys), F.col("metric").alias(f"metric_{depth}"), *level.columns[len(keys) + 1 :])
        match = F.col("metric") == F.col(f"metric_{depth}")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"{k}_{depth}"))
        out = out.join(named, match, "left")

    def merged_quantile(k: int) -> Column:
        wide = (F.col("rows_1") * F.col(f"q{k}_1") + borrowed * F.col(f"q{k}_2")) / (F.col("rows_1") + borrowed)
        return (F.col("rows_0") * F.col(f"q{k}_0") + borrowed * wide) / (F.col("rows_0") + borrowed)

    low, middle, high = (merged_quantile(k) for k in TWENTIETHS)
    by = lambda k: F.create_map(*(x for m, v in METRICS.items() for x in (F.lit(m), F.lit(v[k]))))[F.col("metric")]
    out = out.select("lang", "source", "metric", middle.alias("middle"), F.least(middle - low, high - middle).alias("spread"))
    width = F.greatest(by(3) * F.col("spread"), LEAST_STEPS * F.col("middle") / 32)
    least = F.when(by(6), F.greatest(F.col("middle") - width, F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select("lang", "source", "metric", least.alias("low"), F.least(F.greatest(F.col("middle") + width, by(4)), by(5)).alias("high"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", borrowed: int = BORROWED) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and ``failed`` (the names of the metrics beyond their limits) of every row.

    A row is kept if it passes the base rules (50 words at least, no more than half of them in repeated 3-word windows) and each metric lies within
    the limits of its language and source. Null texts have no words and fail. Null languages and sources form groups of their own; null ids and
    repeated rows are judged each; very long texts are counted whole; other columns are not read; an empty table gives no rows. Windows are compared by
    64-bit hashes within a text.
    """
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text_"))
    counts = base_counts(named, "text_").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counts = checkpoint(counts)
    rules = limits(sketches(counts), borrowed).groupBy("lang", "source")
    rules = rules.agg(*(F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in METRICS for side in ("low", "high")))
    rules = rules.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    beyond = lambda m: ~rounded(metric(m)).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    failed = F.filter(F.array(*(F.when(beyond(m), F.lit(m)) for m in METRICS)), lambda x: x.isNotNull())
    joined = counts.join(rules, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
        failed.alias("failed"), (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
    )
