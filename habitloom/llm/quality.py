"""Quality rules with thresholds from quantile sketches per language and source."""

from pyspark.sql import Column, DataFrame, functions as F

from habitloom.llm.common import pick, words
from habitloom.session import materialize

SYMBOLS = r"[#*$%&|<>]"
# Measures that are judged, and the least spread each is given: a group in which nearly all
# documents have the same value must not make every other value an outlier.
LEAST_SPREAD = {"symbol_ratio": 0.1, "dup_line_ratio": 0.15, "repeat_ratio": 0.1, "mean_word_chars": 0.3}
# Measures that may be too low as well.
TWO_SIDED = ("mean_word_chars",)


def _repeat_words(found: Column) -> Column:
    """Words inside 3-word windows that occur twice or more among ``found``.

    Windows are sorted with their places; equal neighbours are repeats. Texts
    without a repeat end after one pass over a hash set.
    """
    grams = F.when(F.size(found) >= 3, F.transform(
        F.slice(found, F.lit(1), F.size(found) - 2),
        lambda w, i: F.concat_ws(" ", w, F.get(found, i + 1), F.get(found, i + 2)))).otherwise(F.array().cast("array<string>"))

    def covered(grams):
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.transform(F.array(pairs), lambda s: F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(s, lambda p, k: p["g"].eqNullSafe(F.get(s, k - 1)["g"]) | p["g"].eqNullSafe(F.get(s, k + 1)["g"])),
            lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2))))))[0]

    return F.transform(F.array(grams), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))[0]


def measures(docs: DataFrame) -> DataFrame:
    """Counts and ratios of every whole text of ``(doc_id, text, lang, source)``; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def count(found):
        lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            F.size(found).cast("bigint").alias("n_words"), F.length(F.array_join(found, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))[0].alias("lines"),
            _repeat_words(found).cast("bigint").alias("n_repeat_words"))

    counted = pick(docs, "doc_id", "text", "lang", "source").select(
        "doc_id", "lang", "source", F.transform(F.array(words(text)), count)[0].alias("m"))
    n = F.col("n_words")
    return counted.select(
        "doc_id", "lang", "source", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.lines.dup").cast("bigint").alias("n_dup_lines"),
        "m.n_repeat_words", F.col("m.lines.all").cast("bigint").alias("n_lines"),
    ).withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).withColumns({
        "symbol_ratio": F.when(n > 0, F.col("n_symbols") / n), "repeat_ratio": F.when(n > 0, F.col("n_repeat_words") / n),
        "dup_line_ratio": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")),
        "mean_word_chars": F.when(n > 0, F.col("word_chars") / n),
    })


def thresholds(measured: DataFrame, width: float, least: int, k: int) -> DataFrame:
    """Limits per ``(lang, source)`` from mergeable sketches of the documents that pass the base rules.

    One sketch per measure and group is summed up on both sides of the
    shuffle. Sketches of the sources of a language merge into that of the
    language, those into one of all. A group of fewer than ``least`` documents
    takes the limits of its language, a small language those of all. A limit
    lies ``width`` spreads beyond a quartile, the spread being the distance of
    the quartiles or ``LEAST_SPREAD``. Sketches of ``k`` items are exact up to
    ``k`` documents; beyond, the rank error is about 1.7 / ``k`` of a group.
    """
    groups = measured.where(~F.col("base_failed")).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in LEAST_SPREAD])
    groups = materialize(groups, "quality-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in LEAST_SPREAD]]

    def limits(level):
        columns = []
        for m, floor in LEAST_SPREAD.items():
            low, high = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (0.25, 0.75))
            spread = width * F.greatest(high - low, F.lit(floor))
            columns += [(high + spread).alias(f"{m}_high")]
            if m in TWO_SIDED:
                columns += [(low - spread).alias(f"{m}_low")]
        return F.when(F.col("n") >= least, F.struct(*columns)).alias(level)

    by_lang = groups.groupBy("lang").agg(*merged).select("lang", limits("lang_limits"))
    all_limits = groups.groupBy().agg(*merged).select(limits("all_limits"))
    every = measured.select("lang", "source").distinct()
    own = groups.select("lang", "source", limits("own_limits"))
    same = lambda *names: [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in names]
    joined = every.alias("a").join(own.alias("b"), same("lang", "source"), "left").select("a.*", "own_limits") \
        .alias("a").join(by_lang.alias("b"), same("lang"), "left").select("a.*", "lang_limits").crossJoin(all_limits)  # one row
    return materialize(joined.select("lang", "source", F.coalesce("own_limits", "lang_limits", "all_limits").alias("limits")), "quality-limits")


def judge(docs: DataFrame, width: float = 3.0, least: int = 20, k: int = 4096) -> DataFrame:
    """Measures of every document with ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules and none of its measures
    lies beyond the limits of its language and source. Nulls in ``lang`` or
    ``source`` form groups of their own; a measure without a value (no words,
    no lines) is not judged; where there are too few documents for any
    limits, the base rules alone decide. Repeated rows are judged alike. The
    texts are read once and never shuffled.
    """
    measured = materialize(measures(docs), "quality-measures")
    limits = thresholds(measured, width, least, k)
    beyond = F.lit(False)
    for m in LEAST_SPREAD:
        beyond = beyond | F.coalesce(F.col(m) > F.col(f"limits.{m}_high"), F.lit(False))
        if m in TWO_SIDED:
            beyond = beyond | F.coalesce(F.col(m) < F.col(f"limits.{m}_low"), F.lit(False))
    return measured.alias("a").join(
        limits.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left",
    ).select("a.*", (~F.col("base_failed") & ~beyond).alias("kept"))
