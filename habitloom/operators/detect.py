"""Likelihood-based sequence anomaly detection and the two-stage corpus filter.

The scorer is a first-order Markov model with add-one smoothing. An ``env``
names what the detector looks at, so that many detectors run in one job.
"""

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitloom.functions.columns import ratio_or_zero
from habitloom.model import EVENT_COLUMNS, SEQ
from habitloom.operators.ranking import exact_percentiles
from habitloom.operators.sequences import with_neighbour
from habitloom.session import materialize

# The event field each environment's detector reads.
FIELD_BY_ENV = {"spring": "action_id", "night": "hour_slot", "multiple": "device_id"}

# Validation percentile of the threshold per (dataset, environment).
PERCENTILE_BY_CELL = {
    ("fr", "spring"): 95.5, ("fr", "night"): 95.0, ("fr", "multiple"): 99.0,
    ("sp", "spring"): 95.0, ("sp", "night"): 95.0, ("sp", "multiple"): 99.0,
    ("us", "spring"): 95.0, ("us", "night"): 93.0, ("us", "multiple"): 99.0,
}

# Filter tag per (dataset, environment).
FILTER_TAG_BY_CELL = {
    ("fr", "spring"): "0.918", ("fr", "night"): "0.92", ("fr", "multiple"): "0.915",
    ("sp", "spring"): "0.915", ("sp", "night"): "0.917", ("sp", "multiple"): "0.915",
    ("us", "spring"): "0.905", ("us", "night"): "0.919", ("us", "multiple"): "0.913",
}

# Context of a first event: no id can be this, whereas -1 is an unknown one.
START = -(2**31)
# Field of a detector that reads whole events.
FLAT = "flat"


@dataclass(frozen=True)
class Detector:
    """What one detector reads and how many different tokens there are.

    ``field`` is an event column, or ``flat`` for all four of them in their
    order. With ``whole_corpus`` it trains and validates on all sequences
    instead of a split; with ``max_tokens`` it reads that many tokens of a
    sequence (40 in the reference filter) and no more.
    """

    env: str
    field: str
    vocab_size: int
    percentile: float = 95.0
    whole_corpus: bool = False
    max_tokens: int | None = None

    def __post_init__(self):
        if not 0.0 <= self.percentile <= 100.0:
            raise ValueError("percentile must be between 0 and 100")


@dataclass(frozen=True)
class MarkovModel:
    pairs: DataFrame      # *by, prev, token, n
    contexts: DataFrame   # *by, prev, n_context
    by: tuple = ("env",)  # what a fit is for


def cell_parameters(spark) -> DataFrame:
    """``(dataset, env, field, percentile, filter_tag)`` of the nine cells."""
    rows = [
        (dataset, env, FIELD_BY_ENV[env], PERCENTILE_BY_CELL[dataset, env], FILTER_TAG_BY_CELL[dataset, env])
        for dataset, env in PERCENTILE_BY_CELL
    ]
    return spark.createDataFrame(rows, "dataset string, env string, field string, percentile double, filter_tag string")


def token_steps(events: DataFrame, detectors, keep=(), aim=None) -> DataFrame:
    """``(env, corpus_id, seq_id, pos, prev, token, vocab_size, *keep)``.

    One pass over the events serves all detectors: neighbours are looked up
    once, then each event gives one row per detector, or with ``aim`` only for
    the detector whose ``env`` that column holds. Padding never appears, as a
    sequence has rows only for its events.
    """
    fields = sorted({f for d in detectors for f in ([EVENT_COLUMNS[-1]] if d.field == FLAT else [d.field])})
    rows = with_neighbour(events, -1, **{f"_prev_{field}": field for field in fields})

    def step(detector, place, before, token):
        return F.struct(
            F.lit(detector.env).alias("env"), F.coalesce(before, F.lit(START)).alias("prev"), F.col(token).alias("token"),
            F.lit(detector.vocab_size).alias("vocab_size"), place.cast("int").alias("pos"),
        )

    steps = []
    for d in detectors:
        names = EVENT_COLUMNS[3:] if d.field == FLAT else (d.field,)
        for i, name in enumerate(names):
            before = F.col(names[i - 1]) if i else F.col(f"_prev_{names[-1]}")
            place = F.col("pos") * len(names) + i
            made = step(d, place, before, name)
            wanted = [] if aim is None else [F.col(aim) == d.env]
            if d.max_tokens is not None:
                wanted.append(place < d.max_tokens)
            steps.append(F.when(reduce(and_, wanted), made) if wanted else made)
    return rows.select(*SEQ, *keep, F.explode(F.array(*steps)).alias("_t")).where("_t IS NOT NULL").select("_t.*", *SEQ, *keep)


def counted_steps(steps: DataFrame, keep=()) -> DataFrame:
    """``(env, corpus_id, seq_id, *keep, prev, token, vocab_size, n)``: equal steps of a sequence counted.

    All that the detectors need of a sequence; made where its events are, without a shuffle.
    """
    return steps.groupBy("env", *SEQ, *keep, "prev", "token", "vocab_size").agg(F.count(F.lit(1)).alias("n"))


def _times(steps):
    """How often a row of steps or counted steps stands."""
    return F.col("n") if "n" in steps.columns else F.lit(1).cast("bigint")


def fit_markov(steps: DataFrame, by=("env",)) -> MarkovModel:
    """Count transitions of steps, counted or not, per group of ``by``; the tables are bounded by the squared vocabulary and written once."""
    pairs = materialize(steps.groupBy(*by, "prev", "token").agg(F.sum(_times(steps)).alias("n")), "markov")
    return MarkovModel(pairs, pairs.groupBy(*by, "prev").agg(F.sum("n").alias("n_context")), tuple(by))


def sequence_losses(steps: DataFrame, model: MarkovModel, keep=()) -> DataFrame:
    """``(env, corpus_id, seq_id, *keep, loss, n_tokens)``: mean ``-ln((n + 1) / (n_context + vocab))``; with the columns the model is fitted by."""
    key = list(dict.fromkeys(["env", *model.by, *SEQ, *keep]))
    chance = (F.coalesce("_n_pair", F.lit(0)) + 1) / (F.coalesce("n_context", F.lit(0)) + F.col("vocab_size"))
    times = F.col("_times")
    return (
        steps.withColumn("_times", _times(steps)).join(model.pairs.withColumnRenamed("n", "_n_pair"), [*model.by, "prev", "token"], "left")
        .join(model.contexts, [*model.by, "prev"], "left")
        .groupBy(*key).agg((F.sum(times * -F.ln(chance)) / F.sum(times)).alias("loss"), F.sum(times).alias("n_tokens"))
    )


def _by_env(values: dict) -> Column:
    chosen = F.lit(None)
    for env, value in values.items():
        chosen = F.when(F.col("env") == env, F.lit(value)).otherwise(chosen)
    return chosen


def loss_thresholds(losses: DataFrame, detectors) -> DataFrame:
    """``(env, threshold)``: the detector's percentile of validation losses."""
    share = _by_env({d.env: d.percentile / 100.0 for d in detectors})
    return exact_percentiles(losses, "loss", {"threshold": share}, by=["env"])


def cell_thresholds(losses: DataFrame, detectors, by) -> DataFrame:
    """``(*by, threshold)``: per cell the percentile of validation losses that belongs to its dataset and env, else the detector's."""
    share = _by_env({d.env: d.percentile / 100.0 for d in detectors})
    for (dataset, env), percentile in PERCENTILE_BY_CELL.items():
        share = F.when((F.col("dataset") == dataset) & (F.col("env") == env), F.lit(percentile / 100.0)).otherwise(share)
    return exact_percentiles(losses, "loss", {"threshold": share}, by=by)


def classify(losses: DataFrame, thresholds: DataFrame, by=("env",)) -> DataFrame:
    """Add ``predicted``: 1 when the loss reaches the threshold. One threshold row per group of ``by``."""
    flagged = F.when(F.col("loss") < F.col("threshold"), 0).otherwise(1)
    return losses.join(F.broadcast(thresholds), list(by)).withColumn("predicted", flagged)


def loss_summary(losses: DataFrame, by=("env",)) -> DataFrame:
    return losses.groupBy(*by).agg(
        F.avg("loss").alias("loss_avg"), F.min("loss").alias("loss_min"), F.max("loss").alias("loss_max"),
        F.count(F.lit(1)).alias("n"),
    )


def confusion(predictions: DataFrame, by=("env",)) -> DataFrame:
    """Counts, precision, recall, accuracy and F1 (0 when undefined), FPR and FNR (null when undefined)."""
    y, p = F.col("label"), F.col("predicted")
    counts = predictions.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count(F.lit(1)).alias("test_size"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "precision": ratio_or_zero(tp, tp + fp), "recall": ratio_or_zero(tp, tp + fn),
        "accuracy": ratio_or_zero(tp + tn, F.col("test_size")),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "fpr": F.try_divide(fp.cast("double"), fp + tn), "fnr": F.try_divide(fn.cast("double"), fn + tp),
    })


def iqr_outliers(losses: DataFrame) -> DataFrame:
    """Add ``is_outlier``: loss above ``q3 + 1.5 * (q3 - q1)`` of its env."""
    cuts = exact_percentiles(losses, "loss", {"_q1": 0.25, "_q3": 0.75}, by=["env"])
    fence = F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))
    return (
        losses.join(F.broadcast(cuts.select("env", fence.alias("upper_fence"))), "env")
        .withColumn("is_outlier", F.col("loss") > F.col("upper_fence"))
    )


def utility_change(train: DataFrame, validation: DataFrame, outliers: DataFrame) -> DataFrame:
    """``(env, corpus_id, seq_id, loss_change, readmit)`` per outlier sequence.

    ``loss_change`` is what adding the outlier to the training counts does to
    the mean validation loss. Only contexts and pairs that occur in the outlier
    move: a context seen ``d`` more times adds ``W * ln((N+d+V)/(N+V))``, a
    pair seen ``d`` more times takes off ``w * ln((n+d+1)/(n+1))``, with ``W``
    and ``w`` the validation weight of the context and the pair. One job for
    all outliers, without refitting. An outlier comes back if the loss does
    not rise.
    """
    key = ["env", *SEQ]
    model = fit_markov(train)
    in_sequence = F.sum("n").over(Window.partitionBy(*key))
    sequences = F.sum("_share").over(Window.partitionBy("env"))
    weights = (
        validation.groupBy(*key, "prev", "token").agg(F.sum(_times(validation)).alias("n"))
        .withColumn("_share", F.col("n") / in_sequence)
        .groupBy("env", "prev", "token").agg(F.sum("_share").alias("_share"))
        .withColumn("w", F.col("_share") / sequences).drop("_share")
    )
    pair_table = materialize(
        weights.join(model.pairs, ["env", "prev", "token"], "left").fillna(0, ["n"]), "pair-weights"
    )
    context_table = materialize(
        weights.groupBy("env", "prev").agg(F.sum("w").alias("w"))
        .join(model.contexts, ["env", "prev"], "left").fillna(0, ["n_context"]), "context-weights",
    )
    added = outliers.groupBy(*key, "prev", "token", "vocab_size").agg(F.sum(_times(outliers)).alias("d"))
    gained = added.join(pair_table, ["env", "prev", "token"]).select(
        *key, (-F.col("w") * (F.ln(F.col("n") + F.col("d") + 1) - F.ln(F.col("n") + 1))).alias("_change"),
    )
    diluted = (
        added.groupBy(*key, "prev", "vocab_size").agg(F.sum("d").alias("d"))
        .join(context_table, ["env", "prev"])
        .withColumn("_base", F.col("n_context") + F.col("vocab_size"))
        .select(*key, (F.col("w") * (F.ln(F.col("_base") + F.col("d")) - F.ln("_base"))).alias("_change"))
    )
    none = added.select(*key, F.lit(0.0).alias("_change"))
    return (
        gained.unionByName(diluted).unionByName(none).groupBy(*key).agg(F.sum("_change").alias("loss_change"))
        .withColumn("readmit", F.col("loss_change") <= 0)
    )
