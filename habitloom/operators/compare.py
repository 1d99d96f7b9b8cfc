"""How close two corpora are.

Corpora are told apart by ``corpus_id``. Two matrices are lined up by a
conditional aggregate on the cell, not by an outer join.
"""

from pyspark.sql import DataFrame, Window, functions as F

from habitloom.functions.columns import device_key
from habitloom.model import SEQ
from habitloom.operators.descriptive import densify
from habitloom.operators.sequences import corpus_cells
from habitloom.session import materialize


def _side(corpus, value):
    return F.coalesce(F.max(F.when(F.col("corpus_id") == corpus, F.col(value))), F.lit(0.0))


def device_kl(distribution: DataFrame, target: str, synthetic: str, epsilon=1e-12) -> DataFrame:
    """One row: KL(target || synthetic) over the devices of both, smoothed by ``epsilon``."""
    everything = Window.partitionBy(F.lit(0))  # one row per device of the vocabulary
    both = (
        distribution.where(F.col("corpus_id").isin(target, synthetic))
        .groupBy("device").agg(
            (F.greatest(_side(target, "p"), F.lit(0.0)) + epsilon).alias("p"),
            (F.greatest(_side(synthetic, "p"), F.lit(0.0)) + epsilon).alias("q"),
        )
        .withColumn("p", F.col("p") / F.sum("p").over(everything))
        .withColumn("q", F.col("q") / F.sum("q").over(everything))
    )
    return both.agg(F.coalesce(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))), F.lit(0.0)).alias("kl"))


def matrix_similarity(matrix: DataFrame, left: str, right: str) -> DataFrame:
    """One row: cosine of two sparse matrices; 1 if both are zero, 0 if one is."""
    cells = matrix.where(F.col("corpus_id").isin(left, right)).groupBy("source", "target").agg(
        _side(left, "value").alias("a"), _side(right, "value").alias("b"),
    )
    norms = cells.agg(
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("dot"),
        F.coalesce(F.sum(F.col("a") * F.col("a")), F.lit(0.0)).alias("aa"),
        F.coalesce(F.sum(F.col("b") * F.col("b")), F.lit(0.0)).alias("bb"),
    )
    return norms.select(
        F.when((F.col("aa") == 0) & (F.col("bb") == 0), 1.0)
        .when((F.col("aa") == 0) | (F.col("bb") == 0), 0.0)
        .otherwise(F.col("dot") / (F.sqrt("aa") * F.sqrt("bb"))).alias("similarity")
    )


def _described(events):
    """Device shares and the two matrices of each corpus, from one pass over the events; the counts are written once."""
    cells = materialize(corpus_cells(events), "cells")
    kind = lambda name: cells.where(F.col("kind") == name)
    ends = [device_key("source").alias("source"), device_key("target").alias("target")]
    in_corpus, in_row = Window.partitionBy("corpus_id"), Window.partitionBy("corpus_id", "source")
    shares = kind("device").select("corpus_id", device_key("source").alias("device"), "n", (F.col("n") / F.sum("n").over(in_corpus)).alias("p"))
    transitions = kind("adjacent").select("corpus_id", *ends, (F.col("n") / F.sum("n").over(in_row)).alias("value"))
    met = kind("device").select("corpus_id", "source", F.col("n").alias("_met"))
    precedence = kind("followed").join(met, ["corpus_id", "source"]).select("corpus_id", *ends, (F.col("n") / F.col("_met")).alias("value"))
    return kind("sequence"), shares, transitions, precedence


def quality_by_variant(events: DataFrame, target: str, epsilon=1e-12) -> DataFrame:
    """A row per corpus other than ``target``, as ``variant``: both sizes, device KL and the two graph similarities.

    One counted pass describes all corpora; the target's counts, which the
    vocabulary bounds, are then set beside those of each variant.
    """
    counts, shares, transitions, precedence = _described(events)
    own = F.col("corpus_id") == target
    names = counts.where(~own).agg(F.collect_set("corpus_id").alias("names")).scalar()
    variant = F.explode(F.when(own, names).otherwise(F.array("corpus_id"))).alias("variant")

    def beside(cells, value, *on):
        sides = cells.select(variant, *on, F.when(own, F.col(value)).otherwise(0.0).alias("a"), F.when(own, 0.0).otherwise(F.col(value)).alias("b"))
        return sides.groupBy("variant", *on).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def cosine(matrix, name):
        sums = beside(matrix, "value", "source", "target").groupBy("variant").agg(
            F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
        return sums.select("variant", F.when((F.col("aa") == 0) & (F.col("bb") == 0), 1.0).when((F.col("aa") == 0) | (F.col("bb") == 0), 0.0)
                           .otherwise(F.col("ab") / (F.sqrt("aa") * F.sqrt("bb"))).alias(name))

    # A window holds a row per device of the vocabulary.
    in_variant = Window.partitionBy("variant")
    smooth = lambda x: (F.col(x) + epsilon) / F.sum(F.col(x) + epsilon).over(in_variant)
    kl = beside(shares, "p", "device").select("variant", smooth("a").alias("p"), smooth("b").alias("q")).groupBy("variant").agg(
        F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("device_distribution_kl"))
    size = counts.where(own).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    rows = counts.where(~own).groupBy(F.col("corpus_id").alias("variant")).agg(F.sum("n").alias("num_synthetic_sequences"))
    # Where neither corpus has a cell, they agree.
    rows = rows.join(kl, "variant", "left").join(cosine(transitions, "transition_matrix_similarity"), "variant", "left") \
        .join(cosine(precedence, "causal_graph_similarity"), "variant", "left")
    return rows.select("variant", size.alias("num_target_sequences"), "num_synthetic_sequences", F.coalesce("device_distribution_kl", F.lit(0.0)).alias("device_distribution_kl"),
                       *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("transition_matrix_similarity", "causal_graph_similarity")])


def quality_summary(events: DataFrame, target: str, synthetic: str) -> DataFrame:
    """One row with both corpus sizes, device KL and the two graph similarities."""
    counts, shares, transitions, precedence = _described(events.where(F.col("corpus_id").isin(target, synthetic)))
    size = lambda corpus: F.coalesce(F.sum(F.when(F.col("corpus_id") == corpus, F.col("n"))), F.lit(0))
    return counts.agg(size(target).alias("num_target_sequences"), size(synthetic).alias("num_synthetic_sequences")).select(
        "num_target_sequences", "num_synthetic_sequences",
        device_kl(shares, target, synthetic).scalar().alias("device_distribution_kl"),
        matrix_similarity(transitions, target, synthetic).scalar().alias("transition_matrix_similarity"),
        matrix_similarity(precedence, target, synthetic).scalar().alias("causal_graph_similarity"),
    )


def case_study_matrices(events: DataFrame, corpora) -> DataFrame:
    """Long table ``(corpus_id, kind, source, target, value)`` on one shared channel list.

    ``kind`` is ``distribution`` (target is null), ``transition`` or ``causal``.
    """
    corpora = list(corpora)
    _, shares, transitions, precedence = _described(events.where(F.col("corpus_id").isin(corpora)))
    channels = shares.select(F.col("device").alias("channel")).distinct()
    matrices = [
        densify(matrix, channels, corpora).select("corpus_id", F.lit(kind).alias("kind"), "source", "target", "value")
        for kind, matrix in (("transition", transitions), ("causal", precedence))
    ]
    return shares.select(
        "corpus_id", F.lit("distribution").alias("kind"), F.col("device").alias("source"),
        F.lit(None).cast("string").alias("target"), F.col("p").alias("value"),
    ).unionByName(matrices[0]).unionByName(matrices[1])


def distribution_penalty(events: DataFrame, target: DataFrame = None) -> DataFrame:
    """``(corpus_id, seq_id, distribution_penalty)``: total variation to ``target``.

    ``target`` is a ``(device, p)`` table, used as given; without one, or with
    an empty one, the penalty is 0. Devices a sequence
    never shows add their whole probability, so the sum over seen devices of
    ``|p - q| - q`` plus the sum of all ``q`` needs no device grid.
    """
    if target is None:
        return events.where(F.col("pos") == 0).select(*SEQ, F.lit(0.0).alias("distribution_penalty"))
    target = materialize(target.select("device", "p"), "distribution")
    whole = target.agg(F.sum(F.abs("p"))).scalar()
    seen = events.groupBy(*SEQ, device_key().alias("device")).agg(F.count(F.lit(1)).alias("n"))
    share = seen.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*SEQ)))
    q = F.coalesce(F.col("p"), F.lit(0.0))
    return (
        share.join(target, "device", "left")
        .groupBy(*SEQ).agg(F.sum(F.abs(F.col("share") - q) - F.abs(q)).alias("_moved"))
        .select(*SEQ, F.coalesce(0.5 * (F.col("_moved") + whole), F.lit(0.0)).alias("distribution_penalty"))
    )
