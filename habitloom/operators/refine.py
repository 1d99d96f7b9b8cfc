"""Score sequences against influence edges; filter, rank, resample, split."""

from pyspark.sql import DataFrame, Window, functions as F

from habitloom.functions.columns import SCORING_STRENGTH_FIELDS, device_key, edge_strength, seeded_uniform
from habitloom.model import SEQ
from habitloom.operators.edges import with_endpoints
from habitloom.operators.ranking import log_bucket, smallest_cutoff, uniform_bucket, with_rank, within
from habitloom.operators.sequences import earlier_device_counts, ordered_pair_counts
from habitloom.session import materialize

SCORE_MODES = ("weight", "filter", "rank")


def scoring_edges(edges: DataFrame, include_downweighted=False) -> DataFrame:
    """``(source, target, strength, normalized)`` keyed ``d:<id>``.

    The strongest non-negative value per pair, and that divided by the overall
    maximum. Written once: it is joined to sequence-sized data, and its file
    size tells Spark whether it may be broadcast.
    """
    if not include_downweighted and "guard_action" in edges.columns:
        edges = edges.where(F.coalesce(F.col("guard_action"), F.lit("")) != "downweight")
    strength = F.greatest(edge_strength(edges.columns, SCORING_STRENGTH_FIELDS), F.lit(0.0))
    pairs = (
        with_endpoints(edges)
        .groupBy(F.col("source_device_key").alias("source"), F.col("target_device_key").alias("target"))
        .agg(F.max(strength).alias("strength"))
    )
    top = F.max("strength").over(Window.partitionBy(F.lit(0)))
    normalized = F.when(top > 0, F.col("strength") / top).otherwise(F.lit(0.0))
    return materialize(pairs.withColumn("normalized", normalized), "edges")


def _with_strength(pairs, edges):
    """Left-join pairs of device ids with edges keyed ``d:<id>``."""
    ids = edges.select(
        F.regexp_extract("source", r"^d:(\d+)$", 1).try_cast("int").alias("source"),
        F.regexp_extract("target", r"^d:(\d+)$", 1).try_cast("int").alias("target"),
        "strength", "normalized",
    ).where(F.col("source").isNotNull() & F.col("target").isNotNull())
    return pairs.join(ids, ["source", "target"], "left").fillna(0.0, ["strength", "normalized"])


def consistency(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean normalized edge strength over all ordered event pairs of a sequence.

    ``edges`` comes from ``scoring_edges``. Sequences without pairs score 1.
    """
    return consistency_and_penalty(events, edges).drop("distribution_penalty")


def consistency_and_penalty(events: DataFrame, edges: DataFrame, target: DataFrame = None) -> DataFrame:
    """``consistency`` and ``compare.distribution_penalty`` of each sequence, from one pass over the events.

    The pair counts of a device with itself tell how many events it has.
    """
    pairs = _with_strength(ordered_pair_counts(events), edges)
    own = F.col("source") == F.col("target")
    of_device = F.when(own, F.col("n_sources_before_last") + 1)
    moved, whole = F.lit(None).cast("double"), F.lit(0.0)
    if target is not None:
        target = materialize(target.select("device", "p"), "distribution")
        whole = target.agg(F.sum(F.abs("p"))).scalar()
        pairs = pairs.withColumn("_events", F.sum(of_device).over(Window.partitionBy(*SEQ))) \
            .join(target, F.when(own, device_key("source")) == F.col("device"), "left")
        q = F.coalesce(F.col("p"), F.lit(0.0))
        moved = F.when(own, F.abs(of_device / F.col("_events") - q) - F.abs(q))
    return pairs.groupBy(*SEQ).agg(
        F.sum("n_pairs").alias("num_ordered_event_pairs"),
        F.sum(F.when(F.col("strength") > 0, F.col("n_pairs")).otherwise(0)).alias("num_causally_supported_pairs"),
        F.sum(F.col("n_pairs") * F.col("normalized")).alias("_sum"), F.sum(moved).alias("_moved"),
    ).select(
        *SEQ, "num_ordered_event_pairs", "num_causally_supported_pairs",
        F.when(F.col("num_ordered_event_pairs") > 0, F.col("_sum") / F.col("num_ordered_event_pairs"))
        .otherwise(F.lit(1.0)).alias("causal_consistency_score"),
        F.coalesce(0.5 * (F.col("_moved") + whole), F.lit(0.0)).alias("distribution_penalty"),
    )


def pair_detail(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Every event with the devices met before it, their counts and edge strengths.

    The pair list of a sequence in compact form: all pairs of one event with
    earlier events of one device share a strength, so they form one row.
    """
    pairs = earlier_device_counts(events).where(F.col("n_earlier") > 0).select(
        *SEQ, F.col("pos").alias("target_index"), F.col("earlier").alias("source"),
        F.col("device").alias("target"), F.col("n_earlier").alias("n_pairs"),
    )
    return _with_strength(pairs, edges).select(
        *SEQ, "target_index", "source", "target", "n_pairs",
        F.col("strength").alias("causal_strength"), F.col("normalized").alias("normalized_causal_strength"),
    )


def sequence_scores(
    events: DataFrame, edges: DataFrame, target: DataFrame = None, losses: DataFrame = None, *,
    alpha_rec=1.0, beta_inconsistency=1.0, gamma_dist=1.0, temperature=2.0,
) -> DataFrame:
    """Final score and sample weight per sequence.

    ``alpha * loss - beta * (1 - consistency) - gamma * penalty``, and
    ``exp(score / temperature)``. ``losses`` is ``(corpus_id, seq_id, loss)``
    and has to cover the sequences: one without a row fails the job. A null
    loss counts 0 and a negative one is clipped.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    scores = consistency_and_penalty(events, edges, target)
    if losses is None:
        scores = scores.withColumn("reconstruction_loss", F.lit(None).cast("double"))
    else:
        found = losses.select(*SEQ, F.col("loss").alias("reconstruction_loss"), F.lit(True).alias("_found"))
        uncovered = F.raise_error(F.concat(F.lit("no loss for sequence "), F.concat_ws("/", *SEQ))).cast("double")
        scores = scores.join(found, list(SEQ), "left").withColumn(
            "reconstruction_loss", F.when(F.col("_found"), F.col("reconstruction_loss")).otherwise(uncovered)).drop("_found")
    term = F.greatest(F.coalesce("reconstruction_loss", F.lit(0.0)), F.lit(0.0))
    final = (
        float(alpha_rec) * term - float(beta_inconsistency) * (1.0 - F.col("causal_consistency_score"))
        - float(gamma_dist) * F.col("distribution_penalty")
    )
    return scores.withColumns({
        "causal_inconsistency": 1.0 - F.col("causal_consistency_score"), "reconstruction_term": term, "final_score": final,
    }).withColumn("sample_weight", F.exp(F.col("final_score") / float(temperature)))


def decide(scores: DataFrame, mode="weight", min_weight=0.05) -> DataFrame:
    """Add ``decision``; in ``rank`` mode also ``rank``, the best score first."""
    if mode not in SCORE_MODES:
        raise ValueError(f"mode must be one of {SCORE_MODES}")
    if mode == "rank":
        ranked = with_rank(scores, [F.desc("final_score"), F.asc("corpus_id"), F.asc("seq_id")])
        return ranked.withColumn("decision", F.lit("rank"))
    if mode == "filter":
        keep = F.when(F.col("sample_weight") >= min_weight, "keep").otherwise("delete")
        return scores.withColumn("decision", keep)
    return scores.withColumn("decision", F.lit("weight"))


def kept_sequences(events: DataFrame, decided: DataFrame) -> DataFrame:
    """Events of the sequences whose decision is ``keep``."""
    return events.join(decided.where(F.col("decision") == "keep").select(*SEQ), list(SEQ), "left_semi")


def weighted_resample(scores: DataFrame, seed=2024, max_copies=3, target_size=None) -> DataFrame:
    """Draw sequences with replacement in proportion to ``sample_weight``.

    ``(corpus_id, seq_id, copies)``; at most ``max_copies`` of each, unused ones with 0.
    ``target_size`` defaults to the number of sequences. Instead of drawing one
    by one, copy ``c`` of a sequence arrives after ``c`` exponential waits at
    rate ``weight``, and the first ``target_size`` arrivals are taken: the same
    distribution, and each sequence can tell its copies from one cutoff.
    """
    if max_copies < 1:
        raise ValueError("max_copies must be at least 1")
    if target_size is not None and target_size <= 0:
        return scores.select(*SEQ, F.lit(0).cast("bigint").alias("copies"))
    weight = F.greatest(F.coalesce("sample_weight", F.lit(0.0)), F.lit(0.0))
    weights = materialize(scores.select(*SEQ, weight.alias("_w")), "weights")  # a narrow row per sequence, read four times
    heaviest = weights.agg(F.max("_w")).scalar()
    size = F.lit(target_size) if target_size is not None else weights.agg(F.count(F.lit(1))).scalar()

    numbers = F.sequence(F.lit(1), F.lit(max_copies))
    rate = F.when(heaviest > 0, F.col("_w")).otherwise(F.lit(1.0))
    waits = F.transform(numbers, lambda c: -F.ln(seeded_uniform(seed, "corpus_id", "seq_id", c)) / F.col("_rate"))
    arrivals = F.transform(numbers, lambda c: F.struct(
        F.aggregate(F.slice("_waits", F.lit(1), c), F.lit(0.0), lambda total, wait: total + wait).alias("arrival"),
        F.col("corpus_id"), F.col("seq_id"), c.alias("copy"),
    ))
    clocks = (
        weights.withColumn("_rate", rate).where(F.col("_rate") > 0).withColumn("_waits", waits)
        .select(*SEQ, arrivals.alias("_arrivals"))
    )
    key = ["arrival", *SEQ, "copy"]
    cutoff = smallest_cutoff(
        clocks.select(F.explode("_arrivals").alias("_a")).select("_a.*"), key, log_bucket(F.col("arrival")),
        lambda total: size, error="target_size exceeds the copies available",
    )
    # A sequence's arrivals rise with the copy number: count those not after the cutoff.
    last = cutoff.select("cutoff").scalar()
    drawn = clocks.withColumn("_cutoff", last).select(
        *SEQ, F.size(F.filter("_arrivals", lambda a: a <= F.col("_cutoff"))).cast("bigint").alias("copies"),
    )
    return drawn.unionByName(weights.where((F.col("_w") <= 0) & (heaviest > 0)).select(*SEQ, F.lit(0).cast("bigint").alias("copies")))


def resampled_events(events: DataFrame, copies: DataFrame) -> DataFrame:
    """Events of the drawn corpus; copy ``c`` of a sequence is named ``<seq_id>#<c>``."""
    drawn = copies.where(F.col("copies") > 0)
    rows = events.join(drawn, list(SEQ)).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.withColumn("seq_id", F.concat_ws("#", "seq_id", "_copy")).drop("_copy", "copies")


def resample_report(copies: DataFrame, max_copies=3, seed=2024) -> DataFrame:
    return copies.agg(
        F.lit(seed).alias("seed"), F.lit(max_copies).alias("max_copies"),
        F.sum("copies").alias("resampled_size"),
        F.count_if(F.col("copies") > 1).alias("num_duplicated_sources"),
        F.count_if(F.col("copies") == 0).alias("num_unused_sources"),
    )


def consistency_summary(scores: DataFrame) -> DataFrame:
    score = F.col("causal_consistency_score")
    return scores.agg(
        F.count(F.lit(1)).alias("num_sequences"),
        *[F.coalesce(f(score), F.lit(0.0)).alias(f"{name}_causal_consistency_score")
          for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))],
    )


def _split_key(seed):
    return [seeded_uniform(seed, *SEQ).alias("u"), *[F.col(c) for c in SEQ]]


def split_cutoff(ids: DataFrame, ratio=0.8, seed=2024, by=()) -> DataFrame:
    """Where to cut the seeded order of ``ids`` so that ``floor(n * ratio)`` sequences train; with ``by``, of each group."""
    if not 0.0 < ratio < 1.0:
        raise ValueError("ratio must be between 0 and 1 (exclusive)")

    def count(total):
        too_few = F.raise_error("at least 2 sequences are needed to split").cast("bigint")
        return F.when(total < 2, too_few).otherwise(F.floor(total * F.lit(ratio)))

    return smallest_cutoff(ids.select(*by, *SEQ), _split_key(seed), uniform_bucket(seeded_uniform(seed, *SEQ)), count, by=by)


def split_part(cutoff: DataFrame, seed=2024):
    """``train`` or ``validation`` for any table with the sequence columns; needs no join."""
    return F.when(within(_split_key(seed), cutoff), "train").otherwise("validation")


def split_train_validation(ids: DataFrame, ratio=0.8, seed=2024) -> DataFrame:
    """Add ``part`` to a table with one row per sequence."""
    return ids.withColumn("part", split_part(split_cutoff(ids, ratio, seed), seed))


def split_cells(ids: DataFrame, by, ratio=0.8, seed=2024) -> DataFrame:
    """Add ``part`` to a table with one row per sequence, each group of ``by`` split by itself, all in one job.

    The cutoffs are a row per group; a group of fewer than two sequences is an error.
    """
    cutoffs = split_cutoff(ids, ratio, seed, by)
    part = F.when(F.struct(*_split_key(seed)) <= F.col("cutoff"), "train").otherwise("validation")
    return ids.join(F.broadcast(cutoffs), list(by)).withColumn("part", part).drop("cutoff")


def lock_corpus(events: DataFrame, edges: DataFrame, seed=2024, max_copies=3) -> DataFrame:
    """Resample to the same size by consistency alone (no loss, no target)."""
    scores = sequence_scores(
        events, edges, alpha_rec=0.0, beta_inconsistency=1.0, gamma_dist=0.0, temperature=1.0,
    )
    return weighted_resample(scores, seed=seed, max_copies=max_copies)
