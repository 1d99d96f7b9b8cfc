"""Registered queries: one per operator, over the given tables."""

import functools
import uuid

from pyspark.sql import functions as F

from habitloom.functions import columns as c
from habitloom.model import EVENT_COLUMNS, SEQ
from habitloom.operators import compare, descriptive, detect, edges, lineage, mining, ranking, refine, reporting, sequences, validate
from habitloom.plans import inputs, pipelines
from habitloom.session import materialize, shared_folder
from habitloom.sources import corpora, priors, reports, sinks, vocabulary
from habitloom.sources.event_log import id_in

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df, *names):
    return df.withColumns({name: F.round(name, 9) for name in names})


def whole_numbers(df, *names):
    return df.withColumns({name: F.col(name).cast("bigint") for name in names})


# Sequences and projections

@query
def sequences_from_events(spark, sf_dir):
    return inputs.events(spark, sf_dir).select(*EVENT_COLUMNS)


@query
def flat_sequences(spark, sf_dir):
    rows = sequences.events_to_flat(inputs.events(spark, sf_dir))
    return rows.select(*SEQ, "start", F.array_join("flat", ",").alias("flat"))


@query
def flatten_roundtrip(spark, sf_dir):
    return sequences.flat_to_events(sequences.events_to_flat(inputs.events(spark, sf_dir))).select(*EVENT_COLUMNS)


@query
def flatten_parts(spark, sf_dir):
    """The round trip in rows of three events, by way of files, from events numbered per second."""
    path = _folder(spark, "parts")
    corpora.write_corpus(sequences.events_to_flat(inputs.events(spark, sf_dir, per_second=True), part_events=3), path)
    return sequences.flat_to_events(corpora.read_corpus(spark, path)).select(*EVENT_COLUMNS)


@query
def pair_counts_by_part(spark, sf_dir):
    """Ordered pairs and neighbours from the plans for long sequences."""
    rows = inputs.events(spark, sf_dir, per_second=True)
    pairs = sequences.ordered_pair_counts(rows, part_events=2).select(
        *SEQ, F.lit("ordered").alias("kind"), "source", "target", F.col("n_pairs").alias("n")).where("n > 0")
    near = sequences.with_neighbour(rows, 1, 2, _next="device_id").where("_next IS NOT NULL")
    return pairs.unionByName(near.groupBy(*SEQ, F.col("device_id").alias("source"), F.col("_next").alias("target")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("adjacent")))


@query
def hourly_corpora(spark, sf_dir):
    """Graph sizes and start counts where a day falls into several corpora and some device names are unknown."""
    rows = inputs.events(spark, sf_dir, devices=inputs.DEVICES[:3], corpus_id=F.when(F.hour("ts") < 12, "morning").otherwise("evening"))
    detector = detect.Detector("device", "device_id", 4)
    starts = detect.token_steps(rows, [detector]).groupBy("corpus_id").agg(
        F.count_if(F.col("prev") == detect.START).alias("num_starts"), F.count_if(F.col("prev") == -1).alias("num_after_unknown"))
    lengths = descriptive.event_length_histogram(rows).groupBy("corpus_id").agg(F.max("length").alias("longest"))
    return descriptive.graph_size(rows).join(starts, "corpus_id").join(lengths, "corpus_id")


@query
def id_lists(spark, sf_dir):
    rows = sequences.id_lists(inputs.events(spark, sf_dir))
    return rows.select(
        *SEQ, F.array_join("device_ids", ",").alias("device_ids"), F.array_join("action_ids", ",").alias("action_ids"),
    )


@query
def time_index(spark, sf_dir):
    return inputs.events(spark, sf_dir).select(
        *SEQ, "pos", c.time_index().alias("time_index"), c.hour_of_week().alias("hour_of_week"),
    )


@query
def channel_counts(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    tables = [
        descriptive.channel_counts(rows, level, 30).withColumn("level", F.lit(level)) for level in c.CHANNEL_LEVELS
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query
def canonical_keys(spark, sf_dir):
    kind, device = F.col("event_id") % 5, F.col("user_id").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit("d:"), device)).when(kind == 1, F.concat(F.lit("device_"), device))
        .when(kind == 2, F.concat(F.lit("00"), device)).when(kind == 3, F.col("event_type"))
    )
    rows = inputs.table(spark, sf_dir, "events").select(
        "event_id", text.alias("source_device"), F.when(kind == 4, F.col("user_id")).alias("source_index"),
        F.when(kind == 0, F.col("value")).alias("guarded_weight"), F.when(kind < 3, F.col("value") + 1).alias("weight"),
        F.when(kind == 3, F.col("value") + 2).alias("causal_strength"),
    )
    return rows.select(
        "event_id", c.endpoint_key("source", rows.columns).alias("source_key"),
        c.endpoint_key("target", rows.columns).alias("target_key"),
        F.round(c.edge_strength(rows.columns), 6).alias("strength"),
        c.device_name(c.endpoint_key("source", rows.columns)).alias("name"),
    )


@query
def pad_truncate(spark, sf_dir):
    rows = sequences.padded_lists(inputs.events(spark, sf_dir), 21)
    return rows.select(
        *SEQ, F.array_join("padded", ",").alias("padded"),
        F.size(F.filter("padded", lambda x: x != 20)).alias("num_unmasked"),
    )


@query
def detector_tokens(spark, sf_dir):
    steps = detect.token_steps(inputs.events(spark, sf_dir), inputs.DETECTORS)
    return steps.select("env", *SEQ, "pos", "prev", "token")


# Description

@query
def device_distribution(spark, sf_dir):
    return rounded(descriptive.device_distribution(inputs.events(spark, sf_dir)), "p")


@query
def transition_graph(spark, sf_dir):
    names = spark.createDataFrame(list(enumerate(inputs.DEVICES[:4])), "device_id int, name string")
    return rounded(descriptive.transition_graph(inputs.events(spark, sf_dir), names), "transition_score")


@query
def graph_size(spark, sf_dir):
    return descriptive.graph_size(inputs.events(spark, sf_dir))


@query
def transition_matrix_dense(spark, sf_dir):
    """Unknown device names have no channel; the list is that of the known ones."""
    rows = inputs.events(spark, sf_dir, devices=inputs.DEVICES[:3])
    listed = spark.createDataFrame([(f"d:{i}",) for i in range(3)], "channel string")
    matrix = descriptive.transition_matrix(rows, listed)
    return rounded(descriptive.densify(matrix, listed, ["source", "target"]), "value")


@query
def precedence_matrix(spark, sf_dir):
    return rounded(descriptive.precedence_matrix(inputs.events(spark, sf_dir)), "value")


@query
def channel_order(spark, sf_dir):
    return inputs.channels(inputs.events(spark, sf_dir))


@query
def event_tensor_count(spark, sf_dir):
    return descriptive.event_tensor(inputs.events(spark, sf_dir), "action", "count")


@query
def event_tensor_binary(spark, sf_dir):
    return descriptive.event_tensor(inputs.events(spark, sf_dir), "device", "binary", min_frequency=2)


@query
def event_tensor_decay(spark, sf_dir):
    tensor = descriptive.event_tensor(inputs.events(spark, sf_dir), "device", "binary")
    return rounded(descriptive.decayed_tensor(tensor, 0.1), "value")


@query
def lag_windows(spark, sf_dir):
    return descriptive.lag_windows(descriptive.event_tensor(inputs.events(spark, sf_dir), "device", "binary"), 4)


@query
def top_successors(spark, sf_dir):
    return descriptive.top_successors(inputs.events(spark, sf_dir))


@query
def length_histogram(spark, sf_dir):
    return descriptive.event_length_histogram(inputs.events(spark, sf_dir))


# Comparison of corpora

@query
def device_kl(spark, sf_dir):
    shares = descriptive.device_distribution(inputs.events(spark, sf_dir))
    return rounded(compare.device_kl(shares, "target", "source"), "kl")


@query
def transition_similarity(spark, sf_dir):
    matrix = descriptive.transition_matrix(inputs.events(spark, sf_dir))
    return rounded(compare.matrix_similarity(matrix, "target", "source"), "similarity")


@query
def precedence_similarity(spark, sf_dir):
    matrix = descriptive.precedence_matrix(inputs.events(spark, sf_dir))
    return rounded(compare.matrix_similarity(matrix, "target", "source"), "similarity")


@query
def quality_summary(spark, sf_dir):
    return rounded(
        compare.quality_summary(inputs.events(spark, sf_dir), "target", "source"),
        "device_distribution_kl", "transition_matrix_similarity", "causal_graph_similarity",
    )


@query
def quality_by_variant(spark, sf_dir):
    table = compare.quality_by_variant(inputs.described(spark, sf_dir), "target")
    return rounded(table, "device_distribution_kl", "transition_matrix_similarity", "causal_graph_similarity")


@query
def case_study_matrices(spark, sf_dir):
    return rounded(compare.case_study_matrices(inputs.events(spark, sf_dir), ["source", "target"]), "value")


@query
def tv_penalty(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    penalty = compare.distribution_penalty(rows, inputs.shares(rows, "target"))
    return rounded(penalty, "distribution_penalty")


# Edges

@query
def standardize_edges(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    return rounded(edges.standardize_edges(inputs.mixed_edges(rows), inputs.channels(rows), 4), "weight")


@query
def named_edges(spark, sf_dir):
    names = spark.createDataFrame([(f"d:{i}", n) for i, n in enumerate(inputs.DEVICES[:4])], "device string, name string")
    top = edges.top_edges(inputs.prior(inputs.events(spark, sf_dir)), k=12)
    return rounded(edges.with_names(top, names), "weight")


@query
def edge_statistics(spark, sf_dir):
    stats = edges.edge_statistics(inputs.mixed_edges(inputs.events(spark, sf_dir)), threshold=0.1)
    return rounded(stats, *[x for x in stats.columns if x.endswith(("strength", "ratio"))])


@query
def edge_statistics_delta(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    before = materialize(inputs.prior(rows), "prior")
    after = edges.target_weighted(before, inputs.shares(rows, "target"))
    stats = edges.edge_statistics_delta(before, after)
    return rounded(stats, *[x for x in stats.columns if x != "side"])


@query
def sparsify_prior(spark, sf_dir):
    return rounded(edges.sparsify(inputs.prior(inputs.events(spark, sf_dir)), 0.05), "weight")


@query
def top_edges(spark, sf_dir):
    return rounded(edges.top_edges(inputs.prior(inputs.events(spark, sf_dir)), k=7, min_weight=0.01), "weight")


@query
def target_weighted_edges(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    weighted = edges.target_weighted(inputs.mixed_edges(rows), inputs.shares(rows, "target"))
    return rounded(weighted.select(
        "source_device_key", "target_device_key", F.round("raw_weight", 9).alias("raw_weight"),
        "source_target_probability", "target_target_probability", "target_endpoint_weight", "target_adapted_weight",
    ), "source_target_probability", "target_target_probability", "target_endpoint_weight", "target_adapted_weight")


@query
def target_weighted_matrix(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    return rounded(edges.target_weighted_matrix(inputs.prior(rows), inputs.shares(rows, "target")), "weight")


def _guarded(spark, sf_dir, **options):
    rows = inputs.events(spark, sf_dir)
    observed, target = inputs.shares(rows, "source"), inputs.shares(rows, "target")
    return edges.overuse_guard(inputs.prior(rows), observed, target, max_overuse_ratio=1.0, **options)


_GUARD_COLUMNS = (
    "source_device_key", "target_device_key", "raw_weight", "guarded_weight", "guard_action",
    "source_overused", "target_overused", "source_overuse_ratio", "target_overuse_ratio",
)


@query
def overuse_guard_suppress(spark, sf_dir):
    guarded = _guarded(spark, sf_dir, mode="suppress").select(*_GUARD_COLUMNS, "guard_reason")
    return rounded(guarded, "raw_weight", "guarded_weight", "source_overuse_ratio", "target_overuse_ratio")


@query
def overuse_guard_downweight(spark, sf_dir):
    guarded = _guarded(spark, sf_dir, mode="downweight", endpoint_policy="source_or_target").select(*_GUARD_COLUMNS)
    return rounded(guarded, "raw_weight", "guarded_weight", "source_overuse_ratio", "target_overuse_ratio")


@query
def overused_devices(spark, sf_dir):
    return rounded(edges.overused_devices(_guarded(spark, sf_dir)), "observed_freq", "target_freq", "ratio")


@query
def guard_counts(spark, sf_dir):
    return edges.guard_counts(_guarded(spark, sf_dir, endpoint_policy="both"))


def _fused(spark, sf_dir, causal=None, **options):
    """The source graph over three known device names, and influence over all five: ends are missing on both sides."""
    rows = inputs.only(inputs.events(spark, sf_dir), "source")
    known = inputs.only(inputs.events(spark, sf_dir, devices=inputs.DEVICES[:3]), "source")
    if causal is None:
        causal = materialize(inputs.prior(rows).withColumn("lag", F.lit(4)), "prior")
    graph = materialize(descriptive.transition_graph(known), "graph")
    return edges.fuse_edges(graph, causal, lambda_causal=0.5, **options), graph, causal


_FUSED_NUMBERS = (
    "transition_score", "normalized_transition_score", "raw_causal_strength", "causal_strength",
    "normalized_causal_strength", "final_score",
)


@query
def fuse_multiplicative(spark, sf_dir):
    return rounded(_fused(spark, sf_dir, mode="multiplicative", add_causal_edges=True)[0], *_FUSED_NUMBERS)


@query
def fuse_additive(spark, sf_dir):
    return rounded(_fused(spark, sf_dir, mode="additive", top_k=10)[0], *_FUSED_NUMBERS)


@query
def fuse_summary(spark, sf_dir):
    fused, graph, causal = _fused(spark, sf_dir, add_causal_edges=True)
    return rounded(edges.fusion_summary(fused, graph, causal), "avg_causal_strength")


@query
def fuse_unclean(spark, sf_dir):
    """Influence edges with unknown ends, repeated pairs and weaker copies give what the clean ones give."""
    rows = inputs.only(inputs.events(spark, sf_dir), "source")
    clean = materialize(inputs.prior(rows).withColumn("lag", F.lit(4)), "prior")
    weaker = clean.withColumns({"weight": F.col("weight") / 2, "lag": F.lit(3)})
    nowhere = clean.withColumns({"source": F.lit(None).cast("string"), "weight": F.col("weight") * 9})
    causal = clean.unionByName(weaker).unionByName(clean).unionByName(nowhere)
    return rounded(_fused(spark, sf_dir, causal, mode="multiplicative", add_causal_edges=True)[0], *_FUSED_NUMBERS)


@query
def hints_source_only(spark, sf_dir):
    rows = inputs.only(inputs.events(spark, sf_dir), "source")
    hints = pipelines.generation_hints(rows, materialize(inputs.prior(rows), "prior"))
    return rounded(hints.select("source_device_key", "target_device_key", "count", *_FUSED_NUMBERS), *_FUSED_NUMBERS)


@query
def hints_target_assisted(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    hints = pipelines.generation_hints(
        inputs.only(rows, "source"), inputs.prior(rows), inputs.only(rows, "target"),
        guard={"max_overuse_ratio": 1.0, "mode": "downweight"},
    )
    return rounded(hints.select("source_device_key", "target_device_key", "count", *_FUSED_NUMBERS), *_FUSED_NUMBERS)


# Refinement

def _scoring_edges(rows):
    return refine.scoring_edges(inputs.prior(rows))


@query
def ordered_pairs(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    return rounded(refine.pair_detail(rows, _scoring_edges(rows)), "causal_strength", "normalized_causal_strength")


@query
def causal_consistency(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    return rounded(refine.consistency(rows, _scoring_edges(rows)), "causal_consistency_score")


@query
def consistency_summary(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    summary = refine.consistency_summary(refine.consistency(rows, _scoring_edges(rows)))
    return rounded(summary, *[x for x in summary.columns if x.endswith("score")])


@query
def guarded_scoring(spark, sf_dir):
    """Consistency without the edges that the guard has weakened."""
    edges_left = refine.scoring_edges(_guarded(spark, sf_dir, mode="downweight"))
    return rounded(refine.consistency(inputs.events(spark, sf_dir), edges_left), "causal_consistency_score")


def _scores(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    return refine.sequence_scores(
        rows, _scoring_edges(rows), inputs.shares(rows, "target"), inputs.losses(rows),
        alpha_rec=0.5, beta_inconsistency=1.5, gamma_dist=0.8, temperature=2.0,
    )


_SCORE_NUMBERS = (
    "causal_consistency_score", "causal_inconsistency", "distribution_penalty", "reconstruction_loss",
    "reconstruction_term", "final_score", "sample_weight",
)


@query
def causal_tof_scores(spark, sf_dir):
    return rounded(_scores(spark, sf_dir), *_SCORE_NUMBERS)


@query
def causal_tof_filter(spark, sf_dir):
    decided = refine.decide(_scores(spark, sf_dir), "filter", min_weight=0.5)
    return rounded(decided.select(*SEQ, "sample_weight", "decision"), "sample_weight")


@query
def causal_tof_rank(spark, sf_dir):
    """The score is rounded before ranking, so that ties do not hang on the last bit."""
    ranked = refine.decide(rounded(_scores(spark, sf_dir), "final_score"), "rank")
    return ranked.select(*SEQ, "final_score", "rank", "decision")


@query
def weighted_resample(spark, sf_dir):
    copies = refine.weighted_resample(_scores(spark, sf_dir), seed=7, max_copies=2)
    return copies.where(F.col("copies") > 0)


@query
def resample_report(spark, sf_dir):
    return refine.resample_report(refine.weighted_resample(_scores(spark, sf_dir), seed=7, max_copies=3), 3, 7)


@query
def corpus_lock(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    copies = refine.lock_corpus(rows, _scoring_edges(rows))
    return sequences.events_to_flat(refine.resampled_events(rows, copies)).select(
        *SEQ, F.array_join("flat", ",").alias("flat"),
    )


@query
def train_validation_split(spark, sf_dir):
    ids = inputs.events(spark, sf_dir).where(F.col("pos") == 0).select(*SEQ)
    return refine.split_train_validation(ids, 0.8, 2024)


# Detection

def _losses(spark, sf_dir, env):
    detector = [d for d in inputs.DETECTORS if d.env == env]
    steps = detect.token_steps(inputs.events(spark, sf_dir), detector)
    model = detect.fit_markov(steps.where(F.col("corpus_id") == "source"))
    return detect.sequence_losses(steps, model)


@query
def markov_loss_action(spark, sf_dir):
    return rounded(_losses(spark, sf_dir, "spring"), "loss")


@query
def markov_loss_slot(spark, sf_dir):
    return rounded(_losses(spark, sf_dir, "night"), "loss")


@query
def markov_loss_device(spark, sf_dir):
    return rounded(_losses(spark, sf_dir, "multiple"), "loss")


@query
def loss_summary(spark, sf_dir):
    return rounded(detect.loss_summary(_losses(spark, sf_dir, "spring"), ("env", "corpus_id")), "loss_avg", "loss_min", "loss_max")


@query
def iqr_outliers(spark, sf_dir):
    split = detect.iqr_outliers(_losses(spark, sf_dir, "multiple"))
    return rounded(split.select("env", *SEQ, "loss", "upper_fence", "is_outlier"), "loss", "upper_fence")


@query
def utility_readmission(spark, sf_dir):
    filtered = pipelines.filter_corpus(inputs.events(spark, sf_dir), inputs.DETECTORS[2])
    return rounded(filtered.select(*SEQ, "is_outlier", "readmit", "kept", "loss_change"), "loss_change")


@query
def wide_percentiles(spark, sf_dir):
    """Percentiles of numbers of either sign over twelve decades."""
    orders = inputs.table(spark, sf_dir, "orders")
    power = F.element_at(F.array(*[F.lit(10.0 ** k) for k in range(-6, 6)]), (F.col("o_orderkey") % 12 + 1).cast("int"))
    sign = F.when(F.col("o_orderkey") % 5 == 0, -1.0).otherwise(1.0)
    values = orders.select(F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") * power * sign).alias("value"))
    found = ranking.exact_percentiles(values, "value", {"p05": 0.05, "p50": 0.5, "p955": 0.955, "most": 1.0}, by=["priority"])
    return found.select("priority", *[F.round(c, 3).alias(c) for c in ("p05", "p50", "p955", "most")])


@query
def sparse_vocabulary(spark, sf_dir):
    """Checks against a vocabulary whose ids lie two thousand millions apart."""
    far = lambda c: F.when(F.col(c) % 2 == 1, F.col(c) + 2_000_000_000).otherwise(F.col(c))
    rows = inputs.events(spark, sf_dir).withColumn("action_id", far("action_id").cast("int"))
    devices = spark.createDataFrame([(i, f"D{i}") for i in range(5)], "device_id int, name string")
    actions = spark.range(0, 16).select(F.col("id").cast("int").alias("action_id"), F.concat(F.lit("D"), F.floor(F.col("id") / 4).cast("string"), F.lit(":x")).alias("name"))
    checked = validate.with_reasons(sequences.events_to_flat(rows), devices, actions.withColumn("action_id", far("action_id").cast("int")))
    return checked.select(*SEQ, F.array_join("reasons", ",").alias("reasons"))


@query
def loss_threshold(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    steps = detect.token_steps(rows, inputs.DETECTORS)
    model = detect.fit_markov(steps.where(F.col("corpus_id") == "source"))
    return rounded(detect.loss_thresholds(detect.sequence_losses(steps, model), inputs.DETECTORS), "threshold")


@query
def labelled_rows(spark, sf_dir):
    """Normal rows and attack rows stored apart and read as one labelled test set."""
    normal, attack = _folder(spark, "normal"), _folder(spark, "attack")
    rows = inputs.attacked(inputs.events(spark, sf_dir))
    flat = sequences.events_to_flat(rows, keep=["env", "label"]).select(F.concat_ws("/", "env", "seq_id").alias("seq_id"), "flat", "label")
    flat.where("label = 0").select("seq_id", "flat", F.lit(7).alias("label")).write.parquet(normal)
    flat.where("label = 1").write.parquet(attack)
    stored = corpora.read_labelled(spark, normal, attack).withColumn("way", F.lit("stored"))
    tables = corpora.labelled(flat.where("label = 0").drop("label"), flat.where("label = 1").drop("label")).withColumn("way", F.lit("tables"))
    return stored.unionByName(tables).select("way", "seq_id", F.array_join("flat", ",").alias("flat"), "label")


@query
def flat_detector_tokens(spark, sf_dir):
    """A detector over whole events, 40 numbers of each sequence, as the filter takes."""
    detector = detect.Detector("filter", detect.FLAT, 40, max_tokens=40)
    return detect.token_steps(inputs.events(spark, sf_dir), [detector]).select("env", *SEQ, "pos", "prev", "token")


@query
def anomaly_eval(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    scores = pipelines.evaluate_detectors(inputs.only(rows, "source"), inputs.attacked(rows), inputs.DETECTORS)
    return rounded(scores, "precision", "recall", "accuracy", "f1", "fpr", "fnr")


@query
def anomaly_eval_cells(spark, sf_dir):
    """Every dataset, env, seed and variant in one job."""
    rows = inputs.events(spark, sf_dir)
    # All sequences are tested in both variants.
    scores = pipelines.evaluate_cells(
        inputs.only(rows, "source"), inputs.attacked(rows), inputs.DETECTORS, train_cells=inputs.cells_of(), test_cells=inputs.cells_of(every=True))
    return rounded(scores, "precision", "recall", "accuracy", "f1", "fpr", "fnr")


@query
def train_validation_split_cells(spark, sf_dir):
    ids = pipelines.in_cell(inputs.in_cells(inputs.only(inputs.events(spark, sf_dir), "source").where(F.col("pos") == 0).select(*SEQ)))
    return refine.split_cells(ids, pipelines.CELL, 0.8, 2024)


@query
def cell_parameters(spark, sf_dir):
    raw = inputs.metric_rows(spark, sf_dir).select("dataset", reporting.env_of("scenario").alias("env"))
    counts = raw.groupBy("dataset", "env").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(detect.cell_parameters(spark), ["dataset", "env"])


# Validation

@query
def lenient_filter(spark, sf_dir):
    return validate.lenient(inputs.faulty_corpus(spark, sf_dir)).select(*SEQ, F.array_join("flat", ",").alias("flat"))


@query
def validate_sequences(spark, sf_dir):
    checked = validate.with_reasons(inputs.faulty_corpus(spark, sf_dir), *inputs.validation_vocabulary(spark), expected_length=12)
    return checked.select(*SEQ, F.array_join("reasons", ";").alias("reasons"))


@query
def validation_report(spark, sf_dir):
    checked = validate.with_reasons(inputs.faulty_corpus(spark, sf_dir), *inputs.validation_vocabulary(spark))
    return rounded(validate.validation_report(checked, 1000), "duplicate_rate")


# Reporting

@query
def variant_dimension(spark, sf_dir):
    raw = inputs.metric_rows(spark, sf_dir).select(F.get(F.split("file_path", "/"), F.lit(2)).alias("run"), "variant", "dataset", "scenario")
    known = raw.join(reporting.variant_dimension(spark), "variant")
    return known.withColumn("cell", reporting.cell_key("dataset", "scenario")).drop("dataset", "scenario")


@query
def typed_metrics(spark, sf_dir):
    rows = reporting.typed_metric_rows(inputs.metric_rows(spark, sf_dir))
    return rounded(rows.select(
        "dataset", "scenario", "seed", "variant", "input_pkl", "used_causal_gss", "train_size",
        "precision", "recall", "f1", "threshold", "run_dir", "metrics_path",
    ), "precision", "f1")


def _kept(spark, sf_dir):
    return reporting.kept_rows(reporting.typed_metric_rows(inputs.metric_rows(spark, sf_dir)))


@query
def per_seed_results(spark, sf_dir):
    rows = reporting.in_report_order(_kept(spark, sf_dir))
    return rounded(rows.select("dataset", "scenario", "seed", "variant", "f1", "metrics_path"), "f1")


@query
def ablation_pivot(spark, sf_dir):
    table = reporting.ablation_table(_kept(spark, sf_dir))
    return rounded(table, *[x for x in table.columns if x.endswith("_f1")])


@query
def normalized_metrics(spark, sf_dir):
    key = F.col("o_orderkey")
    payloads = inputs.table(spark, sf_dir, "orders").select(
        F.get(F.array(*[F.lit(d) for d in reporting.DATASETS]), (key % 3).cast("int")).alias("dataset"),
        F.get(F.array(F.lit("st"), F.lit("night"), F.lit("multiple")), (F.col("o_custkey") % 3).cast("int")).alias("scenario"),
        key.alias("seed"), F.when(key % 2 == 0, "ablation_no_causal_tof").otherwise("zero_target_full").alias("variant"),
        (key % 10 == 0).alias("dry_run"), (key % 7).alias("tp"), (key % 5).alias("tn"), (key % 3).alias("fp"), (key % 4).alias("fn"),
        *[F.lit(None).cast("double").alias(x) for x in ("precision", "recall", "f1", "accuracy")],
        F.col("o_totalprice").alias("threshold"),
    )
    sizes = {
        "train_size": key % 100, "vld_size": key % 50, "test_size": key % 25, "synthetic_size": key % 1000, "current_size": key % 90,
        "filtered_size": F.when(key % 4 == 0, key % 80), "report_before": key % 200, "report_after": key % 150,
    }
    payloads = payloads.join(inputs.table(spark, sf_dir, "orders").select(
        key.alias("seed"), F.concat(F.lit("runs/"), key.cast("string")).alias("run_dir"), F.lit("cpu").alias("device"),
        F.when(key % 3 == 0, "own").alias("generator"), *[x.alias(name) for name, x in sizes.items()],
    ), "seed")
    rows = reporting.normalized_metrics(payloads, detect.cell_parameters(spark))
    return rounded(rows.select(
        "status", "dataset", "scenario", "seed", "variant", "env", "fpr", "fnr", "threshold", "threshold_source", "train_size", "validation_size",
        "test_size", "generated_size", "device", "requested_device", "metrics_path", "generator", "generation_model", "manual_generation",
        "input_stage", "used_causal_gss", "used_causal_tof", "num_generated_before_tof", "num_generated_after_gen_tof", "num_generated_after_causal_tof",
    ).withColumn("requested_device", F.col("requested_device").cast("string")), "fpr", "fnr")


@query
def provenance(spark, sf_dir):
    """Every third run has a generation report beside it."""
    runs = inputs.metric_rows(spark, sf_dir).select(F.regexp_replace("file_path", r"\.json$", "").alias("run_dir"), "dataset")
    number = F.regexp_extract("run_dir", r"(\d+)$", 1).cast("bigint")
    found = runs.where(number % 3 == 0).select(
        "run_dir", F.lit("replay").alias("generator"), F.when(number % 2 == 0, "m1").alias("generation_model"), F.lit(False).alias("manual_generation"))
    return reporting.with_provenance(runs, found)


@query
def result_integrity(spark, sf_dir):
    """Some documents can't be read; customers without an order are seed folders without any result."""
    results = inputs.placed_results(spark, sf_dir)
    key = F.regexp_extract("path", r"(\d+)\.json$", 1).cast("bigint")
    results = results.withColumn("_corrupt_record", F.when(key % 21 == 0, F.lit("{")))
    folders = inputs.table(spark, sf_dir, "customer").select(
        F.concat(F.get(F.array(*[F.lit(d) for d in reporting.DATASETS]), (F.col("c_custkey") % 3).cast("int")), F.lit("_st")).alias("cell"),
        (F.col("c_custkey") % 700).alias("seed"))
    return reporting.result_issues(results, folders)


@query
def asset_grid(spark, sf_dir):
    """Which of the files that the nine cells need exist: here, one per dataset and environment of the orders."""
    templates = {
        "train": ("{dataset}/{env}/trn", True), "test": ("{dataset}/{env}/test", True), "spare": ("{dataset}/{env}/spare", False),
        "other": ("{dataset}_{scenario}/other", True),
    }
    key = F.col("o_orderkey")
    kind = F.get(F.array(F.lit("trn"), F.lit("test"), F.lit("spare")), (key % 3).cast("int"))
    env = F.get(F.array(F.lit("spring"), F.lit("night")), (F.col("o_custkey") % 2).cast("int"))
    dataset = F.get(F.array(F.lit("fr"), F.lit("us")), (F.floor(key / 4) % 2).cast("int"))
    files = inputs.table(spark, sf_dir, "orders").groupBy(F.concat_ws("/", dataset, env, kind).alias("path")).agg(F.count(F.lit(1)).alias("num_rows"))
    expected = reporting.expected_assets(spark, templates)
    absent = reporting.missing_assets(files, expected.where("required")).select("path", F.lit(True).alias("reported_missing"))
    return reporting.asset_report(files, expected).join(absent, "path", "left").fillna(False, ["reported_missing"])


@query
def stage_funnel(spark, sf_dir):
    """Corpus sizes before the filter, after it, and after the consistency filter."""
    rows = inputs.events(spark, sf_dir)
    filtered = pipelines.filter_corpus(rows, inputs.DETECTORS[2]).select(*SEQ, "kept")
    scored = refine.decide(refine.sequence_scores(rows, _scoring_edges(rows), gamma_dist=0.0), "filter", min_weight=0.62)
    both = filtered.join(scored.select(*SEQ, "decision"), list(SEQ))
    stages = F.array_compact(F.array(
        F.lit("before_filter"), F.when(F.col("kept"), F.lit("after_filter")),
        F.when(F.col("kept") & (F.col("decision") == "keep"), F.lit("after_consistency")),
    ))
    staged = both.select(F.lit("zero_target_full").alias("variant"), F.explode(stages).alias("stage"))
    return reporting.stage_funnel(staged, ["before_filter", "after_filter", "after_consistency"])


@query
def variant_comparison(spark, sf_dir):
    """Each detector taken as a variant, next to the quality figures of the corpus attacked for it."""
    rows = inputs.events(spark, sf_dir)
    scores = pipelines.evaluate_detectors(inputs.only(rows, "source"), inputs.attacked(rows), inputs.DETECTORS)
    quality = compare.quality_by_variant(inputs.described(spark, sf_dir).where(F.col("corpus_id") != "source"), "target")
    quality = quality.withColumn("variant", F.substring_index("variant", ":", -1))
    table = reporting.variant_comparison(scores.withColumnRenamed("env", "variant"), quality)
    return rounded(table, *[x for x in table.columns if x != "variant"])


# Lineage

@query
def stage_lineage(spark, sf_dir):
    return lineage.stage_lineage(inputs.lineage_events(spark, sf_dir))


@query
def stage_files(spark, sf_dir):
    return lineage.stage_files(inputs.lineage_events(spark, sf_dir))


@query
def boundary_violations(spark, sf_dir):
    return lineage.boundary_violations(inputs.lineage_events(spark, sf_dir))


@query
def merged_lineage(spark, sf_dir):
    return lineage.merged_events(inputs.lineage_events(spark, sf_dir)).select("variant", "stage", "event_index", "merged_index", "path")


@query
def variant_lineage(spark, sf_dir):
    return lineage.variant_lineage(lineage.stage_lineage(inputs.lineage_events(spark, sf_dir)))


@query
def feedback_check(spark, sf_dir):
    return lineage.feedback_paths(inputs.lineage_events(spark, sf_dir))


# Mining, and files written from the tables and read back

@query
def lag_moments(spark, sf_dir):
    """The sums that the miner solves its model from, over the device cells of a week."""
    tensor = descriptive.event_tensor(inputs.events(spark, sf_dir), "device", "binary")
    cells = tensor.select(*SEQ, "slot", F.substring("channel", 3, 9).cast("int").alias("channel_index"), "value")
    return mining.lag_moments(cells, 4)


@query
def mined_prior(spark, sf_dir):
    return mining.mine_prior(inputs.only(inputs.events(spark, sf_dir), "source")).withColumn("weight", F.round("weight", 6))


@query
def mined_action_equations(spark, sf_dir):
    """The weights of all actions put back into their normal equations: the covariances of places and targets again."""
    rows = inputs.only(inputs.events(spark, sf_dir), "source")
    tensor = materialize(descriptive.event_tensor(rows, "action", "binary"), "tensor")
    channels = materialize(descriptive.channels_in_order(tensor.select("channel")), "channels")
    system = mining.normal_equations(mining.activity_cells(tensor, channels), channels, rows.where("pos = 0").count())
    return system.applied(system.solve(), "weight", "value").select("back", "source", "target", F.round("value", 8).alias("value"))


def _folder(spark, label):
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query
def jsonl_scan(spark, sf_dir):
    path = _folder(spark, "generated")
    rows = sequences.events_to_flat(inputs.events(spark, sf_dir))
    rows.select(F.col("seq_id").alias("sequence_id"), "start", F.col("flat").alias("sequence"), F.lit("").alias("notes")).write.json(path)
    return corpora.read_generated(spark, path).select("sequence_id", "start", F.array_join("sequence", ",").alias("sequence"), "problem")


@query
def jsonl_faults(spark, sf_dir):
    """Lines of every kind of fault among good and blank ones, by file, line number and reason."""
    path = _folder(spark, "faulty")
    rows = sequences.events_to_flat(inputs.events(spark, sf_dir))
    kind, flat = F.conv(F.substring(F.md5("seq_id"), 1, 2), 16, 10).cast("int") % 9, F.array_join("flat", ",")
    sequence = F.when(kind == 1, "7").when(kind == 2, '"7"').when(kind == 3, "{}").when(kind == 4, "true").when(kind == 5, "1.5") \
        .when(kind == 6, F.concat(F.lit("["), flat, F.lit(',"x"]'))).otherwise(F.concat(F.lit("["), flat, F.lit("]")))
    whole = F.concat(F.lit('{"sequence_id":"'), F.col("seq_id"), F.lit('","sequence":'), sequence, F.lit("}"))
    line = F.when(kind == 0, "  ").when(kind == 7, F.concat(F.lit("broken "), F.col("seq_id"))) \
        .when((kind == 8) & (F.size("flat") == 4), F.concat(F.lit('{"sequence_id":"'), F.col("seq_id"), F.lit('"}'))).otherwise(whole)
    rows.repartition("corpus_id").sortWithinPartitions("corpus_id", "seq_id").select("corpus_id", line.alias("value")).write.partitionBy("corpus_id").text(path)
    found = corpora.read_generated(spark, path).where(F.col("problem").isNotNull())
    return found.select(F.regexp_extract("file_path", "corpus_id=([^/]+)/", 1).alias("file"), "line_number", "problem", "sequence_id", "line")


@query
def vocabulary_scan(spark, sf_dir):
    """Device names of the log written as one ``{name: id}`` document and read back."""
    path = _folder(spark, "vocabulary")
    names = inputs.table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    entry = F.struct("name", id_in(inputs.DEVICES, F.col("name")).alias("id"))
    document = names.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("devices"))).alias("value"))
    document.coalesce(1).write.text(path)
    return vocabulary.read_id_names(spark, path, "devices")


@query
def action_vocabulary(spark, sf_dir):
    """Action names of the log with their devices; each device's last action is listed as one that switches off."""
    names = F.array(*[F.lit(name) for name in inputs.DEVICES[:4]])
    met = inputs.events(spark, sf_dir).select("device_id", "action_id").distinct()
    device = F.coalesce(F.get(names, F.col("device_id")), F.lit("Nothing"))
    actions = met.select(F.col("action_id").alias("id"), F.concat_ws(":", device, F.col("action_id") % 4).alias("name"))
    devices = spark.createDataFrame(list(enumerate(inputs.DEVICES[:4])), "id int, name string")
    return vocabulary.action_table(actions, devices, actions.where(F.col("name").endswith(":3")).select("name"))


@query
def corpus_scan(spark, sf_dir):
    path = _folder(spark, "corpus")
    corpora.write_corpus(sequences.events_to_flat(inputs.events(spark, sf_dir)), path)
    return corpora.read_corpus(spark, path).select(*SEQ, "start", F.array_join("flat", ",").alias("flat"))


def _matrix_text(rows, path, fields=(), as_csv=False):
    """Write the dense precedence matrix of ``rows``, one corpus, as one JSON or CSV document."""
    corpus = "all"
    rows = rows.withColumn("corpus_id", F.lit(corpus))
    listed = inputs.channels(rows)
    dense = descriptive.densify(descriptive.precedence_matrix(rows), listed, [corpus])
    by_row = dense.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("target", "value"))), lambda x: x["value"]).alias("row"))
    matrix = by_row.agg(F.transform(F.sort_array(F.collect_list(F.struct("source", "row"))), lambda x: x["row"]).alias("matrix"))
    if as_csv:
        text = F.array_join(F.transform("matrix", lambda row: F.array_join(F.transform(row, lambda x: x.cast("string")), ",")), "\n")
    else:
        text = F.to_json(F.struct("matrix", *fields)) if fields else F.to_json("matrix")
    matrix.select(text.alias("value")).coalesce(1).write.text(path)


@query
def prior_scan(spark, sf_dir):
    """Both halves as prior documents; that of the target lists its own strongest edges, by name and by number."""
    rows, found = inputs.events(spark, sf_dir), []
    names = F.array(*[F.lit(f"d:{i}") for i in range(5)]).alias("channel_to_key")
    own = F.array(*[F.struct(
        F.lit(source).alias("source"), F.lit(index).cast("int").alias("source_index"), F.lit("d:4").alias("target"), F.lit(weight).alias("raw_weight"),
    ) for source, index, weight in (("d:1", None, 0.75), ("", 2, 0.5))]).alias("top_causal_edges")
    for corpus in ("source", "target"):
        path = _folder(spark, "prior")
        _matrix_text(inputs.only(rows, corpus), path, [names, F.lit(3).alias("lag"), *([own] if corpus == "target" else [])])
        prior = priors.resolve_prior(spark, prior_path=path)
        for kind in ("cells", "edges"):
            found.append(getattr(prior, kind).select(F.lit(corpus).alias("corpus_id"), F.lit(kind).alias("kind"), "*"))
    return rounded(functools.reduce(lambda a, b: a.unionByName(b), found), "weight")


@query
def matrix_scan(spark, sf_dir):
    """Both halves as bare matrices, one in JSON and one in CSV, resolved to priors."""
    rows, found = inputs.events(spark, sf_dir), []
    for corpus, end in (("source", ".json"), ("target", ".csv")):
        path = _folder(spark, "matrix") + end
        _matrix_text(inputs.only(rows, corpus), path, as_csv=end == ".csv")
        prior = priors.resolve_prior(spark, matrix_path=path)
        found += [getattr(prior, kind).select(F.lit(corpus).alias("corpus_id"), F.lit(kind).alias("kind"), "*") for kind in ("cells", "edges")]
    return rounded(functools.reduce(lambda a, b: a.unionByName(b), found), "weight")


@query
def mined_route(spark, sf_dir):
    """A prior from source events by a miner given by the caller, its five strongest edges as the top ones."""
    def miner(events, level, lag, sparse_threshold):
        return edges.sparsify(inputs.prior(events), sparse_threshold)

    prior = priors.resolve_prior(spark, source_events=inputs.events(spark, sf_dir), miner=miner, k=5)
    both = prior.cells.withColumn("kind", F.lit("cells")).unionByName(prior.edges.withColumn("kind", F.lit("edges")))
    return rounded(both, "weight")


@query
def successor_scan(spark, sf_dir):
    found = []
    for corpus in ("source", "target"):
        path = _folder(spark, "successors")
        top = descriptive.top_successors(inputs.only(inputs.events(spark, sf_dir), corpus))
        follower = F.when(F.col("next_action").isNotNull(), F.struct(F.col("rank"), F.col("next_action").cast("string").alias("next_action"), F.col("count")))
        entries = top.groupBy("action").agg(F.sort_array(F.collect_list(follower)).alias("_f")).select(
            F.struct(
                F.col("action").cast("string"),
                F.struct(F.lit("most common next actions").alias("message"), F.transform("_f", lambda x: F.struct(x["next_action"].alias("next_action"), x["count"].alias("count"))).alias("transitions")),
            ).alias("_e")
        )
        entries.agg(F.to_json(F.map_from_entries(F.collect_list("_e"))).alias("value")).coalesce(1).write.text(path)
        found.append(whole_numbers(priors.read_successors(spark, path, corpus), "rank"))
    return found[0].unionByName(found[1])


@query
def metrics_scan(spark, sf_dir):
    root = _folder(spark, "metrics")
    inputs.metric_rows(spark, sf_dir).withColumn("metrics_path", F.col("file_path")).drop("file_path").write.json(root + "/run")
    rows = reporting.typed_metric_rows(reports.read_metrics(spark, root, "*.json", lines=True))
    return rounded(rows.select("dataset", "scenario", "seed", "variant", "f1", "train_size", "metrics_path"), "f1")


@query
def quality_scan(spark, sf_dir):
    root = _folder(spark, "quality")
    summary = compare.quality_summary(inputs.events(spark, sf_dir), "target", "source").withColumn("variant", F.lit("baseline"))
    sinks.write_json(summary.coalesce(1), root + "/generation_quality/baseline/")
    rows = reports.read_quality(spark, root, "*.json", lines=True)
    return rounded(rows.select("variant", "num_target_sequences", "device_distribution_kl", "causal_graph_similarity"), "device_distribution_kl", "causal_graph_similarity")


@query
def lineage_scan(spark, sf_dir):
    """A stage is written as documents of up to 1,000 events, so that no document is unbounded."""
    root = _folder(spark, "lineage")
    entry = F.struct(*[F.col(x) for x in ("event_index", "operation", "path", "target_normal", "target_attack")])
    keys = ["variant", "stage", "stage_order", "purpose", "status"]
    (
        inputs.lineage_events(spark, sf_dir).groupBy(*keys, F.floor(F.col("event_index") / 1000).alias("_document"))
        .agg(F.collect_list(entry).alias("open_events")).drop("_document").write.json(root)
    )
    return reports.read_lineage(spark, root, lines=True)


@query
def loss_scan(spark, sf_dir):
    path = _folder(spark, "losses")
    values = F.transform(F.sort_array(F.collect_list(F.struct("env", "token", "prev", "n"))), lambda x: x["n"].cast("double"))
    steps = detect.token_steps(inputs.events(spark, sf_dir), inputs.DETECTORS)
    pairs = steps.groupBy("env", "token", "prev").agg(F.count(F.lit(1)).alias("n"))
    pairs.agg(F.to_json(F.struct(values.alias("reconstruction_losses"))).alias("value")).coalesce(1).write.text(path)
    return corpora.read_losses(spark, path)


@query
def csv_sink(spark, sf_dir):
    path = _folder(spark, "table")
    sinks.write_csv(_kept(spark, sf_dir), path, ["dataset", "scenario", "seed", "variant", "train_size", "not_there"])
    return spark.read.schema("dataset string, scenario string, seed bigint, variant string, train_size bigint, not_there string").option("header", True).csv(path)


@query
def json_sink(spark, sf_dir):
    path = _folder(spark, "json")
    odd = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    sinks.write_json(inputs.table(spark, sf_dir, "events").select("event_id", odd.alias("value")), path)
    return spark.read.schema("event_id bigint, value double").json(path)


def _texts(rows, path):
    """One small text file per device: how often each of its actions was met, in order."""
    counts = rows.groupBy("device_id", "action_id").agg(F.count(F.lit(1)).alias("n"))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("action_id", "n"))), lambda x: F.concat_ws(":", x["action_id"], x["n"])), " ")
    counts.groupBy("device_id").agg(line.alias("value")).coalesce(1).write.partitionBy("device_id").text(path)


def _inventory(spark, path):
    """The files of ``_texts`` under their folder's name: Spark gives the files themselves new names each time."""
    return reports.file_inventory(spark, path).withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))


@query
def file_manifest(spark, sf_dir):
    path = _folder(spark, "manifest")
    _texts(inputs.events(spark, sf_dir), path)
    return _inventory(spark, path)


@query
def manifest_digest(spark, sf_dir):
    path = _folder(spark, "manifest")
    _texts(inputs.events(spark, sf_dir), path)
    return reports.manifest_digest(_inventory(spark, path))


@query
def snapshot_difference(spark, sf_dir):
    """Before, three device names are known, later all five: files change, come and go; the click file stays."""
    before, after = _folder(spark, "before"), _folder(spark, "after")
    rows = inputs.events(spark, sf_dir)
    _texts(inputs.events(spark, sf_dir, devices=inputs.DEVICES[:3]), before)
    _texts(rows.where((F.col("device_id") != 1) | (F.col("corpus_id") == "source")), after)
    return lineage.manifest_differences(_inventory(spark, before), _inventory(spark, after))
