"""End-to-end pipelines over operators.

What several jobs of a pipeline read is written once (see ``session.materialize``):
small fitted tables, one row per sequence, and the counted steps of sequences.
"""

from pyspark.sql import DataFrame, functions as F

from habitloom.model import SEQ
from habitloom.operators.descriptive import device_distribution, transition_graph
from habitloom.operators.detect import (
    START, cell_thresholds, classify, confusion, counted_steps, fit_markov, iqr_outliers, loss_thresholds, sequence_losses, token_steps, utility_change,
)
from habitloom.operators.edges import fuse_edges, overuse_guard, target_weighted
from habitloom.operators.refine import split_cells, split_cutoff, split_part
from habitloom.session import materialize

CELL = ("dataset", "seed", "variant")


def generation_hints(
    source_events: DataFrame, prior: DataFrame, target_events: DataFrame = None, *, guard=None,
    lambda_causal=1.0, mode="multiplicative", add_causal_edges=False, top_k=None,
) -> DataFrame:
    """Fuse the source transition graph with influence edges.

    With ``target_events`` the edges are first weighted by the target's device
    shares and guarded against over-use (``guard``: options of
    ``overuse_guard``); without, only source data is used.
    """
    edges = prior
    if target_events is not None:
        target = device_distribution(target_events).select("device", "p")
        observed = device_distribution(source_events).select("device", "p")
        weighted = target_weighted(prior, target).select("source", "target", "weight")
        edges = overuse_guard(weighted, observed, target, **(guard or {})).select(
            "source", "target", "raw_weight", "weight", "guard_action",
        )
    elif guard is not None:
        raise ValueError("a guard needs target data; a source-only run must not have any")
    return fuse_edges(
        transition_graph(source_events), edges, lambda_causal=lambda_causal, mode=mode,
        add_causal_edges=add_causal_edges, top_k=top_k,
    )


def filter_corpus(events: DataFrame, detector, seed=2024, ratio=0.8) -> DataFrame:
    """Two-stage filter: ``(env, corpus_id, seq_id, loss, is_outlier, readmit, kept)``.

    Loss outliers leave; of these, the ones whose presence in the training part
    does not raise the validation loss come back. The log is read once; all
    later jobs work on the counted steps.
    """
    key = ["env", *SEQ]
    steps = materialize(counted_steps(token_steps(events, [detector])), "steps")
    split = materialize(iqr_outliers(sequence_losses(steps, fit_markov(steps))), "losses")
    cutoff = split_cutoff(split.where(~F.col("is_outlier")), ratio, seed)
    role = F.when(F.col("is_outlier"), "outlier").otherwise(split_part(cutoff, seed))
    placed = steps.join(split.select(*key, "is_outlier"), key).select(*key, "prev", "token", "vocab_size", "n", role.alias("role"))
    change = utility_change(*[placed.where(F.col("role") == r) for r in ("train", "validation", "outlier")])
    return split.join(change.select(*key, "loss_change", "readmit"), key, "left").withColumn(
        "kept", ~F.col("is_outlier") | F.coalesce("readmit", F.lit(False)),
    )


def part_of(rows: DataFrame, part: str, detectors, cutoff: DataFrame, seed=2024) -> DataFrame:
    """The rows ``(env, corpus_id, seq_id, …)`` a detector uses as ``train`` or ``validation``.

    Detectors marked ``whole_corpus`` use every sequence as both.
    """
    whole = [d.env for d in detectors if d.whole_corpus]
    return rows.where(F.col("env").isin(whole) | (split_part(cutoff, seed) == part))


def run_detectors(train_events: DataFrame, test_events: DataFrame, detectors, ratio=0.8, seed=2024):
    """Fit, set thresholds and label test sequences for all detectors in one pass.

    ``test_events`` carries ``env`` (which detector a sequence is meant for)
    and ``label``. Returns ``(predictions, thresholds)``; predictions are per
    sequence with ``loss, threshold, predicted, label``.
    """
    steps = materialize(counted_steps(token_steps(train_events, detectors)), "steps")
    # Every sequence has one first step.
    cutoff = split_cutoff(steps.where((F.col("env") == detectors[0].env) & (F.col("prev") == START)), ratio, seed)
    model = fit_markov(part_of(steps, "train", detectors, cutoff, seed))
    validation = part_of(steps, "validation", detectors, cutoff, seed)
    thresholds = loss_thresholds(sequence_losses(validation, model), detectors)

    aimed = test_events.withColumnRenamed("env", "_aim")
    test_steps = token_steps(aimed, detectors, keep=["_aim", "label"]).where(F.col("env") == F.col("_aim"))
    losses = sequence_losses(counted_steps(test_steps, keep=["label"]), model, keep=["label"])
    return classify(losses, thresholds), thresholds


def evaluate_detectors(train_events: DataFrame, test_events: DataFrame, detectors, ratio=0.8, seed=2024) -> DataFrame:
    """Confusion counts and scores per detector."""
    predictions, _ = run_detectors(train_events, test_events, detectors, ratio, seed)
    return confusion(predictions, by=("env",))


def in_cell(rows: DataFrame, cell=CELL) -> DataFrame:
    """``rows`` with the cell in ``corpus_id``: a sequence used in several cells is another one in each."""
    return rows.withColumn("corpus_id", F.concat_ws("/", *[F.col(c).cast("string") for c in (*cell, "corpus_id")]))


def _steps_in_cells(events, detectors, cells, keep=(), aim=None):
    """Counted steps of the sequences in each of their cells: counted once, then dealt to the cells that ``cells`` gives a sequence."""
    if cells is None:
        return counted_steps(token_steps(in_cell(events), detectors, [*keep, *CELL, *([aim] if aim else [])], aim), [*keep, *CELL])
    return counted_steps(token_steps(events, detectors, [*keep, *([aim] if aim else [])], aim), keep).select("*", F.inline(cells))


def evaluate_cells(train_events: DataFrame, test_events: DataFrame, detectors, ratio=0.8, seed=2024, train_cells=None, test_cells=None) -> DataFrame:
    """Confusion counts and scores of every cell: dataset, env, seed and variant, all in one job.

    Both tables carry the columns of ``CELL``, ``test_events`` also ``env`` and
    ``label``. Where a sequence is in several cells, ``train_cells`` and
    ``test_cells`` may tell them instead, as a column over the columns of
    ``SEQ``: an array of structs of ``CELL``. Its events then come once, and are
    ordered and counted once for all its cells, with the same result. Each cell
    has a split of its own (the seed is part of the key that orders it), a fit,
    and a threshold at the percentile of its dataset and env. The events of all
    cells are read in one pass; what a cell needs of itself afterwards is a row
    in a table keyed by cell. Test sequences of a cell without training data are
    left out.
    """
    by = ("env", *CELL)
    steps = _steps_in_cells(train_events, detectors, train_cells)
    # Sequences that come once are named by cell now: the split orders them by name.
    steps = materialize(steps if train_cells is None else in_cell(steps), "steps")
    # Every sequence has one first step for each detector.
    ids = steps.where((F.col("env") == detectors[0].env) & (F.col("prev") == START)).select(*CELL, *SEQ)
    parts = materialize(split_cells(ids, CELL, ratio, seed), "parts")
    whole = F.col("env").isin([d.env for d in detectors if d.whole_corpus])
    placed = steps.join(parts, [*CELL, *SEQ])
    model = fit_markov(placed.where(whole | (F.col("part") == "train")), by)
    validation = sequence_losses(placed.where(whole | (F.col("part") == "validation")), model)
    thresholds = cell_thresholds(validation, detectors, by)

    test_steps = _steps_in_cells(test_events.withColumnRenamed("env", "_aim"), detectors, test_cells, ["label"], "_aim")
    losses = sequence_losses(test_steps, model, keep=["label"])
    return confusion(classify(losses, thresholds, by), by=by)
