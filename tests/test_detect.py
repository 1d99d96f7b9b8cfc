import math

import pytest
from pyspark.sql import functions as F

from habitloom.operators import detect, refine
from habitloom.plans import pipelines

DEVICE = detect.Detector("multiple", "device_id", 11, 99.0)


def tokens(quads):
    return [q[2] for q in quads]


def fit(sequences):
    pairs, contexts = {}, {}
    for seq in sequences:
        for prev, token in zip([-1, *seq], seq):
            pairs[prev, token] = pairs.get((prev, token), 0) + 1
            contexts[prev] = contexts.get(prev, 0) + 1
    return pairs, contexts


def loss(seq, model, vocab=11):
    pairs, contexts = model
    return sum(
        -math.log((pairs.get((p, t), 0) + 1) / (contexts.get(p, 0) + vocab)) for p, t in zip([-1, *seq], seq)
    ) / len(seq)


def test_losses_match_the_definition(random_events):
    events, data = random_events
    steps = detect.token_steps(events, [DEVICE])
    model = detect.fit_markov(steps.where("corpus_id = 'a'"))
    found = {(r.corpus_id, r.seq_id): r.loss for r in detect.sequence_losses(steps, model).collect()}
    counts = fit([tokens(q) for (c, _), q in data.items() if c == "a"])
    assert found == pytest.approx({k: loss(tokens(q), counts) for k, q in data.items()})


def test_readmission_equals_refitting(random_events):
    events, data = random_events
    names = sorted(data)
    train, validation, outliers = names[:35], names[35:50], names[50:]
    steps = detect.token_steps(events, [DEVICE])

    def part(keys):
        return steps.where(F.concat_ws("/", "corpus_id", "seq_id").isin(["/".join(k) for k in keys]))

    found = {(r.corpus_id, r.seq_id): r for r in detect.utility_change(part(train), part(validation), part(outliers)).collect()}
    sequences = {k: tokens(q) for k, q in data.items()}
    base = fit([sequences[k] for k in train])
    before = sum(loss(sequences[k], base) for k in validation) / len(validation)
    assert set(found) == set(outliers)
    for o in outliers:
        model = fit([sequences[k] for k in [*train, o]])
        change = sum(loss(sequences[k], model) for k in validation) / len(validation) - before
        assert found[o].loss_change == pytest.approx(change, abs=1e-12)
        if abs(change) > 1e-9:
            assert found[o].readmit == (change <= 0)


def test_outlier_fence_is_one_sided(spark):
    values = [0.0, 5.0, 5.0, 5.1, 5.2, 5.3, 9.0]
    frame = spark.createDataFrame([("e", v) for v in values], "env string, loss double")
    assert sorted(r.loss for r in detect.iqr_outliers(frame).where("is_outlier").collect()) == [9.0]


def test_filter_keeps_every_inlier(random_events):
    events, data = random_events
    filtered = pipelines.filter_corpus(events, DEVICE, seed=4).collect()
    assert len(filtered) == len(data)
    assert all(r.kept for r in filtered if not r.is_outlier)
    assert all(r.kept == bool(r.readmit) for r in filtered if r.is_outlier)


def test_threshold_decides_at_equality(spark):
    losses = spark.createDataFrame([("e", 1.0), ("e", 2.0), ("e", 3.0)], "env string, loss double")
    thresholds = spark.createDataFrame([("e", 2.0)], "env string, threshold double")
    assert {r.loss: r.predicted for r in detect.classify(losses, thresholds).collect()} == {1.0: 0, 2.0: 1, 3.0: 1}


def test_confusion_with_empty_classes(spark):
    rows = [("p", 1, 1), ("p", 1, 0), ("p", 0, 1), ("p", 0, 0), ("p", 1, 1), ("n", 0, 0)]
    found = {r.env: r for r in detect.confusion(spark.createDataFrame(rows, "env string, label int, predicted int")).collect()}
    p, n = found["p"], found["n"]
    assert (p.tp, p.tn, p.fp, p.fn) == (2, 1, 1, 1)
    assert (p.precision, p.recall, p.f1, p.fpr) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 0.5))
    assert (n.precision, n.recall, n.f1, n.accuracy, n.fnr) == (0.0, 0.0, 0.0, 1.0, None)


def test_whole_corpus_protocol(spark):
    detectors = [detect.Detector("multiple", "device_id", 11, 99.0, whole_corpus=True), detect.Detector("night", "hour_slot", 8)]
    ids = spark.range(5).select(F.lit("c").alias("corpus_id"), F.col("id").cast("string").alias("seq_id"))
    rows = ids.select("*", F.explode(F.array(F.lit("multiple"), F.lit("night"))).alias("env"))
    cutoff = refine.split_cutoff(ids)
    found = {
        (env, part): n for part in ("train", "validation")
        for env, n in pipelines.part_of(rows, part, detectors, cutoff).groupBy("env").count().collect()
    }
    assert found == {("multiple", "train"): 5, ("multiple", "validation"): 5, ("night", "train"): 4, ("night", "validation"): 1}


def test_detector_arguments():
    with pytest.raises(ValueError):
        detect.Detector("night", "hour_slot", 8, 101)


def test_cells_told_by_column_give_what_rows_per_cell_give(random_events):
    from habitloom.plans import inputs, pipelines

    events, _ = random_events
    env = F.when(F.crc32("seq_id") % 3 == 0, "night").when(F.crc32("seq_id") % 3 == 1, "multiple").otherwise("spring")
    tested = events.withColumns({"env": env, "label": (F.crc32("seq_id") % 2).cast("int")})
    expanded = pipelines.evaluate_cells(inputs.in_cells(events), inputs.in_cells(tested), inputs.DETECTORS).collect()
    found = pipelines.evaluate_cells(events, tested, inputs.DETECTORS, train_cells=inputs.cells_of(), test_cells=inputs.cells_of()).collect()
    assert sorted(map(str, found)) == sorted(map(str, expanded)) and len(found) == 24
