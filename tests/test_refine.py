import math

import pytest
from pyspark.sql import functions as F

from habitloom.operators import ranking, refine


def edge_table(spark, rows, columns="source string, target string, weight double"):
    return refine.scoring_edges(spark.createDataFrame(rows, columns))


def test_consistency_is_the_mean_over_pairs(make_events, spark):
    events = make_events({("c", "s"): [(0, 0, d, d) for d in (1, 2, 3)], ("c", "one"): [(0, 0, 1, 1)]})
    edges = edge_table(spark, [("d:1", "d:2", 1.0), ("d:2", "d:3", 0.5)])
    found = {r.seq_id: r for r in refine.sequence_scores(events, edges, gamma_dist=0.0, temperature=2.0).collect()}
    assert found["s"].causal_consistency_score == pytest.approx(0.5)
    assert found["s"].final_score == pytest.approx(-0.5) and found["s"].sample_weight == pytest.approx(math.exp(-0.25))
    assert (found["s"].num_ordered_event_pairs, found["s"].num_causally_supported_pairs) == (3, 2)
    assert found["one"].causal_consistency_score == 1.0


def test_score_formula(make_events, spark):
    events = make_events({("c", "s"): [(0, 0, 1, 1), (0, 0, 2, 2)]})
    losses = spark.createDataFrame([("c", "s", 0.25)], "corpus_id string, seq_id string, loss double")
    edges = edge_table(spark, [("d:1", "d:2", 1.0)])
    score = refine.sequence_scores(events, edges, losses=losses, alpha_rec=2.0, beta_inconsistency=3.0, gamma_dist=0.0).head()
    assert score.final_score == pytest.approx(0.5)
    negative = losses.withColumn("loss", F.lit(-1.0))
    assert refine.sequence_scores(events, edges, losses=negative).head().final_score == pytest.approx(0.0)
    with pytest.raises(Exception, match="no loss for sequence c/s"):
        refine.sequence_scores(events, edges, losses=losses.where("loss > 9")).collect()
    with pytest.raises(ValueError):
        refine.sequence_scores(events, edges, temperature=0)


def test_downweighted_edges_and_strength_order(spark):
    rows = [("1", "2", 0.5, 0.9, "keep"), ("d:1", "d:2", 0.7, 0.1, "downweight"), ("3", "4", None, 0.25, "keep")]
    columns = "source string, target string, weight double, causal_strength double, guard_action string"
    found = {(r.source, r.target): (r.strength, r.normalized) for r in edge_table(spark, rows, columns).collect()}
    assert found == {("d:1", "d:2"): (0.5, 1.0), ("d:3", "d:4"): (0.25, 0.5)}
    every = refine.scoring_edges(spark.createDataFrame(rows, columns), include_downweighted=True)
    assert {(r.source, r.target): r.strength for r in every.collect()}["d:1", "d:2"] == 0.7


def test_zero_edges_give_zero_consistency(make_events, spark):
    events = make_events({("c", "s"): [(0, 0, 1, 1), (0, 0, 2, 2)]})
    assert refine.consistency(events, edge_table(spark, [("d:1", "d:2", 0.0)])).head().causal_consistency_score == 0.0


@pytest.fixture(scope="module")
def scores(spark):
    return spark.range(300).select(
        F.lit("c").alias("corpus_id"), F.col("id").cast("string").alias("seq_id"),
        (F.col("id") % 7).cast("double").alias("sample_weight"), (F.col("id") % 3).cast("double").alias("final_score"),
    )


@pytest.mark.parametrize("target,cap", [(None, 3), (50, 1), (257, 1), (514, 2)])
def test_resample_size_and_cap(scores, target, cap):
    drawn = refine.weighted_resample(scores, seed=3, max_copies=cap, target_size=target).collect()
    assert len(drawn) == 300 and sum(r.copies for r in drawn) == (target or 300)
    assert max(r.copies for r in drawn) <= cap
    assert all(r.copies == 0 for r in drawn if int(r.seq_id) % 7 == 0)


def test_resample_favours_heavy_sequences(scores):
    drawn = refine.weighted_resample(scores, seed=1, max_copies=3, target_size=150).collect()
    mean = {w: sum(r.copies for r in drawn if int(r.seq_id) % 7 == w) / sum(int(r.seq_id) % 7 == w for r in drawn) for w in (1, 6)}
    assert mean[6] > mean[1]
    again = refine.weighted_resample(scores, seed=1, max_copies=3, target_size=150).collect()
    assert sorted(drawn) == sorted(again)


def test_resample_limits(scores):
    with pytest.raises(Exception, match="target_size exceeds"):
        refine.weighted_resample(scores, max_copies=1, target_size=301).collect()
    flat = scores.withColumn("sample_weight", F.lit(0.0))
    assert sum(r.copies for r in refine.weighted_resample(flat, max_copies=2).collect()) == 300
    assert sum(r.copies for r in refine.weighted_resample(scores, target_size=0).collect()) == 0
    with pytest.raises(ValueError):
        refine.weighted_resample(scores, max_copies=0)


def test_copies_become_sequences(random_events):
    events, data = random_events
    copies = events.where("pos = 0").select("corpus_id", "seq_id", F.lit(2).alias("copies"))
    doubled = refine.resampled_events(events, copies)
    assert doubled.count() == 2 * sum(len(q) for q in data.values())
    assert doubled.select("corpus_id", "seq_id").distinct().count() == 2 * len(data)


@pytest.mark.parametrize("n,ratio,train", [(10, 0.8, 8), (5, 0.8, 4), (3, 0.5, 1), (2, 0.9, 1)])
def test_split_sizes(spark, n, ratio, train):
    ids = spark.range(n).select(F.lit("c").alias("corpus_id"), F.col("id").cast("string").alias("seq_id"))
    parts = [r.part for r in refine.split_train_validation(ids, ratio, 1).collect()]
    assert parts.count("train") == train and len(parts) == n


def test_split_errors(spark):
    one = spark.range(1).select(F.lit("c").alias("corpus_id"), F.col("id").cast("string").alias("seq_id"))
    with pytest.raises(Exception, match="at least 2"):
        refine.split_train_validation(one).collect()
    with pytest.raises(ValueError):
        refine.split_train_validation(one, 1.0)


def test_decisions(scores):
    ranked = refine.decide(scores, "rank").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 301))
    assert [(-r.final_score, r.seq_id) for r in ranked] == sorted((-r.final_score, r.seq_id) for r in ranked)
    kept = {r.seq_id: r.decision for r in refine.decide(scores, "filter", 3.0).collect()}
    assert kept["3"] == "keep" and kept["2"] == "delete"
    assert {r.decision for r in refine.decide(scores).collect()} == {"weight"}
    with pytest.raises(ValueError):
        refine.decide(scores, "drop")


def test_percentiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    values = {"x": np.round(rng.normal(2, 1, 501), 2), "y": np.r_[np.full(400, 1.25), rng.random(77)], "z": np.array([3.5])}
    data = [(k, float(v)) for k, vs in values.items() for v in vs] + [("x", None)]
    frame = spark.createDataFrame(data, "g string, v double")
    found = {r.g: r for r in ranking.exact_percentiles(frame, "v", {"a": 0.0, "q": 0.25, "m": 0.955, "b": 1.0}, ["g"]).collect()}
    for key, vs in values.items():
        for name, q in (("a", 0), ("q", 25), ("m", 95.5), ("b", 100)):
            assert found[key][name] == pytest.approx(np.percentile(vs, q))
    wide = [float(s * v) for s in (1, -1) for v in 10.0 ** np.linspace(-300, 300, 101)] + [0.0, 0.0]
    found = ranking.exact_percentiles(spark.createDataFrame([(v,) for v in wide], "v double"), "v", {"a": 0.0, "m": 0.5, "q": 0.9, "b": 1.0}).head()
    assert [found.a, found.m, found.q, found.b] == pytest.approx([np.percentile(wide, q) for q in (0, 50, 90, 100)])
    whole = ranking.exact_percentiles(frame, "v", {"m": 0.5}).head().m
    assert whole == pytest.approx(np.percentile(np.concatenate(list(values.values())), 50))


def test_cells_are_split_each_by_itself(spark):
    sizes = {("a", 1): 2, ("a", 2): 5, ("b", 1): 10, ("b", 2): 333}
    rows = [(d, s, "c", f"s{i}") for (d, s), n in sizes.items() for i in range(n)]
    ids = spark.createDataFrame(rows, "dataset string, seed int, corpus_id string, seq_id string")
    found = refine.split_cells(ids, ("dataset", "seed"), 0.8, 7).collect()
    assert len(found) == len(rows)
    for (d, s), n in sizes.items():
        assert sum(r.part == "train" for r in found if (r.dataset, r.seed) == (d, s)) == int(n * 0.8)
    # A cell gets what a table of that cell alone gets.
    alone = refine.split_train_validation(ids.where("dataset = 'b' AND seed = 2").select("corpus_id", "seq_id"), 0.8, 7).collect()
    assert {(r.seq_id, r.part) for r in alone} == {(r.seq_id, r.part) for r in found if (r.dataset, r.seed) == ("b", 2)}
    with pytest.raises(Exception, match="at least 2"):
        refine.split_cells(ids.where("dataset = 'b'").unionByName(ids.where("dataset = 'a'").limit(1)), ("dataset", "seed"), 0.8, 7).collect()
