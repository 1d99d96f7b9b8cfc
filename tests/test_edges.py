import pytest

from habitloom.operators import edges
from habitloom.plans.pipelines import generation_hints


def transitions(spark, rows):
    keyed = [(f"d:{s}", f"d:{t}", n, score) for s, t, n, score in rows]
    return spark.createDataFrame(keyed, "source_device_key string, target_device_key string, count bigint, transition_score double")


def causal(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, weight double")


def test_fusion_modes(spark):
    steps = transitions(spark, [(1, 2, 1, 0.2), (1, 3, 2, 0.4)])
    prior = causal(spark, [("d:1", "d:2", 0.8)])
    for mode, expected in (("additive", [1.5, 1.0]), ("multiplicative", [1.0, 1.0])):
        fused = edges.fuse_edges(steps, prior, mode=mode).collect()
        assert [r.final_score for r in fused] == pytest.approx(expected)
        assert [r.target_device_key for r in fused] == ["d:2", "d:3"]
    with pytest.raises(ValueError):
        edges.fuse_edges(steps, prior, mode="mean")


def test_fusion_adds_edges_and_keeps_the_strongest(spark):
    steps = transitions(spark, [(1, 2, 3, 0.5)])
    prior = causal(spark, [("2", "device_1", 0.1), ("d:2", "d:1", 0.4), ("d:1", None, 9.0)])
    found = {(r.source_device_key, r.target_device_key): r for r in edges.fuse_edges(steps, prior, lambda_causal=2.0, add_causal_edges=True).collect()}
    assert set(found) == {("d:1", "d:2"), ("d:2", "d:1")}
    added = found["d:2", "d:1"]
    assert added.final_score == pytest.approx(2.0) and added.edge_origin == "causal_relation_augmented" and added["count"] == 0
    assert edges.fuse_edges(steps, prior, add_causal_edges=True, top_k=1).count() == 1


def test_target_weighting(spark):
    target = spark.createDataFrame([("1", 0.25), ("d:2", 0.75)], "device string, p double")
    weighted = edges.target_weighted(causal(spark, [("d:1", "d:2", 0.8)]), target).head()
    assert weighted.target_adapted_weight == pytest.approx(0.15)
    assert edges.target_weighted_matrix(causal(spark, [("d:1", "d:9", 0.8)]), target).head().weight == 0.0


@pytest.mark.parametrize("policy,expected", [
    ("target", {"d:2": "keep", "d:3": "suppress"}), ("source_or_target", {"d:2": "suppress", "d:3": "suppress"}),
    ("both", {"d:2": "keep", "d:3": "suppress"}),
])
def test_guard_policies(spark, policy, expected):
    observed = spark.createDataFrame([("d:1", 0.5), ("d:2", 0.1), ("d:3", 0.4)], "device string, p double")
    target = spark.createDataFrame([("d:1", 0.2), ("d:2", 0.7), ("d:3", 0.1)], "device string, p double")
    prior = causal(spark, [("d:1", "d:2", 0.8), ("d:1", "d:3", 0.6)])
    guarded = edges.overuse_guard(prior, observed, target, endpoint_policy=policy)
    assert {r.target_device_key: r.guard_action for r in guarded.collect()} == expected
    worst = edges.overused_devices(guarded).collect()
    assert [r.device for r in worst] == ["d:3", "d:1"] and worst[0].ratio == pytest.approx(4.0)


def test_guard_weakens_and_explains(spark):
    observed = spark.createDataFrame([("d:1", 1.0)], "device string, p double")
    target = spark.createDataFrame([("d:2", 1.0)], "device string, p double")
    row = edges.overuse_guard(causal(spark, [("d:2", "d:1", 0.8)]), observed, target, mode="downweight").head()
    assert row.guarded_weight == pytest.approx(0.2)
    assert row.guard_reason == "d:1 overused: observed_freq=1.000000, target_freq=0.000000, ratio=1000.000"


@pytest.mark.parametrize("options", [
    {"mode": "drop"}, {"endpoint_policy": "any"}, {"max_overuse_ratio": 0}, {"downweight_factor": 1.5},
])
def test_guard_arguments(spark, options):
    empty = spark.createDataFrame([], "device string, p double")
    with pytest.raises(ValueError):
        edges.overuse_guard(causal(spark, [("d:1", "d:2", 0.8)]), empty, empty, **options)


def test_statistics_of_nothing(spark):
    row = edges.edge_statistics(spark.createDataFrame([], "source string, target string, weight double")).head()
    assert row.num_edges == 0 and row.mean_strength == 0.0 and row.p90_strength == 0.0 and row.nonzero_ratio == 0.0


def test_sparsify_normalizes_before_the_threshold(spark):
    matrix = causal(spark, [("a", "a", 2.0), ("a", "b", 5.0), ("b", "a", 1.0), ("b", "c", 0.3), ("c", "c", 0.0)])
    found = {(r.source, r.target): r.weight for r in edges.sparsify(matrix, 0.1).collect()}
    assert found == pytest.approx({("a", "a"): 0.5, ("a", "b"): 1.0})
    found = {(r.source, r.target): r.weight for r in edges.sparsify(matrix).collect()}
    assert found == pytest.approx({("a", "a"): 0.5, ("a", "b"): 1.0, ("b", "c"): 0.075})


def test_top_edges(spark):
    matrix = causal(spark, [("a", "a", 9.0), ("b", "c", 0.5), ("a", "c", 0.5), ("a", "b", 0.7), ("c", "b", 0.0)])
    assert [(r.source, r.target) for r in edges.top_edges(matrix, 2).collect()] == [("a", "b"), ("a", "c")]
    assert edges.top_edges(matrix, 0, include_self=True).count() == 4
    assert edges.top_edges(matrix, 10, min_weight=0.6).count() == 1


def test_standardize_fills_both_ways(spark):
    channels = spark.createDataFrame([("d:5", 0), ("d:6", 1)], "channel string, channel_index int")
    rows = spark.createDataFrame(
        [("d:5", None, None, 1, 0.5, None), (None, "d:5", 1, None, None, 0.7), (None, None, 9, 0, 0.1, None)],
        "source string, target string, source_index int, target_index int, weight double, raw_weight double",
    )
    found = [tuple(r) for r in edges.standardize_edges(rows, channels, 4).orderBy("weight").collect()]
    assert found == [("c:9", "d:5", 9, 0, 0.1, 4), ("d:5", "d:6", 0, 1, 0.5, 4), ("d:6", "d:5", 1, 0, 0.7, 4)]


def test_source_only_hints_take_no_guard(random_events, spark):
    events, _ = random_events
    prior = causal(spark, [("d:1", "d:2", 0.8)])
    assert generation_hints(events.where("corpus_id = 'a'"), prior).count() > 0
    with pytest.raises(ValueError):
        generation_hints(events, prior, guard={"mode": "suppress"})
