import pytest
from pyspark.sql import functions as F

from habitloom.functions import columns as c
from habitloom.operators import compare, descriptive


def test_transition_counts(make_events):
    events = make_events({("c", "0"): [(0, 0, 1, 10), (0, 1, 2, 20), (0, 2, 2, 21)]})
    found = {(r.source_device, r.target_device): (r["count"], r.transition_score) for r in descriptive.transition_graph(events).collect()}
    assert found == {(1, 2): (1, 1.0), (2, 2): (1, 1.0)}
    assert descriptive.graph_size(events).head().asDict() == {"corpus_id": "c", "num_sequences": 1, "num_edges": 2}


def test_shares_and_rows_sum_to_one(random_events):
    events, _ = random_events
    for r in descriptive.device_distribution(events).groupBy("corpus_id").agg(F.sum("p").alias("s")).collect():
        assert r.s == pytest.approx(1)
    for r in descriptive.transition_matrix(events).groupBy("corpus_id", "source").agg(F.sum("value").alias("s")).collect():
        assert r.s == pytest.approx(1)


def test_precedence_matches_its_definition(random_events):
    events, data = random_events
    found = {(r.corpus_id, r.source, r.target): r.value for r in descriptive.precedence_matrix(events).collect()}
    counts, met = {}, {}
    for (corpus, _), quads in data.items():
        devices = [q[2] for q in quads]
        for i, source in enumerate(devices):
            met[corpus, source] = met.get((corpus, source), 0) + 1
            for target in set(devices[i + 1:]) - {source}:
                counts[corpus, source, target] = counts.get((corpus, source, target), 0) + 1
    expected = {(k, f"d:{s}", f"d:{t}"): n / met[k, s] for (k, s, t), n in counts.items()}
    assert found == pytest.approx(expected)


def test_decay_matches_the_recursion(random_events):
    events, _ = random_events
    tensor = descriptive.event_tensor(events, "device", "count")
    found = {(r.corpus_id, r.seq_id, r.channel, r.slot): r.value for r in descriptive.decayed_tensor(tensor, 0.3).collect()}
    cells = {}
    for r in tensor.collect():
        cells.setdefault((r.corpus_id, r.seq_id, r.channel), {})[r.slot] = r.value
    for key, values in cells.items():
        level = 0.0
        for t in range(56):
            level = values.get(t, 0.0) + 0.3 * level
            if t >= min(values):
                assert found[(*key, t)] == pytest.approx(level)
            else:
                assert (*key, t) not in found


def test_tensor_modes_and_arguments(make_events):
    events = make_events({("c", "s"): [(0, 1, 1, 4), (0, 1, 1, 4), (0, 1, 2, 8)]})
    count = {r.channel: r.value for r in descriptive.event_tensor(events, "action", "count").collect()}
    assert count == {"a:4": 2.0, "a:8": 1.0}
    kept = {r.channel: r.value for r in descriptive.event_tensor(events, "device_action", "binary", min_frequency=2).collect()}
    assert kept == {"d:1|a:4": 1.0}
    with pytest.raises(ValueError):
        descriptive.event_tensor(events, "action", "sum")
    with pytest.raises(ValueError):
        descriptive.event_tensor(events, "room")


def test_channels_sort_by_number(spark):
    frame = spark.createDataFrame([("d:10",), ("d:2",), ("x",)], "channel string")
    found = [r.channel for r in descriptive.channels_in_order(frame).orderBy("channel_index").collect()]
    assert found == ["d:2", "d:10", "x"]


def test_top_successors_keep_unfollowed_actions(make_events):
    events = make_events({("c", "s"): [(0, 0, 0, 1), (0, 0, 0, 2)], ("c", "t"): [(0, 0, 0, 1), (0, 0, 0, 3)], ("c", "u"): [(0, 0, 0, 1), (0, 0, 0, 3)]})
    found = {(r.action, r.next_action, r["count"], r["rank"]) for r in descriptive.top_successors(events, 1).collect()}
    assert found == {(1, 3, 2, 1), (2, None, None, None), (3, None, None, None)}


def test_a_corpus_equals_itself(random_events):
    events, _ = random_events
    twin = events.where("corpus_id = 'a'")
    both = twin.unionByName(twin.withColumn("corpus_id", F.lit("copy")))
    row = compare.quality_summary(both, "a", "copy").head()
    assert row.device_distribution_kl == pytest.approx(0, abs=1e-12)
    assert row.transition_matrix_similarity == pytest.approx(1)
    assert row.causal_graph_similarity == pytest.approx(1)
    sides = compare.case_study_matrices(both, ["a", "copy"]).groupBy("kind", "source", "target").agg(
        (F.max("value") - F.min("value")).alias("gap"), F.count(F.lit(1)).alias("n"),
    ).collect()
    assert all(r.gap == 0 and r.n == 2 for r in sides)


def test_similarity_of_zero_matrices(spark):
    matrix = spark.createDataFrame([("a", "x", "y", 0.0), ("c", "x", "y", 1.0)], "corpus_id string, source string, target string, value double")
    assert compare.matrix_similarity(matrix, "a", "b").head()[0] == 1.0
    assert compare.matrix_similarity(matrix, "a", "c").head()[0] == 0.0


def test_penalty_without_target_is_zero(random_events, spark):
    events, data = random_events
    empty = spark.createDataFrame([], "device string, p double")
    for target in (None, empty):
        values = [r.distribution_penalty for r in compare.distribution_penalty(events, target).collect()]
        assert values == [0.0] * len(data)


def test_penalty_counts_unseen_devices(make_events, spark):
    events = make_events({("c", "s"): [(0, 0, 1, 1), (0, 0, 2, 1)]})
    target = spark.createDataFrame([("d:1", 0.2), ("d:9", 0.8)], "device string, p double")
    assert compare.distribution_penalty(events, target).head().distribution_penalty == pytest.approx(0.5 * (0.3 + 0.5 + 0.8))


def test_keys_and_padding(spark):
    values = ["d:7", "device_007", "7", "0012", "00", "lamp", "device_x", None]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    found = [r[0] for r in frame.select(c.canonical_device_key("v")).collect()]
    assert found == ["d:7", "d:7", "d:7", "d:12", "d:0", "lamp", "device_x", None]
    flat = spark.createDataFrame([([1, 2, 3, 4],), (list(range(48)),)], "flat array<int>")
    padded = [r[0] for r in flat.select(c.pad_or_truncate("flat", 223)).collect()]
    assert padded[0] == [1, 2, 3, 4] + [222] * 36 and padded[1] == list(range(40))


def test_numbers_from_text(spark):
    frame = spark.createDataFrame([("1.5",), ("",), ("NaN",), ("inf",), ("x",), ("7",)], "v string")
    assert [r[0] for r in frame.select(c.finite_or_null("v")).collect()] == [1.5, None, None, None, None, 7.0]
    assert [r[0] for r in frame.select(c.whole_or_null("v")).collect()] == [1, None, None, None, None, 7]
