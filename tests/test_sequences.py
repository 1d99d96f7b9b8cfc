import datetime

import pytest
from pyspark.sql import functions as F

from habitloom.model import EVENT_COLUMNS, SEQ
from habitloom.operators import sequences
from habitloom.sources import corpora
from habitloom.sources.event_log import id_in, sequences_from_log


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_flat_round_trip(spark):
    corpus = spark.createDataFrame(
        [("c", "0", [0, 0, 1, 10, 0, 1, 2, 20]), ("c", "1", [6, 7, 3, 5])], "corpus_id string, seq_id string, flat array<int>",
    )
    events = sequences.flat_to_events(corpus)
    assert rows(events, *EVENT_COLUMNS) == [
        ("c", "0", 0, 0, 0, 1, 10), ("c", "0", 1, 0, 1, 2, 20), ("c", "1", 0, 6, 7, 3, 5),
    ]
    back = sequences.events_to_flat(events)
    assert {r.seq_id: r.flat for r in back.collect()} == {"0": [0, 0, 1, 10, 0, 1, 2, 20], "1": [6, 7, 3, 5]}


def test_flat_continues_in_parts(make_events):
    events = make_events({("c", "s"): [(0, 0, d, d) for d in range(5)]})
    parts = sequences.events_to_flat(events, part_events=2)
    found = {r.start: r.flat for r in parts.collect()}
    assert found == {0: [0, 0, 0, 0, 0, 0, 1, 1], 2: [0, 0, 2, 2, 0, 0, 3, 3], 4: [0, 0, 4, 4]}
    assert rows(sequences.flat_to_events(parts), *EVENT_COLUMNS) == rows(events, *EVENT_COLUMNS)
    lists = {r.start: (r.device_ids, r.action_ids) for r in sequences.id_lists(events, part_events=3).collect()}
    assert lists == {0: ([0, 1, 2], [0, 1, 2]), 3: ([3, 4], [3, 4])}


@pytest.mark.parametrize("part", [None, 1, 2, 100])
def test_parts_survive_both_file_forms(random_events, spark, tmp_path, part):
    events, _ = random_events
    flat = sequences.events_to_flat(events, part_events=part)
    corpora.write_corpus(flat, str(tmp_path / "corpus"))
    assert rows(sequences.flat_to_events(corpora.read_corpus(spark, str(tmp_path / "corpus"))), *EVENT_COLUMNS) == rows(events, *EVENT_COLUMNS)
    lines = flat.select(F.concat_ws("/", *SEQ).alias("sequence_id"), "start", F.col("flat").alias("sequence"))
    lines.write.json(str(tmp_path / "lines"))
    back = corpora.read_generated(spark, str(tmp_path / "lines"))
    assert back.where("problem IS NOT NULL").isEmpty()
    names = F.split("sequence_id", "/")
    back = back.select(names[0].alias("corpus_id"), names[1].alias("seq_id"), "start", F.col("sequence").alias("flat"))
    assert rows(sequences.flat_to_events(back), *EVENT_COLUMNS) == rows(events, *EVENT_COLUMNS)


def test_padded_lists_are_per_sequence(make_events):
    events = make_events({("c", "s"): [(0, 0, d, d) for d in range(5)], ("c", "t"): [(1, 1, 1, 1)]})
    found = {r.seq_id: r.padded for r in sequences.padded_lists(events, 21, 8).collect()}
    assert found == {"s": [0, 0, 0, 0, 0, 0, 1, 1], "t": [1, 1, 1, 1, 20, 20, 20, 20]}


@pytest.fixture(scope="module")
def log(spark):
    start = datetime.datetime(2024, 1, 1)
    data = [(i, 1 if i % 3 else 2, start + datetime.timedelta(seconds=i * 7919 % 4000, hours=i % 30), i % 5) for i in range(200)]
    return spark.createDataFrame(data, "id bigint, who bigint, ts timestamp_ntz, kind int")


def test_numbering_per_second_gives_the_same_events(log):
    """The log has several corpora a day, and seconds with many events of one entity."""
    hot = log.unionByName(log.select((F.col("id") + 1000).alias("id"), "who", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts"), "kind"))

    def build(per_second):
        return sequences_from_log(
            hot, entity="who", ts="ts", tie="id", device_id=F.col("kind"), action_id=F.col("kind"),
            corpus_id=F.when(F.hour("ts") < 9, "early").otherwise("late"), per_second=per_second,
        )

    plain, split = build(False), build(True)
    assert plain.schema == split.schema
    assert rows(plain, *EVENT_COLUMNS) == rows(split, *EVENT_COLUMNS)
    first = plain.where("pos = 0").select(*SEQ).distinct()
    assert first.count() == plain.select(*SEQ).distinct().count()


@pytest.mark.parametrize("part", [1, 2, 3, 100])
def test_walks_by_part_give_the_same(random_events, part):
    events, _ = random_events
    for step in (1, -1):
        near = sequences.with_neighbour(events, step, other="action_id")
        far = sequences.with_neighbour(events, step, part, other="action_id")
        assert rows(near.fillna(-9), *SEQ, "pos", "other") == rows(far.fillna(-9), *SEQ, "pos", "other")
    shape = [*SEQ, "pos", "device", "earlier", "n_earlier"]
    assert rows(sequences.earlier_device_counts(events), *shape) == rows(sequences.earlier_device_counts(events, part), *shape)
    shape = [*SEQ, "source", "target", "n_pairs", "n_sources_before_last"]
    assert rows(sequences.ordered_pair_counts(events), *shape) == rows(sequences.ordered_pair_counts(events, part), *shape)


def test_earlier_counts_are_all_ordered_pairs(random_events):
    events, data = random_events
    found = {
        (r.corpus_id, r.seq_id, r.pos, r.earlier): r.n_earlier
        for r in sequences.earlier_device_counts(events).where("n_earlier > 0").collect()
    }
    expected = {}
    for (corpus, name), quads in data.items():
        for j, _ in enumerate(quads):
            for i in range(j):
                key = (corpus, name, j, quads[i][2])
                expected[key] = expected.get(key, 0) + 1
    assert found == expected


def test_stored_events_come_back(random_events, spark, tmp_path):
    events, _ = random_events
    corpora.write_events(events, str(tmp_path / "events"))
    assert rows(corpora.read_events(spark, str(tmp_path / "events")), *EVENT_COLUMNS) == rows(events, *EVENT_COLUMNS)


def test_id_in_marks_unknown_words(spark):
    frame = spark.createDataFrame([("b",), ("z",)], "w string")
    assert [r[0] for r in frame.select(id_in(["a", "b"], F.col("w"))).collect()] == [1, -1]


def test_corpus_cells_group_nothing_by_sequence(random_events):
    events, data = random_events
    found = sequences.corpus_cells(events)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "seq_id" in line]
    counted = {}
    for (corpus, _), quads in data.items():
        devices = [q[2] for q in quads]
        seen = [("sequence", None, None), *[("device", d, None) for d in devices], *[("adjacent", *pair) for pair in zip(devices, devices[1:])]]
        seen += [("followed", d, e) for i, d in enumerate(devices) for e in set(devices[i + 1:]) if e != d]
        for cell in seen:
            counted[corpus, *cell] = counted.get((corpus, *cell), 0) + 1
    assert {tuple(r)[:4]: r.n for r in found.collect()} == counted
