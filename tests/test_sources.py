import hashlib
import json

import pytest
from pyspark.sql import functions as F

from habitloom.operators import lineage, reporting, validate
from habitloom.sources import corpora, priors, reports, sinks, vocabulary


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_generated_lines(spark, tmp_path):
    lines = [
        '{"sequence_id": "x", "sequence": [0, 1, 2, 3], "notes": "n"}', "", '{"sequence_id": 7, "sequence": [4]}',
        '{"sequence_id": "a", "sequence": "0,1"}', '{"sequence_id": "b", "sequence": {"p": 1}}', '{"sequence_id": "c"}', '{"sequence_id": "d", "sequence": null}',
        '{"sequence_id": "e", "sequence": [1, "two"]}', '{"sequence_id": "f", "sequence": ["3", 4.7, null]}', '{"sequence_id": "g", "sequence": 5}',
        '{"sequence_id": "h", "sequence": [2.9], "start": 3}', "{oops",
    ]
    found = corpora.read_generated(spark, write(tmp_path / "bad.jsonl", "\n".join(lines)))
    rows = found.collect()
    assert {r.sequence_id: (r.sequence, r.problem) for r in rows if r.sequence_id} == {
        "x": ([0, 1, 2, 3], None), "7": ([4], None), "a": (None, "sequence_not_list:str"), "b": (None, "sequence_not_list:dict"),
        "c": (None, "missing_sequence"), "d": (None, "missing_sequence"), "e": (None, "non_integer_value:two"), "f": (None, "non_integer_value:null"),
        "g": (None, "sequence_not_list:int"), "h": ([2], None),
    }
    assert {r.start for r in rows if r.sequence_id == "h"} == {3}
    assert [(r.line, r.problem) for r in rows if r.line] == [("{oops", "invalid_json")] and all(r.file_path.endswith("bad.jsonl") for r in rows)
    with pytest.raises(ValueError, match="line 12: {oops"):
        corpora.require_readable(found)
    corpora.require_readable(found.where("problem IS NULL"))
    checked = validate.with_reasons(
        found.select(F.lit("c").alias("corpus_id"), F.col("sequence_id").alias("seq_id"), F.col("sequence").alias("flat"), "problem"),
        spark.createDataFrame([(2, "Lamp")], "device_id int, name string"), spark.createDataFrame([(3, "Lamp:on")], "action_id int, name string"),
    )
    reasons = {r.seq_id: r.reasons for r in checked.collect()}
    assert reasons["x"] == [] and reasons["a"] == ["sequence_not_list:str"] and reasons["7"] == ["length_not_multiple_of_4"]


def test_labelled_rows(spark, tmp_path):
    rows = spark.createDataFrame([("s", [0, 0, 1, 1], 1)], "seq_id string, flat array<int>, label int")
    rows.write.parquet(str(tmp_path / "rows"))
    found = corpora.read_labelled(spark, str(tmp_path / "rows"), str(tmp_path / "rows")).collect()
    assert sorted(r.label for r in found) == [0, 1]


@pytest.mark.parametrize("text", ["[0.5, -1, 2]", '{"reconstruction_losses": [0.5, -1, 2]}'])
def test_losses(spark, tmp_path, text):
    found = corpora.read_losses(spark, write(tmp_path / "l.json", text)).collect()
    assert [(r.row_index, r.loss) for r in found] == [(0, 0.5), (1, -1.0), (2, 2.0)]


def test_prior_documents(spark, tmp_path):
    full = {"matrix": [[0, 0.5], [0, 0]], "channel_to_key": ["d:1", "d:2"], "lag": 2, "method": "m"}
    path = write(tmp_path / "p.json", json.dumps(full, indent=1))
    assert [tuple(r) for r in priors.resolve_prior(spark, prior_path=path).edges.collect()] == [("d:1", "d:2", 0.5, 2, "m")]
    assert priors.resolve_prior(spark, prior_path=path).cells.count() == 4
    own = write(tmp_path / "o.json", json.dumps({**full, "top_causal_edges": [{"source_index": 1, "target": "d:9", "raw_weight": 0.125, "lag": 7}]}))
    assert [tuple(r) for r in priors.resolve_prior(spark, prior_path=own).edges.collect()] == [("d:2", "d:9", 0.125, 7, "m")]
    path = write(tmp_path / "q.json", json.dumps({"causal_matrix": [[0, 0], [0.25, 0]]}))
    assert [tuple(r) for r in priors.resolve_prior(spark, prior_path=path, level="action").edges.collect()] == [("a:1", "a:0", 0.25, 4, "existing_prior_json")]
    with pytest.raises(Exception, match="no matrix"):
        priors.read_prior(spark, write(tmp_path / "r.json", '{"lag": 1}')).collect()
    with pytest.raises(Exception, match="square"):
        priors.read_prior(spark, write(tmp_path / "s.json", '{"matrix": [[1, 2]]}')).collect()
    with pytest.raises(ValueError):
        priors.resolve_prior(spark)


@pytest.mark.parametrize("name,text", [("m.csv", "0, 0.5\n\n0.25,0\n"), ("m.json", "[[0, 0.5], [0.25, 0]]")])
def test_matrix_files(spark, tmp_path, name, text):
    path = write(tmp_path / name, text)
    found = [tuple(r)[:3] for r in priors.resolve_prior(spark, matrix_path=path).edges.collect()]
    assert found == [("d:0", "d:1", 0.5), ("d:1", "d:0", 0.25)]


def test_successors(spark, tmp_path):
    table = {"A:on": {"message": "x", "transitions": [{"next_action": "B:on", "count": 6}, {"next_action": "A:on", "count": 1}]}, "B:on": {"message": "none"}}
    found = priors.read_successors(spark, write(tmp_path / "t.json", json.dumps(table, indent=2)), "day")
    assert sorted(map(tuple, found.fillna("", ["next_action"]).fillna(0).collect())) == [
        ("day", "A:on", "A:on", 1, 2), ("day", "A:on", "B:on", 6, 1), ("day", "B:on", "", 0, 0),
    ]


def test_vocabularies(spark, tmp_path):
    path = write(tmp_path / "v.json", json.dumps({"devices": {"Lamp": 3, "Lock": 0}, "actions": {"7": "Lamp:switch off", "8": "Lock:lock", "x": "y"}}, indent=2))
    devices, actions = vocabulary.read_id_names(spark, path, "devices"), vocabulary.read_id_names(spark, path, "actions")
    assert sorted(map(tuple, devices.collect())) == [(0, "Lock"), (3, "Lamp")]
    assert {r.is_off for r in vocabulary.action_table(actions, devices).collect()} == {None}
    found = vocabulary.action_table(actions, devices, spark.createDataFrame([("Lamp:switch off",)], "name string"))
    assert sorted((r.action_id, r.device_id, r.is_off) for r in found.collect()) == [(7, 3, True), (8, 0, False)]
    plain = write(tmp_path / "w.json", '{"1": "a"}')
    assert [tuple(r) for r in vocabulary.read_id_names(spark, plain, "devices").collect()] == [(1, "a")]
    checked = validate.with_reasons(
        spark.createDataFrame([("c", "s", [0, 0, 3, 7])], "corpus_id string, seq_id string, flat array<int>"),
        *vocabulary.devices_and_actions(devices, actions),
    )
    assert checked.head().reasons == []


def test_metric_documents(spark, tmp_path):
    for folder, variant, score in (("fr_st/seed1/a", "zero_target_full", 0.5), ("diagnostics/a", "zero_target_full", 0.1), ("x_beta0", "zero_target_full", 0.2)):
        write(tmp_path / folder / "normalized_metrics.json", json.dumps({"dataset": "fr", "scenario": "st", "seed": 1, "variant": variant, "f1": score, "threshold": None, "used_causal_tof": True}, indent=2))
    write(tmp_path / "other.json", "{}")
    rows = reporting.typed_metric_rows(reports.read_metrics(spark, str(tmp_path))).collect()
    assert [(r.f1, r.used_causal_tof, r.seed) for r in rows] == [(0.5, True, 1)]
    assert rows[0].run_dir.endswith("fr_st/seed1/a")


def test_quality_documents(spark, tmp_path):
    payload = {"dataset": "fr", "variant": "v", "seed": 3, "device_distribution_kl": 0.5}
    write(tmp_path / "run/generation_quality/v/generation_quality_summary.json", json.dumps(payload))
    write(tmp_path / "run/elsewhere/generation_quality_summary.json", json.dumps(payload))
    found = reports.read_quality(spark, str(tmp_path)).collect()
    assert [(r.seed, r.device_distribution_kl) for r in found] == [(3, 0.5)] and "generation_quality/v" in found[0].summary_path


def test_lineage_documents(spark, tmp_path):
    event = {"event_index": 0, "operation": "read", "path": "p", "mode": "r", "target_normal": True, "target_attack": False}
    write(tmp_path / "s.json", json.dumps({"variant": "v", "stage": "s", "purpose": "filtering", "status": "success", "open_events": [event]}, indent=2))
    rows = reports.read_lineage(spark, str(tmp_path))
    assert [r.path for r in lineage.boundary_violations(rows).collect()] == ["p"]


def test_inventory_and_snapshots(spark, tmp_path):
    write(tmp_path / "a/x.txt", "hello")
    write(tmp_path / "y.txt", "world")
    before = reports.file_inventory(spark, str(tmp_path))
    found = {r.path: (r.size, r.sha256) for r in before.collect()}
    assert found == {name: (5, hashlib.sha256(text).hexdigest()) for name, text in (("a/x.txt", b"hello"), ("y.txt", b"world"))}
    kept = spark.createDataFrame(before.collect(), before.schema)
    digest = reports.manifest_digest(kept).head()
    assert digest.file_count == 2 and digest == reports.manifest_digest(reports.file_inventory(spark, str(tmp_path))).head()
    assert lineage.manifest_differences(kept, reports.file_inventory(spark, str(tmp_path))).count() == 0
    write(tmp_path / "y.txt", "World")
    after = reports.file_inventory(spark, str(tmp_path))
    assert sorted((r.path, r.side) for r in lineage.manifest_differences(kept, after).collect()) == [("y.txt", "after"), ("y.txt", "before")]
    assert digest != reports.manifest_digest(after).head()


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, float("nan"), [1.0, float("nan")]), (2, 0.5, None)], "id int, v double, a array<double>")
    sinks.write_json(frame, str(tmp_path / "j"))
    lines = sorted(line for p in (tmp_path / "j").glob("*.json") for line in p.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"id": 1, "v": None, "a": [1.0, None]}, {"id": 2, "v": 0.5, "a": None}]
    sinks.write_csv(frame, str(tmp_path / "c"), ["v", "id", "missing"])
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert text.count("v,id,missing") >= 1 and "0.5,2," in text
    corpus = spark.createDataFrame([("c", "s", [1, 2, 3, 4])], "corpus_id string, seq_id string, flat array<int>")
    corpora.write_corpus(corpus, str(tmp_path / "corpus"))
    assert corpora.read_corpus(spark, str(tmp_path / "corpus")).head().flat == [1, 2, 3, 4]


@pytest.mark.parametrize("size", [1, 37, 1000, 10**6])
def test_line_numbers_in_split_files(spark, tmp_path, size):
    texts = {
        "a.txt": ["x" * (i % 23) for i in range(700)], "b.txt": ["", "one", ""], "c.txt": [], "d.txt": ["y" * 3000, "", "z"],
        "e.txt": [f"é{i}" for i in range(90)],
    }
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(line + "\n" for line in lines), newline="\r\n" if name == "e.txt" else "\n")
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", max(size, 20))
    session.conf.set("spark.sql.files.openCostInBytes", size % 50)
    found = corpora.numbered_lines(session, str(tmp_path)).collect()
    by_file = {}
    for r in found:
        by_file.setdefault(r.file_path.rsplit("/", 1)[1], []).append((r.line_number, r.value))
    assert {name: sorted(rows) for name, rows in by_file.items()} == {name: list(enumerate(lines, 1)) for name, lines in texts.items() if lines}
