import pytest
from pyspark.sql import functions as F

from habitloom.operators import lineage, reporting, validate


@pytest.fixture(scope="module")
def vocabulary(spark):
    devices = spark.createDataFrame([(11, "Lamp"), (13, "Lock"), (0, "None"), (1, "Other")], "device_id int, name string")
    actions = spark.createDataFrame(
        [(68, "Lamp:switch on"), (80, "Lock:lock"), (5, "None:location"), (90, "Gone:x")], "action_id int, name string",
    )
    return devices, actions


def check(spark, vocabulary, flats, **options):
    rows = [("c", str(i), f) for i, f in enumerate(flats)]
    corpus = spark.createDataFrame(rows, "corpus_id string, seq_id string, flat array<int>")
    return validate.with_reasons(corpus, *vocabulary, **options)


def test_reasons(spark, vocabulary):
    flats = [
        [0, 1, 11, 68, 6, 7, 13, 80], [0, 1, 11, 80], [0, 0, 1, 5], [0, 0, 0, 5], [7, 8, 99, 99], [0, 0, 11], None, [],
        [0, 0, None, 68], [0, 0, 13, 90],
    ]
    found = [r.reasons for r in check(spark, vocabulary, flats).orderBy(F.col("seq_id").cast("int")).collect()]
    assert found == [
        [], ["device_action_mismatch@event_0:device=11,action=80,expected_device=13"], [], [],
        ["day_out_of_range@event_0:7", "hour_slot_out_of_range@event_0:8", "illegal_device_id@event_0:99", "illegal_action_id@event_0:99"],
        ["length_not_multiple_of_4"], ["missing_sequence"], ["empty_sequence"], ["non_integer_value"], [],
    ]


def test_ids_far_apart(spark):
    devices = spark.createDataFrame([(1, "Lamp"), (2_000_000_000, "Lock")], "device_id int, name string")
    actions = spark.createDataFrame([(1, "Lamp:on"), (2_000_000_000, "Lock:lock"), (-2_000_000_000, "Lock:open")], "action_id int, name string")
    flats = [[0, 0, 1, 1, 0, 0, 2_000_000_000, 2_000_000_000], [0, 0, 2_000_000_000, -2_000_000_000], [0, 0, 1, 2], [0, 0, 1, 2_000_000_000]]
    found = [r.reasons for r in check(spark, (devices, actions), flats).orderBy("seq_id").collect()]
    assert found == [[], [], ["illegal_action_id@event_0:2"], ["device_action_mismatch@event_0:device=1,action=2000000000,expected_device=2000000000"]]
    none = check(spark, (devices, actions.where("false")), [[0, 0, 1, 1]]).head().reasons
    assert none == ["illegal_action_id@event_0:1"]


def test_report(spark, vocabulary):
    good = [0, 1, 11, 68, 6, 7, 13, 80]
    report = validate.validation_report(check(spark, vocabulary, [good, good, good], expected_length=8), 3).head()
    assert (report.status, report.num_valid, report.unique_sequence_count, report.duplicate_sequence_count) == ("valid", 3, 1, 2)
    assert report.duplicate_rate == pytest.approx(2 / 3)
    report = validate.validation_report(check(spark, vocabulary, [good, good[:4]], expected_length=8), 2).head()
    assert (report.status, report.num_invalid) == ("invalid", 1)


def test_lenient(spark):
    rows = [("c", "0", [1, 2, 3, 4]), ("c", "1", []), ("c", "2", None), ("c", "3", [1]), ("c", "4", [1, None, 2, 3])]
    corpus = spark.createDataFrame(rows, "corpus_id string, seq_id string, flat array<int>")
    assert [r.seq_id for r in validate.lenient(corpus).collect()] == ["0"]


def test_names(spark):
    frame = spark.createDataFrame([("us", "spring", "full_causal"), ("us", "st", "zero_target_full")], "d string, s string, v string")
    found = frame.select(reporting.cell_key("d", "s"), reporting.canonical_variant("v")).collect()
    assert [tuple(r) for r in found] == [("us_st", "target_assisted_full"), ("us_st", "zero_target_full")]
    with pytest.raises(Exception, match="unknown scenario"):
        spark.createDataFrame([("autumn",)], "s string").select(reporting.env_of("s")).collect()


def test_report_rows_leave_out_diagnostics(spark):
    paths = ["runs/a/m.json", "runs/Diagnostics/a/m.json", "runs/x_beta0/m.json", "runs/x_beta0/y/m.json", "runs/b/m.json"]
    raw = spark.createDataFrame(
        [("fr", "st", "2024", v, p, "0.5") for v, p in zip(["zero_target_full"] * 4 + ["unknown"], paths)],
        "dataset string, scenario string, seed string, variant string, file_path string, f1 string",
    )
    rows = reporting.kept_rows(reporting.typed_metric_rows(raw))
    assert sorted(r.metrics_path for r in rows.collect()) == ["runs/a/m.json", "runs/x_beta0/y/m.json"]
    first = rows.where("metrics_path = 'runs/a/m.json'").head()
    assert (first.seed, first.run_dir, first.f1, first.threshold) == (2024, "runs/a", 0.5, None)


def test_ablation_never_averages(spark):
    rows = spark.createDataFrame(
        [("fr", "st", 1, "baseline_gen", 0.2, "a"), ("fr", "st", 1, "baseline_gen", 0.1, "b"), ("fr", "st", 2, "zero_target_full", 0.9, "c")],
        "dataset string, scenario string, seed bigint, variant string, f1 double, metrics_path string",
    )
    found = {r.seed: r for r in reporting.ablation_table(rows).collect()}
    assert found[1].baseline_gen_f1 == 0.1 and found[1].zero_target_full_f1 is None and found[2].zero_target_full_f1 == 0.9


def test_integrity(spark):
    rows = spark.createDataFrame(
        [("fr_st/seed2024/downstream_ad/zero_target_full/m.json", "sp", 9, "wrong", None),
         ("us_tt/seed1/downstream_ad/zero_target_full/m.json", "us", 1, "zero_target_full", "ok"),
         ("us_nt/seed3/downstream_ad/zero_target_baseline/m.json", "us", 3, "zero_target_baseline", "ok")],
        "path string, dataset string, seed bigint, variant string, status string",
    )
    found = sorted((r.kind, r.path.split("/")[0]) for r in reporting.result_issues(rows).collect())
    assert found == [
        ("experiment_coordinate_mismatch", "fr_st"), ("missing_metric_fields", "fr_st"),
        ("missing_proposed_metrics", "us_nt"), ("variant_mismatch", "fr_st"),
    ]


def test_provenance_and_assets(spark):
    rows = spark.createDataFrame([("r1",), ("r2",)], "run_dir string")
    reports = spark.createDataFrame([("r1", "g", "m", False)], "run_dir string, generator string, generation_model string, manual_generation boolean")
    found = {r.run_dir: r for r in reporting.with_provenance(rows, reports).collect()}
    assert found["r1"].generator == "g" and found["r2"].generation_model == "unknown" and found["r2"].manual_generation
    files = spark.createDataFrame([("a",)], "path string")
    required = spark.createDataFrame([("fr_st", "x", "a"), ("fr_st", "y", "b")], "cell string, name string, path string")
    assert [r.name for r in reporting.missing_assets(files, required).collect()] == ["y"]


COLUMNS = (
    "variant string, stage string, stage_order int, purpose string, event_index int, operation string, path string,"
    " target_normal boolean, target_attack boolean"
)


def test_boundary(spark):
    blocked = spark.createDataFrame([("v", "s", 0, "filtering", 0, "read", "t", True, False)], COLUMNS)
    allowed = spark.createDataFrame([("v", "s", 0, "downstream_ad_evaluation", 0, "read", "t", True, False)], COLUMNS)
    assert lineage.boundary_violations(blocked).count() == 1
    with pytest.raises(RuntimeError, match="before evaluation"):
        lineage.require_clean(blocked)
    lineage.require_clean(allowed)
    assert lineage.stage_lineage(allowed).head().target_normal_consumed
    marked = lineage.mark_protected(allowed, spark.createDataFrame([("t", "attack")], "path string, kind string")).head()
    assert (marked.target_normal, marked.target_attack) == (False, True)


def test_merge_and_feedback(spark):
    rows = spark.createDataFrame([
        ("v", "a", 0, "filtering", 0, "read", "x", False, False), ("v", "a", 0, "filtering", 1, "read", "q", False, False),
        ("v", "b", 1, "offline_generation_quality_evaluation", 0, "write", "q", False, False),
        ("v", "b", 1, "offline_generation_quality_evaluation", 1, "read", "t", True, False),
    ], COLUMNS)
    assert sorted((r.path, r.merged_index) for r in lineage.merged_events(rows).collect()) == [("q", 1), ("q", 2), ("t", 3), ("x", 0)]
    assert [r.path for r in lineage.feedback_paths(rows).collect()] == ["q"]
    merged = lineage.variant_lineage(lineage.stage_lineage(rows)).head()
    assert merged.target_normal_consumed and not merged.pre_evaluation_target_normal_consumed
    assert (merged.num_stages, merged.num_events, merged.status) == (2, 4, "success")
