"""Result tables: typed metric rows, comparisons, integrity checks."""

from pyspark.sql import DataFrame, functions as F

from habitloom.functions.columns import finite_or_null, true_or_false, whole_or_null

# Names of scenarios, environments and variants.
DATASETS = ("fr", "sp", "us")
ENV_BY_SCENARIO = {"st": "spring", "tt": "night", "nt": "multiple"}
KEPT_VARIANTS = (
    "baseline_gen", "causal_gss_only", "causal_tof_only", "full_causal",
    "zero_target_baseline", "zero_target_causal_gss", "zero_target_causal_tof", "zero_target_full",
    "target_assisted_full",
)
VARIANT_ALIASES = {
    "ablation_no_causal_tof": "causal_gss_only",
    "proposed_zero_target_causal_gss_codex": "causal_gss_only",
    "full_causal": "target_assisted_full",
    "proposed_causal_gss_codex_causal_tof": "target_assisted_full",
}
PROPOSED_VARIANT = "zero_target_full"

# Which stages a canonical variant has been through, and its stage label.
# Labels that would hold the name of a product begin with "published" here; pass a table of
# your own to ``variant_dimension`` for others.
VARIANT_STAGES = (
    # variant, original filter, causal_gss, causal_tof, input_stage
    ("baseline_gen", True, False, False, "published_gen_original_tof"),
    ("causal_gss_only", True, True, False, "causal_gss_plus_gen_original_tof"),
    ("causal_tof_only", True, False, True, "published_gen_original_tof_plus_causal_tof"),
    ("zero_target_baseline", True, False, False, "source_only_generation_plus_gen_original_tof"),
    ("zero_target_causal_gss", True, True, False, "source_only_causal_gss_plus_gen_original_tof"),
    ("zero_target_causal_tof", True, False, True, "source_only_generation_plus_gen_original_tof_plus_source_causal_tof"),
    ("zero_target_full", True, True, True, "source_only_causal_gss_plus_gen_original_tof_plus_source_causal_tof"),
    ("target_assisted_full", True, True, True, "target_assisted_causal_gss_plus_gen_original_tof_plus_target_assisted_causal_tof"),
)

# Fields of a metric row, in output order.
METRIC_ROW_FIELDS = (
    "dataset", "scenario", "seed", "variant", "input_pkl", "input_stage", "used_gen_original_tof",
    "used_causal_gss", "used_causal_tof", "downstream_pipeline", "generator", "generation_model",
    "num_generated_before_tof", "num_generated_after_gen_tof", "num_generated_after_causal_tof",
    "train_size", "validation_size", "test_size", "threshold", "threshold_source", "precision",
    "recall", "f1", "accuracy", "fpr", "fnr", "status", "run_dir", "metrics_path",
)
NUMBER_FIELDS = ("precision", "recall", "f1", "accuracy", "fpr", "fnr", "threshold")
COUNT_FIELDS = (
    "seed", "num_generated_before_tof", "num_generated_after_gen_tof", "num_generated_after_causal_tof",
    "train_size", "validation_size", "test_size",
)
FLAG_FIELDS = ("used_gen_original_tof", "used_causal_gss", "used_causal_tof")
REQUIRED_FIELDS = (
    "status", "dataset", "scenario", "seed", "variant", "precision", "recall", "f1", "fpr", "device", "requested_device",
)


def env_of(scenario):
    """Environment of a scenario in short or long form; anything else is an error."""
    name = F.col(scenario) if isinstance(scenario, str) else scenario
    chosen = F.raise_error(F.concat(F.lit("unknown scenario: "), F.coalesce(name, F.lit("null")))).cast("string")
    for short, env in ENV_BY_SCENARIO.items():
        chosen = F.when(name.isin(short, env), F.lit(env)).otherwise(chosen)
    return chosen


def cell_key(dataset, scenario):
    """Directory name of a cell, e.g. ``us_st``."""
    short = F.lit(None).cast("string")
    for name, env in ENV_BY_SCENARIO.items():
        short = F.when(env_of(scenario) == env, F.lit(name)).otherwise(short)
    return F.concat_ws("_", dataset, short)


def canonical_variant(variant):
    name = F.col(variant) if isinstance(variant, str) else variant
    chosen = name
    for old, new in VARIANT_ALIASES.items():
        chosen = F.when(name == old, F.lit(new)).otherwise(chosen)
    return chosen


def variant_dimension(spark, stages=VARIANT_STAGES) -> DataFrame:
    """``(variant, canonical, used_filter, used_causal_gss, used_causal_tof, input_stage)`` of all known names.

    ``stages`` are rows like those of ``VARIANT_STAGES``.
    """
    table = spark.createDataFrame(list(stages), "canonical string, used_filter boolean, used_causal_gss boolean, used_causal_tof boolean, input_stage string")
    names = spark.createDataFrame(
        [(name,) for name in dict.fromkeys([row[0] for row in stages] + list(VARIANT_ALIASES))], "variant string",
    ).withColumn("canonical", canonical_variant("variant"))
    return names.join(table, "canonical").select("variant", "canonical", "used_filter", "used_causal_gss", "used_causal_tof", "input_stage")


def typed_metric_rows(raw: DataFrame) -> DataFrame:
    """Metric rows with stable types; ``raw`` holds text or JSON-typed fields.

    Absent fields become null; ``metrics_path`` defaults to the file's path and
    ``run_dir`` to its directory, when a ``file_path`` column is there.
    """
    have = raw.columns

    def field(name):
        return F.nullif(F.col(name).cast("string"), F.lit("")) if name in have else F.lit(None).cast("string")

    path = field("file_path")
    typed = {name: field(name) for name in METRIC_ROW_FIELDS}
    typed["metrics_path"] = F.coalesce(typed["metrics_path"], path)
    typed["run_dir"] = F.coalesce(typed["run_dir"], F.regexp_replace(path, r"/[^/]*$", ""))
    typed["input_pkl"] = F.coalesce(typed["input_pkl"], field("synthetic_pkl"))
    for name in NUMBER_FIELDS:
        typed[name] = finite_or_null(typed[name])
    for name in COUNT_FIELDS:
        typed[name] = whole_or_null(typed[name])
    for name in FLAG_FIELDS:
        typed[name] = true_or_false(typed[name])
    return raw.select(*[typed[name].alias(name) for name in METRIC_ROW_FIELDS])


def is_diagnostic(path):
    """Exploratory runs: a ``diagnostic(s)`` directory, or a parent whose name has ``_beta``."""
    path = F.lower(F.col(path) if isinstance(path, str) else path)
    return path.rlike(r"(^|/)diagnostics?(/|$)") | path.rlike(r"_beta[^/]*/[^/]*$")


def kept_rows(rows: DataFrame) -> DataFrame:
    """Rows of the listed variants outside diagnostic directories, in report order."""
    return rows.where(F.col("variant").isin(*KEPT_VARIANTS) & ~F.coalesce(is_diagnostic("metrics_path"), F.lit(False)))


def in_report_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("dataset", "scenario", F.coalesce("seed", F.lit(-1)), "variant")


def ablation_table(rows: DataFrame) -> DataFrame:
    """One row per (dataset, scenario, seed) with the F1 of each variant; never averaged over seeds.

    If a coordinate has a variant twice, the last path wins.
    """
    table = (
        rows.groupBy("dataset", "scenario", F.coalesce("seed", F.lit(-1)).alias("seed"))
        .pivot("variant", list(KEPT_VARIANTS)).agg(F.max_by("f1", "metrics_path"))
    )
    return table.select("dataset", "scenario", "seed", *[F.col(v).alias(f"{v}_f1") for v in KEPT_VARIANTS])


# Which columns of a raw payload fill which fields of a normalized row, first one wins.
PAYLOAD_FIELDS = {
    "precision": ("precision",), "recall": ("recall",), "f1": ("F1 score", "F1", "f1"), "accuracy": ("accuracy",),
    "threshold": ("learned_threshold", "threshold"), "train_size": ("train_size",),
    "validation_size": ("threshold_vld_size", "vld_size"), "test_size": ("test_size",), "generated_size": ("synthetic_size",),
    "epochs": ("epochs",), "split_ratio": ("split_ratio",), "device": ("device",), "requested_device": ("requested_device",),
    "pipeline_result_path": ("result_path",), "run_dir": ("run_dir",), "synthetic_pkl": ("synthetic_pkl",), "train_pkl": ("train_pkl",),
    "validation_pkl": ("threshold_vld_pkl",), "target_test_pkl": ("target_test_pkl",), "attack_pkl": ("attack_pkl",),
    "input_pkl": ("generated_pkl",),
}


def normalized_metrics(payloads: DataFrame, percentiles: DataFrame, generator="source_distribution_driven", model="unknown") -> DataFrame:
    """Per-run metric rows from raw detector output.

    ``payloads`` holds dataset, scenario, seed, variant, dry_run, tp, tn, fp,
    fn and any of the columns named in ``PAYLOAD_FIELDS``; absent ones give
    nulls. ``percentiles`` is ``(dataset, env, percentile)``; a payload's own
    ``threshold_percentage`` goes before it. Corpus sizes come from
    ``current_size``, ``pre_filter_size``, ``filtered_size`` and the filter
    report's ``report_before`` and ``report_after``. Provenance columns are
    taken over, with defaults.
    """
    have = payloads.columns
    rows = payloads.withColumns({"env": env_of("scenario"), "variant": canonical_variant("variant")})
    rows = rows.join(percentiles.select("dataset", "env", F.col("percentile").alias("_percentile")), ["dataset", "env"], "left")
    stages = variant_dimension(payloads.sparkSession).where("variant = canonical").drop("canonical")
    rows = rows.join(F.broadcast(stages), "variant", "left")  # a row per variant

    def field(*names):
        present = [F.col(f"`{name}`") for name in names if name in have]
        return F.coalesce(*present) if present else F.lit(None)

    def size(*names):
        return field(*names).cast("bigint")

    tof = F.col("used_causal_tof")
    percentage = F.coalesce(field("threshold_percentage").cast("string"), F.col("_percentile").cast("string"))
    given = {name: field(*sources) for name, sources in PAYLOAD_FIELDS.items()}
    return rows.select(
        F.when(F.coalesce("dry_run", F.lit(False)), "dry_run").otherwise("success").alias("status"),
        "dataset", "scenario", "seed", "variant", "env", F.lit("gen_builtin_downstream_ad").alias("downstream_pipeline"),
        F.coalesce(field("generator").cast("string"), F.lit(generator)).alias("generator"),
        F.coalesce(field("generation_model").cast("string"), F.lit(model)).alias("generation_model"),
        F.coalesce(field("manual_generation").cast("boolean"), F.lit(True)).alias("manual_generation"),
        F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn")).alias("fpr"),
        F.try_divide(F.col("fn").cast("double"), F.col("fn") + F.col("tp")).alias("fnr"),
        F.concat(F.lit("validation_percentile_"), percentage).alias("threshold_source"), "tp", "tn", "fp", "fn",
        *[column.alias(name) for name, column in given.items()],
        F.coalesce(field("metrics_path").cast("string"), F.concat(given["run_dir"].cast("string"), F.lit("/downstream_ad_metrics.json"))).alias("metrics_path"),
        "input_stage", F.col("used_filter").alias("used_gen_original_tof"), "used_causal_gss", "used_causal_tof",
        size("pre_filter_size", "report_before").alias("num_generated_before_tof"),
        F.when(tof, size("filtered_size", "report_after")).otherwise(size("current_size")).alias("num_generated_after_gen_tof"),
        F.when(tof, size("current_size")).alias("num_generated_after_causal_tof"),
    )


def with_provenance(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Fill generator fields from a report in the same directory, else defaults.

    ``reports`` is ``(run_dir, generator, generation_model, manual_generation)``.
    """
    found = reports.select("run_dir", *[F.col(c).alias(f"_{c}") for c in ("generator", "generation_model", "manual_generation")])
    return rows.drop("generator", "generation_model", "manual_generation").join(found, "run_dir", "left").withColumns({
        "generator": F.coalesce("_generator", F.lit("source_distribution_driven")),
        "generation_model": F.coalesce("_generation_model", F.lit("unknown")),
        "manual_generation": F.coalesce("_manual_generation", F.lit(True)),
    }).drop("_generator", "_generation_model", "_manual_generation")


def result_issues(rows: DataFrame, seeds: DataFrame = None) -> DataFrame:
    """``(kind, path, detail)`` for results that are absent, unreadable or disagree with their path.

    Paths look like ``{dataset}_{scenario}/seed{n}/downstream_ad/{variant}/file``.
    Every seed needs a result of the proposed variant: those that have any
    result, and those of ``seeds``, a ``(cell, seed)`` table of the folders
    there are. A row with text in ``_corrupt_record`` is a document that could
    not be read; nothing else is said of it, and its seed counts as having one.
    """
    unreadable = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in rows.columns else F.lit(False)

    def part(pattern):
        return F.nullif(F.regexp_extract("path", pattern, 1), F.lit(""))

    rows = rows.withColumns({
        "_cell": part(r"([a-z]+_[a-z]+)/seed\d+/"), "_seed": part(r"/seed(\d+)/").cast("bigint"),
        "_variant": part(r"/downstream_ad/([^/]+)/"), "_dataset": part(r"([a-z]+)_[a-z]+/seed\d+/"),
    })
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED_FIELDS if f in rows.columns]))
    proposed = rows.where((F.col("_variant") == PROPOSED_VARIANT) & ~unreadable)
    broken = rows.where(unreadable).select(F.lit("invalid_json").alias("kind"), "path", F.lit("not a JSON object").alias("detail"))
    found = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.struct(F.lit("missing_metric_fields").alias("kind"), F.array_join(missing, ", ").alias("detail"))),
        F.when(
            ~F.col("variant").eqNullSafe(PROPOSED_VARIANT),
            F.struct(F.lit("variant_mismatch").alias("kind"), F.coalesce("variant", F.lit("None")).alias("detail")),
        ),
        F.when(
            ~F.col("seed").eqNullSafe(F.col("_seed")) | ~F.col("dataset").eqNullSafe(F.col("_dataset")),
            F.struct(F.lit("experiment_coordinate_mismatch").alias("kind"), F.lit("path and payload disagree").alias("detail")),
        ),
    ))
    wrong = proposed.select("path", F.explode(found).alias("_i")).select("_i.kind", "path", "_i.detail")
    coordinates = rows.select("_cell", "_seed", (F.col("_variant") == PROPOSED_VARIANT).alias("_is"))
    if seeds is not None:
        coordinates = coordinates.unionByName(seeds.select(F.col("cell").alias("_cell"), F.col("seed").cast("bigint").alias("_seed"), F.lit(False).alias("_is")))
    absent = coordinates.groupBy("_cell", "_seed").agg(F.count_if("_is").alias("_n")).where(F.col("_n") == 0).select(
        F.lit("missing_proposed_metrics").alias("kind"),
        F.concat(F.col("_cell"), F.lit("/seed"), F.col("_seed"), F.lit(f"/downstream_ad/{PROPOSED_VARIANT}/")).alias("path"),
        F.lit("seed has no normalized proposed result").alias("detail"),
    )
    return wrong.unionByName(broken).unionByName(absent)


def expected_assets(spark, templates: dict) -> DataFrame:
    """``(cell, name, path, required)`` for the nine cells: ``templates`` maps a name to ``(path, required)``.

    A path may hold ``{dataset}``, ``{env}`` and ``{scenario}``.
    """
    rows = [
        (f"{dataset}_{env}", name, path.format(dataset=dataset, env=env, scenario=scenario), required)
        for dataset in DATASETS for scenario, env in ENV_BY_SCENARIO.items() for name, (path, required) in templates.items()
    ]
    return spark.createDataFrame(rows, "cell string, name string, path string, required boolean")


def asset_report(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``(cell, name, path, status, num_rows)``: status ``ok``, ``missing`` or, for what is not required, ``optional_missing``.

    ``files`` is ``(path, num_rows)``.
    """
    found = files.select("path", F.col("num_rows").cast("bigint").alias("num_rows"), F.lit(True).alias("_found"))
    status = F.when(F.col("_found"), "ok").when(F.col("required"), "missing").otherwise("optional_missing")
    return expected.join(found, "path", "left").select("cell", "name", "path", status.alias("status"), "num_rows")


def missing_assets(files: DataFrame, required: DataFrame) -> DataFrame:
    """Required ``(cell, name, path)`` rows whose path is not in the file inventory."""
    return required.join(files.select("path"), "path", "left_anti")


def stage_funnel(rows: DataFrame, stages) -> DataFrame:
    """Corpus size per variant and stage, stages side by side; ``rows`` is one row per sequence and stage."""
    table = rows.groupBy("variant").pivot("stage", list(stages)).agg(F.count(F.lit(1)))
    return table.fillna(0, list(stages))


def variant_comparison(detection: DataFrame, quality: DataFrame) -> DataFrame:
    """F1 and FPR next to the corpus quality figures, one row per variant."""
    return detection.select("variant", "f1", "fpr").join(
        quality.select("variant", "device_distribution_kl", "transition_matrix_similarity", "causal_graph_similarity"),
        "variant", "full_outer",
    )
