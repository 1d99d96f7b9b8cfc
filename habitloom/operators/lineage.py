"""Audit of which files each pipeline stage read and wrote.

Lineage rows: ``variant, stage, stage_order, purpose, event_index, operation,
path, target_normal, target_attack``; ``event_index`` runs 0..n-1 in a stage.
File lists are kept long, one row per file, so none is gathered.
"""

from pyspark.sql import DataFrame, Window, functions as F

# Purposes that may read target data.
EVALUATION_PURPOSES = ("offline_generation_quality_evaluation", "downstream_ad_evaluation")
QUALITY_PURPOSE = "offline_generation_quality_evaluation"


def mark_protected(events: DataFrame, protected: DataFrame) -> DataFrame:
    """Set the two target flags from a ``(path, kind)`` table, kind ``normal`` or ``attack``."""
    kinds = protected.groupBy("path").agg(
        F.bool_or(F.col("kind") == "normal").alias("target_normal"), F.bool_or(F.col("kind") == "attack").alias("target_attack"),
    )
    return events.drop("target_normal", "target_attack").join(kinds, "path", "left").fillna(False, ["target_normal", "target_attack"])


def stage_files(events: DataFrame, by=("variant", "stage")) -> DataFrame:
    """``(*by, role, path, first_index)``: distinct files per role, ordered by first use.

    Roles: ``consumed``, ``produced``, ``target_normal``, ``target_attack``.
    """
    read, wrote = F.col("operation") == "read", F.col("operation") == "write"
    roles = F.array_compact(F.array(
        F.when(read, F.lit("consumed")), F.when(wrote, F.lit("produced")),
        F.when(read & F.col("target_normal"), F.lit("target_normal")),
        F.when(read & F.col("target_attack"), F.lit("target_attack")),
    ))
    rows = events.select(*by, "path", "event_index", F.explode(roles).alias("role"))
    return rows.groupBy(*by, "role", "path").agg(F.min("event_index").alias("first_index"))


def stage_lineage(events: DataFrame) -> DataFrame:
    """One row per stage: its purpose, status, number of events and whether target data was read.

    A stage is a success only if each of its events says so; events without a ``status`` count as such.
    """
    read = F.col("operation") == "read"
    status = F.coalesce("status", F.lit("success")) if "status" in events.columns else F.lit("success")
    return events.groupBy("variant", "stage", "stage_order").agg(
        F.min("purpose").alias("purpose"),
        F.coalesce(F.min(F.when(status != "success", status)), F.lit("success")).alias("status"), F.count(F.lit(1)).alias("num_events"),
        F.count_if(read).alias("num_reads"), F.count_if(~read).alias("num_writes"),
        F.bool_or(read & F.col("target_normal")).alias("target_normal_consumed"),
        F.bool_or(read & F.col("target_attack")).alias("target_attack_consumed"),
    )


def boundary_violations(events: DataFrame) -> DataFrame:
    """Reads of target data in a stage that is not an evaluation."""
    touched = F.col("target_normal") | F.col("target_attack")
    return events.where((F.col("operation") == "read") & touched & ~F.col("purpose").isin(*EVALUATION_PURPOSES))


def require_clean(events: DataFrame) -> None:
    """Fail if any violation exists; looks at one row only."""
    found = boundary_violations(events).select("variant", "stage", "path").head(1)
    if found:
        row = found[0]
        raise RuntimeError(f"target data read before evaluation: variant={row.variant} stage={row.stage} path={row.path}")


def merged_events(events: DataFrame) -> DataFrame:
    """Stages of a variant strung together: ``merged_index`` counts on across stages.

    Only per-stage counts are ordered; a variant has a handful of stages.
    """
    before = Window.partitionBy("variant").orderBy("stage_order").rowsBetween(Window.unboundedPreceding, -1)
    starts = events.groupBy("variant", "stage_order").agg(F.count(F.lit(1)).alias("_n")).select(
        "variant", "stage_order", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    return (
        events.join(starts, ["variant", "stage_order"])
        .withColumn("merged_index", F.col("_start") + F.col("event_index")).drop("_start")
    )


def variant_lineage(stages: DataFrame) -> DataFrame:
    """Roll ``stage_lineage`` rows up to one row per variant."""
    early = ~F.col("purpose").isin(*EVALUATION_PURPOSES)
    normal, attack = F.col("target_normal_consumed"), F.col("target_attack_consumed")
    status = F.when(F.bool_and(F.col("status") == "success"), "success").otherwise("mixed_or_blocked")
    return stages.groupBy("variant").agg(
        F.count(F.lit(1)).alias("num_stages"), F.sum("num_events").alias("num_events"),
        F.bool_or(normal).alias("target_normal_consumed"), F.bool_or(attack).alias("target_attack_consumed"),
        F.bool_or(early & normal).alias("pre_evaluation_target_normal_consumed"),
        F.bool_or(early & attack).alias("pre_evaluation_target_attack_consumed"),
        status.alias("status"),
    )


def feedback_paths(events: DataFrame) -> DataFrame:
    """Files written by a quality evaluation and read by an earlier kind of stage; should be empty."""
    outputs = events.where((F.col("purpose") == QUALITY_PURPOSE) & (F.col("operation") == "write")).select("path")
    upstream = events.where(~F.col("purpose").isin(*EVALUATION_PURPOSES) & (F.col("operation") == "read")).select("path")
    return outputs.intersect(upstream)


def manifest_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two ``(path, size, sha256)`` inventories that are not in both, with ``side``."""
    columns = ["path", "size", "sha256"]
    before, after = before.select(*columns), after.select(*columns)
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(
        after.exceptAll(before).withColumn("side", F.lit("after"))
    )
