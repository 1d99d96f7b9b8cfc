"""Read run reports: metrics, quality summaries, lineage, file inventories."""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from habitloom.operators.reporting import METRIC_ROW_FIELDS, is_diagnostic

_METRIC_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in METRIC_ROW_FIELDS]
    + [T.StructField(name, T.StringType()) for name in ("synthetic_pkl", "device", "requested_device", "_corrupt_record")]
)

_QUALITY_SCHEMA = (
    "dataset string, scenario string, seed bigint, variant string, num_target_sequences bigint,"
    " num_synthetic_sequences bigint, device_distribution_kl double, transition_matrix_similarity double,"
    " causal_graph_similarity double"
)

_LINEAGE_SCHEMA = (
    "variant string, stage string, stage_order int, purpose string, status string, open_events array<struct<"
    "event_index:bigint,operation:string,path:string,target_normal:boolean,target_attack:boolean>>"
)


def _documents(spark, root, file_name, schema, lines):
    """JSON documents named ``file_name`` anywhere under ``root``, with their ``file_path``.

    A file is one document, or one per line when ``lines`` is set.
    """
    return (
        spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", file_name)
        .option("multiLine", not lines).json(root).withColumn("file_path", F.col("_metadata.file_path"))
    )


def read_metrics(spark: SparkSession, root: str, file_name="normalized_metrics.json", lines=False) -> DataFrame:
    """Raw metric documents outside diagnostic runs; pass them to ``typed_metric_rows``."""
    return _documents(spark, root, file_name, _METRIC_SCHEMA, lines).where(~is_diagnostic("file_path"))


def read_quality(spark: SparkSession, root: str, file_name="generation_quality_summary.json", lines=False) -> DataFrame:
    """Quality summaries ``…/generation_quality/<name>/<file_name>``, one row per seed."""
    rows = _documents(spark, root, file_name, _QUALITY_SCHEMA, lines)
    return (
        rows.where(F.col("file_path").rlike(r"/generation_quality/[^/]+/[^/]+$"))
        .withColumnRenamed("file_path", "summary_path")
    )


def read_lineage(spark: SparkSession, root: str, file_name="*.json", lines=False) -> DataFrame:
    """Lineage documents as one row per open event."""
    rows = _documents(spark, root, file_name, _LINEAGE_SCHEMA, lines)
    return rows.select("variant", "stage", "stage_order", "purpose", "status", F.explode("open_events").alias("_e")).select(
        "variant", "stage", "stage_order", "purpose", "status", "_e.*",
    )


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, sha256)`` of every file under ``root``, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # A local path is written in several ways: with or without a scheme, with one slash or three.
    base = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base), "")
    return files.select(relative.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_digest(inventory: DataFrame) -> DataFrame:
    """``(file_count, manifest_sha256)``: one digest over the ordered per-file digests.

    Files are first digested per leading byte of their path's md5, so that no
    task holds the whole list.
    """
    line = F.concat_ws("|", "path", F.col("size").cast("string"), "sha256")
    groups = inventory.groupBy(F.substring(F.md5("path"), 1, 3).alias("_group")).agg(
        F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("_digest"),
    )
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_group", "_digest"))), lambda g: g["_digest"]), "\n")
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("file_count"), F.sha2(ordered, 256).alias("manifest_sha256"))
