"""Read and write sequence corpora."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from habitloom.model import CORPUS_SCHEMA, LABELLED_SCHEMA
from habitloom.session import materialize

LINE_SCHEMA = "sequence_id string, sequence string, start int, notes string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Flat sequences ``(corpus_id, seq_id, start, flat)`` from parquet; files without ``start`` hold whole sequences."""
    return spark.read.schema(CORPUS_SCHEMA).parquet(path).fillna(0, ["start"])


def read_labelled(spark: SparkSession, normal_path: str, attack_path: str) -> DataFrame:
    """Normal rows, labelled 0, followed by attack rows with the label they carry."""
    normal = spark.read.schema(LABELLED_SCHEMA).parquet(normal_path).withColumn("label", F.lit(0))
    return normal.unionByName(spark.read.schema(LABELLED_SCHEMA).parquet(attack_path))


def labelled(normal: DataFrame, attack: DataFrame) -> DataFrame:
    """As ``read_labelled``, from tables; works for flat rows and for events."""
    return normal.withColumn("label", F.lit(0)).unionByName(attack.withColumn("label", F.lit(1)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: ``(value, file_path, line_number)``, numbers from 1 in each file.

    Files are read in splits as always. A first pass counts the lines of every
    split; their prefix sums, one row per split, say with which line a split
    begins. Within a split, rows come in the order of the file. A line whose
    split the first pass did not meet (files changed in between) fails the job.
    """
    split = ("file_path", "_begin")
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_begin"),
        F.monotonically_increasing_id().alias("_row"))
    earlier = Window.partitionBy("file_path").orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(
        lines.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        .select(*split, (1 + F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")), "splits")
    unknown = F.raise_error(F.concat(F.lit("files changed while they were read: "), F.col("file_path"))).cast("bigint")
    return lines.join(splits, list(split), "left").select(
        "value", "file_path", F.coalesce(F.col("_row") + F.col("_shift"), unknown).alias("line_number"))


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited JSON ``{sequence_id, sequence, start, notes}``; blank lines are skipped.

    ``(sequence_id, start, sequence, notes, problem, file_path, line_number, line)``;
    ``line_number`` counts all lines of the file, blank ones too.
    ``problem`` is null for a list of whole numbers, else it is what the
    validator reports: ``missing_sequence``, ``sequence_not_list:<type>`` or
    ``non_integer_value:<value>``, or ``invalid_json`` for a line that can't be
    read at all; ``line`` then holds its text. Numbers with a fraction are cut
    towards zero, and whole numbers in text are read.
    """
    text = numbered_lines(spark, path).where(F.trim("value") != "").select(F.trim("value").alias("line"), "file_path", "line_number")
    parsed = text.withColumn("_object", F.from_json("line", LINE_SCHEMA)).withColumn(
        "_valid", F.coalesce(F.get_json_object("line", "$").startswith("{"), F.lit(False)))
    raw = F.col("_object.sequence")
    items = F.from_json(raw, "array<string>")
    number = lambda x: F.coalesce(x.try_cast("int"), F.when(~x.rlike("[a-zA-Z]"), x.try_cast("double").try_cast("int")))
    odd = F.filter(items, lambda x: number(x).isNull())
    is_list = F.coalesce(raw.startswith("["), F.lit(False))
    kind = F.when(raw.startswith("{"), "dict").when(raw.isin("true", "false"), "bool") \
        .when(F.get_json_object("line", "$").rlike('"sequence"\\s*:\\s*"'), "str").when(raw.rlike(r"^-?[0-9]+$"), "int").otherwise("float")
    problem = (
        F.when(~F.col("_valid"), "invalid_json").when(raw.isNull(), "missing_sequence")
        .when(~is_list, F.concat(F.lit("sequence_not_list:"), kind))
        .when(F.size(odd) > 0, F.concat(F.lit("non_integer_value:"), F.coalesce(F.get(odd, F.lit(0)), F.lit("null"))))
    )
    return parsed.select(
        F.col("_object.sequence_id").alias("sequence_id"), F.coalesce("_object.start", F.lit(0)).alias("start"),
        F.when(problem.isNull(), F.transform(items, number)).alias("sequence"), F.col("_object.notes").alias("notes"),
        problem.alias("problem"), "file_path", "line_number", F.when(problem == "invalid_json", F.col("line")).alias("line"))


def require_readable(generated: DataFrame) -> None:
    """Fail on the first line of ``read_generated`` that is not JSON, naming its file, line number and text."""
    found = generated.where(F.col("problem") == "invalid_json").select("file_path", "line_number", "line").orderBy("file_path", "line_number").head(1)
    if found:
        raise ValueError(f"invalid JSON in {found[0].file_path}, line {found[0].line_number}: {found[0].line[:200]}")


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """``(row_index, loss)`` from a JSON list, or an object holding ``reconstruction_losses``.

    One such file is one row in memory; losses of a large corpus come as a
    table ``(corpus_id, seq_id, loss)`` instead, as ``detect`` makes them.
    """
    text = F.col("value")
    values = F.coalesce(
        F.from_json(F.get_json_object(text, "$.reconstruction_losses"), "array<double>"),
        F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<double>")),
    )
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(values).alias("row_index", "loss"))
    )


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Flat sequences as parquet, one directory per corpus."""
    if "start" not in corpus.columns:
        corpus = corpus.withColumn("start", F.lit(0))
    corpus.select(*CORPUS_SCHEMA.names).write.mode("errorifexists").partitionBy("corpus_id").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events from parquet."""
    return spark.read.parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """Canonical events as parquet, clustered so that a sequence lies in one file, in order."""
    (
        events.repartition("corpus_id", "seq_id").sortWithinPartitions("corpus_id", "seq_id", "pos")
        .write.mode("errorifexists").parquet(path)
    )
