"""Token totals per source, language and tokenizer version, kept up by signed deltas."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from habitloom.llm.common import pick
from habitloom.llm.wordpieces import word_pieces
from habitloom.session import materialize

GROUP = ("source", "lang", "version")


def token_counts(docs: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """``(doc_id, digest, source, lang, version, n_tokens)``: a row per row of ``docs``, over whole texts, written once.

    Null and empty texts have 0 tokens. ``digest`` is that of the text, null for none.
    """
    schema = "doc_id bigint, digest string, source string, lang string, n_tokens bigint"

    def count(batches):
        pieces = word_pieces(tokenizer_path)
        for batch in batches:
            sizes = [len(pieces.encode(t.as_py())) // pieces.dtype.itemsize for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64())], names=["doc_id", "digest", "source", "lang", "n_tokens"])

    rows = pick(docs, "doc_id", "text", "source", "lang").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("digest"), "source", "lang", "text")
    return materialize(rows.mapInArrow(count, schema).withColumn("version", F.lit(version)), "rollup-counts")


def inserted(counts: DataFrame) -> DataFrame:
    """Signed rows that add documents with their counts."""
    return counts.select(*GROUP, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Signed rows that take documents away, with the counts they were added with."""
    return counts.select(*GROUP, F.lit(-1).alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that replace counts, also where a document changed its group."""
    return deleted(old).unionByName(inserted(new))


def commit(store: str, batch: str, signed: DataFrame) -> None:
    """Write the signed rows of one batch, summed up per group, under its name.

    A batch is one folder of ``store`` that a later commit of the same name
    replaces: committing it again, after a failure or by mistake, leaves the
    totals as they are. A name is letters, digits, points, dashes and
    underscores. Sums are made before the shuffle, so a source with a third of
    all documents costs a row per task. Nulls in the group are a group.
    """
    if not re.fullmatch(r"[A-Za-z0-9.-][A-Za-z0-9._-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    sums = signed.groupBy(*GROUP).agg(F.sum("docs").cast("bigint").alias("docs"), F.sum("tokens").cast("bigint").alias("tokens"))
    sums.write.mode("overwrite").parquet(f"{store}/batch={batch}")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """``source, lang, version, docs, tokens`` over all committed batches; groups without documents or tokens are left out."""
    schema = "source string, lang string, version string, docs bigint, tokens bigint, batch string"
    return spark.read.schema(schema).parquet(store).groupBy(*GROUP).agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")


def later_copies(counts: DataFrame) -> DataFrame:
    """Rows whose text also stands in a row with a smaller id."""
    firsts = counts.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts.where("n > 1").select("digest", "first"), "rollup-firsts")
    return counts.join(firsts, "digest").where("doc_id > first").select(*counts.columns)
