"""Contiguous shards of nearly equal bytes from global prefix sums."""

from pyspark.sql import DataFrame, Window, functions as F

from habitloom.llm.common import pick, running_offsets
from habitloom.session import materialize


def balanced_shards(docs: DataFrame, n_shards: int, overhead: int = 8) -> DataFrame:
    """Put every document of ``(doc_id, text)`` into one of ``n_shards`` contiguous shards.

    Documents are ordered by ``doc_id`` (nulls first; ties by checksum and
    size, so that only equal rows are interchangeable). A document's size is
    the UTF-8 length of its text plus ``overhead``; a null text has length and
    checksum 0. Global byte offsets are prefix sums: rows are dealt by range
    and written once with their partition number, partition totals are summed
    in order, and each row adds its running sum inside the partition. A row
    goes to the shard in whose equal share of all bytes its middle byte lies,
    so a shard misses its target by less than its largest border document.

    Texts are dropped before the first shuffle. A hot ``doc_id`` is spread by
    checksum and size only if its texts differ; equal rows stay together as
    long as they need no more than one partition of 40-byte rows. An empty
    table gives no rows. Returns ``doc_id, size, text_crc32, shard, slot``;
    ``slot`` counts from 0 inside the shard.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    sized = pick(docs, "doc_id", "text").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + overhead).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    order = ("doc_id", "text_crc32", "size")
    parts = materialize(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-rows")

    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # One row per partition: safe to send to every executor.
    offsets = F.broadcast(running_offsets(totals, "part", "bytes", "rows"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = parts.withColumns({
        "end_in_part": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "row_in_part": F.row_number().over(inside) - 1,
    }).join(offsets, "part").withColumns({
        "start": F.expr("bytes_before + end_in_part - size"),
        "row": F.expr("rows_before + row_in_part"),
    }).withColumn("shard", F.expr(f"CAST((2 * start + size) * {n_shards} div (2 * bytes_all) AS INT)"))
    # A row per shard.
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first_row")))
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", F.expr("row - first_row").cast("bigint").alias("slot"),
    )
