"""Exact order statistics that never gather all rows in one task.

All functions work in two steps: count rows per bucket of the sort key, then
order rows only inside a bucket. Buckets decide how work is spread; the
result does not depend on them.
"""

from pyspark.sql import DataFrame, Window, functions as F

from habitloom.session import materialize

_BEFORE = (Window.unboundedPreceding, -1)


def uniform_bucket(value):
    """65,536 equal buckets for a number in (0, 1)."""
    return F.floor(value * 65536).cast("int")


def log_bucket(value):
    """1,024 buckets per factor of two, over the whole range of positive numbers; one more on either side."""
    exact = F.floor(F.log2(value) * 1024).cast("int")
    return F.when(value <= 0, F.lit(-(2**30))).when(value == float("inf"), F.lit(2**30)).otherwise(exact)


def smallest_cutoff(rows: DataFrame, key: list, bucket, count, error="not enough rows", by=()) -> DataFrame:
    """One row ``cutoff``: the key of the ``count``-th smallest row, as a struct; with ``by``, one row per group, all in one job.

    ``key`` lists columns whose values together are unique. Rows belong to the
    smallest ``count`` exactly if their key struct is at most the cutoff, a
    test each row can make by itself, so the rows are never shuffled. ``count``
    is a function of the column holding the number of rows. ``bucket`` must
    rise with the first key and take at most some 10^6 values: the bucket
    table of a group is ordered in one task, and then the rows of one bucket are.
    """
    by = list(by)
    in_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = Window.partitionBy(*by).orderBy("_bucket")
    wanted = count(F.col("_total")).cast("bigint")
    table = (
        rows.groupBy(*by, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(*_BEFORE)), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(in_group))
        .withColumn("_cut", F.when(wanted > F.col("_total"), F.raise_error(error).cast("bigint")).otherwise(wanted))
    )
    crossed = (F.col("_before") < F.col("_cut")) & (F.col("_cut") <= F.col("_before") + F.col("_n"))
    # A row per group.
    bound = F.broadcast(table.where(crossed).select(*by, "_bucket", (F.col("_cut") - F.col("_before")).alias("_place")))
    near = rows.select(*by, F.struct(*key).alias("cutoff"), bucket.alias("_bucket")).join(bound, [*by, "_bucket"])
    placed = near.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("cutoff")))
    return materialize(placed.where(F.col("_row") == F.col("_place")).select(*by, "cutoff"), "cutoff")


def within(key: list, cutoff: DataFrame):
    """Whether a row is among the smallest, given ``smallest_cutoff``."""
    return F.coalesce(F.struct(*key) <= cutoff.select("cutoff").scalar(), F.lit(False))


def value_bucket(value):
    """4,096 buckets per factor of two on either side of zero, rising with the value: some 17 million for all doubles, whatever their range."""
    x = F.abs(value)
    size = F.when(x == float("inf"), F.lit(2**24)).otherwise(F.floor(F.log2(x) * 4096).cast("bigint") + 2**23)
    return F.when(F.isnan(value), F.lit(2**25)).when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("bigint")


def exact_percentiles(rows: DataFrame, value: str, quantiles: dict, by=()) -> DataFrame:
    """Linearly interpolated percentiles per group, as columns.

    ``quantiles`` maps a name to a fraction (a number, or a column made of the
    ``by`` columns). Equal values are counted together first, so a value held
    by a third of all rows costs one row; the rest is spread over buckets whose
    width grows with the value, so that few decades or many make no difference.
    NaN is greater than any number.
    """
    by = list(by)
    values = (
        rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", value_bucket(F.col("_value").cast("double")))
    )
    values = materialize(values, "values")  # read twice below
    in_group = Window.partitionBy(*by)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(q).cast("double").alias("q")) if isinstance(q, (int, float))
        else F.struct(F.lit(name).alias("name"), q.cast("double").alias("q"))
        for name, q in quantiles.items()
    ])
    # At most two buckets per group and quantile remain.
    needed = (
        values.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(in_group.orderBy("_bucket").rowsBetween(*_BEFORE)), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(in_group))
        .withColumn("_wanted", F.explode(wanted))
        .withColumn("_at", (F.col("_total") - 1) * F.col("_wanted.q"))
        .where((F.floor("_at") < F.col("_before") + F.col("_n")) & (F.ceil("_at") >= F.col("_before")))
        .select(*by, "_bucket", "_before", F.col("_wanted.name").alias("_name"), "_at")
    )
    inside = Window.partitionBy(*by, "_name", "_bucket").orderBy("_value")
    upto = F.col("_before") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = values.join(F.broadcast(needed), [*by, "_bucket"]).withColumn("_upto", upto)

    def at(rank, name):
        hit = (F.col("_name") == name) & (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(hit, F.col("_value")))

    columns = []
    for name in quantiles:
        low, high = at(F.floor("_at"), name), at(F.ceil("_at"), name)
        place = F.max(F.when(F.col("_name") == name, F.col("_at")))
        columns.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return placed.groupBy(*by).agg(*columns)


def with_rank(rows: DataFrame, order, name="rank") -> DataFrame:
    """Add the 1-based place of every row in the total order ``order``.

    The rows are range-partitioned (which also splits runs of equal leading
    keys, as the order is total) and written once, so that the number of rows
    before each partition and the places inside it speak of the same split.
    """
    spread = materialize(
        rows.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()), "ranked"
    )
    starts = (
        spread.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .select("_chunk", F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(*_BEFORE)), F.lit(0)).alias("_before"))
    )
    place = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    # One row per partition of the range split.
    return (
        spread.join(F.broadcast(starts), "_chunk")
        .withColumn(name, F.col("_before") + place).drop("_chunk", "_before")
    )
