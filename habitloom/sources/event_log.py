"""Turn a timestamped event log into the canonical sequence table."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitloom.model import EVENT_COLUMNS, HOURS_PER_SLOT, SEQ


def sequences_from_log(
    log: DataFrame, *, entity, ts, tie, device_id, action_id, corpus_id=None, per_second=False,
) -> DataFrame:
    """One sequence per corpus, entity and calendar day, ordered by ``ts`` then ``tie``.

    ``device_id``, ``action_id`` and ``corpus_id`` are columns over the log.
    Sequences are numbered by one window over one shuffle, which later
    per-sequence operators reuse. Where an entity may have more events a day
    than a task should sort, ``per_second`` numbers the events of each second
    and shifts them by the counts of earlier seconds: the same table from a
    plan with one more shuffle. Which plan runs is the caller's word, never
    the data's size.
    """
    rows = log.select(
        (F.lit("all") if corpus_id is None else corpus_id).alias("corpus_id"),
        F.concat_ws(":", F.col(entity).cast("string"), F.to_date(ts).cast("string")).alias("seq_id"),
        F.col(ts).alias("_ts"), F.col(tie).alias("_tie"),
        F.weekday(ts).cast("int").alias("day"),
        F.floor(F.hour(ts) / HOURS_PER_SLOT).cast("int").alias("hour_slot"),
        device_id.cast("int").alias("device_id"),
        action_id.cast("int").alias("action_id"),
    )
    if not per_second:
        place = F.row_number().over(Window.partitionBy(*SEQ).orderBy("_ts", "_tie")) - 1
        return rows.withColumn("pos", place).select(*EVENT_COLUMNS)

    rows = rows.withColumn("_second", F.date_trunc("SECOND", "_ts"))
    earlier = Window.partitionBy(*SEQ).orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*SEQ, "_second").agg(F.count(F.lit(1)).alias("_n"))
        .select(*SEQ, "_second", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    in_second = F.row_number().over(Window.partitionBy(*SEQ, "_second").orderBy("_ts", "_tie")) - 1
    return (
        rows.withColumn("_row", in_second).join(starts, [*SEQ, "_second"])
        .withColumn("pos", (F.col("_start") + F.col("_row")).cast("int")).select(*EVENT_COLUMNS)
    )


def id_in(vocabulary, value) -> Column:
    """Index of a text value in a short fixed vocabulary, -1 when unknown."""
    words = F.array(*[F.lit(word) for word in vocabulary])
    return F.array_position(words, value).cast("int") - 1
