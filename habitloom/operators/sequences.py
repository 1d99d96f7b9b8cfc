"""Building blocks that walk along a sequence.

By default a sequence is handled whole inside one task. Where sequences may be
too long for that, the caller gives ``part_events``: work is then split every so
many positions. This changes the plan, never a result or a schema.
"""

from pyspark.sql import DataFrame, Window, functions as F

from habitloom.functions.columns import events_of_flat, pad_or_truncate
from habitloom.model import EVENT_COLUMNS, FIELDS_PER_EVENT, PADDED_LENGTH, SEQ


def flat_to_events(corpus: DataFrame) -> DataFrame:
    """Canonical events of ``(corpus_id, seq_id, flat)`` rows.

    A column ``start`` says where a row goes on in its sequence; null or absent is 0.
    """
    start = F.coalesce("start", F.lit(0)) if "start" in corpus.columns else F.lit(0)
    rows = corpus.select(*SEQ, start.alias("_start"), F.explode(events_of_flat("flat")).alias("_e"))
    return rows.select(*SEQ, (F.col("_start") + F.col("_e.pos")).alias("pos"), *[f"_e.{c}" for c in EVENT_COLUMNS[3:]])


def _gathered(events, value, name, keep, part_events):
    """Ordered values per sequence, or per part of it."""
    start = F.lit(0) if part_events is None else F.floor(F.col("pos") / part_events) * part_events
    ordered = F.array_sort(F.collect_list(F.struct("pos", value.alias("_value"))))
    return (
        events.withColumn("start", start.cast("int")).groupBy(*SEQ, "start", *keep).agg(ordered.alias("_rows"))
        .withColumn(name, F.transform("_rows", lambda row: row["_value"])).drop("_rows")
    )


def events_to_flat(events: DataFrame, keep=(), part_events=None) -> DataFrame:
    """Flat integer lists ``(corpus_id, seq_id, start, flat)``.

    One row per sequence, which must fit in memory; with ``part_events`` a
    sequence goes on in further rows, and ``start`` is the first position of each.
    """
    quad = F.array(*[F.col(c).cast("int") for c in EVENT_COLUMNS[3:]])
    rows = _gathered(events, quad, "_quads", list(keep), part_events)
    return rows.withColumn("flat", F.flatten("_quads")).drop("_quads")


def id_lists(events: DataFrame, part_events=None) -> DataFrame:
    """Ordered device and action ids ``(corpus_id, seq_id, start, device_ids, action_ids)``, in rows as ``events_to_flat``."""
    pair = F.struct(F.col("device_id").alias("d"), F.col("action_id").alias("a"))
    rows = _gathered(events, pair, "_pairs", [], part_events)
    return rows.select(
        *SEQ, "start",
        F.transform("_pairs", lambda p: p["d"]).alias("device_ids"),
        F.transform("_pairs", lambda p: p["a"]).alias("action_ids"),
    )


def padded_lists(events: DataFrame, vocab_size: int, length=PADDED_LENGTH) -> DataFrame:
    """``(corpus_id, seq_id, padded)``: flat lists of fixed length, one per sequence.

    Only events that have a place in the list are gathered, so a row is small
    however long its sequence is.
    """
    rows = events_to_flat(events.where(F.col("pos") * FIELDS_PER_EVENT < length))
    return rows.select(*SEQ, pad_or_truncate("flat", vocab_size, length).alias("padded"))


def with_neighbour(events: DataFrame, step: int, part_events=None, **wanted) -> DataFrame:
    """Add columns of the event ``step`` places later (negative: earlier).

    ``wanted`` maps the new column name to the column to fetch. The columns
    are null where the sequence has no such event. With ``part_events`` the
    neighbour is found by an equi-join on the position.
    """
    if part_events is None:
        order = Window.partitionBy(*SEQ).orderBy("pos")
        return events.withColumns({name: F.lead(source, step).over(order) for name, source in wanted.items()})
    shifted = events.select(
        *SEQ, (F.col("pos") - step).alias("pos"), *[F.col(source).alias(name) for name, source in wanted.items()],
    )
    return events.join(shifted, [*SEQ, "pos"], "left")


def _running_counts(rows, group):
    """Per event and device already met in ``group``: how often it was met before.

    ``rows`` holds ``pos, device, n``; rows with ``pos`` -1 bring counts carried
    in from earlier parts. The sort is local: the shuffle on the sequence is reused.
    """
    everything = Window.partitionBy(*group)
    before = Window.partitionBy(*group, "earlier").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    met = F.sum(F.when(F.col("device") == F.col("earlier"), F.col("n")).otherwise(0)).over(before)
    return (
        rows.withColumn("_met", F.collect_set("device").over(everything))
        .select("*", F.explode("_met").alias("earlier"))
        .withColumn("n_earlier", F.coalesce(met, F.lit(0)))
        .where((F.col("pos") >= 0) & ((F.col("n_earlier") > 0) | (F.col("earlier") == F.col("device"))))
        .select(*SEQ, "pos", "device", "earlier", "n_earlier")
    )


def _met_once(events):
    return events.select(*SEQ, "pos", F.col("device_id").alias("device"), F.lit(1).cast("bigint").alias("n"))


def _counts_by_part(events, part_events):
    """``_running_counts`` per part, with the counts of earlier parts carried in."""
    parted = _met_once(events).withColumn("part", F.floor(F.col("pos") / part_events).cast("int"))
    in_device = Window.partitionBy(*SEQ, "device").orderBy("part")
    totals = (
        parted.groupBy(*SEQ, "device", "part").agg(F.sum("n").alias("n"))
        .withColumn("last", F.max("part").over(Window.partitionBy(*SEQ)))
        .withColumn("until", F.coalesce(F.lead("part").over(in_device), F.col("last")))
        .withColumn("n", F.sum("n").over(in_device.rowsBetween(Window.unboundedPreceding, 0)))
    )
    carried = (
        totals.where(F.col("part") < F.col("until"))
        .withColumn("part", F.explode(F.sequence(F.col("part") + 1, F.col("until"))))
        .select(*SEQ, F.lit(-1).alias("pos"), "device", "n", "part")
    )
    return _running_counts(parted.unionByName(carried), [*SEQ, "part"])


def earlier_device_counts(events: DataFrame, part_events=None) -> DataFrame:
    """``(corpus_id, seq_id, pos, device, earlier, n_earlier)``.

    One row per event and device met before it: how many earlier events of the
    sequence are of that device; an event's own device is listed even with 0,
    so every event is present. This stands for all ordered event pairs, at
    (events x distinct devices) instead of (events squared).
    """
    return _running_counts(_met_once(events), SEQ) if part_events is None else _counts_by_part(events, part_events)


def ordered_pair_counts(events: DataFrame, part_events=None) -> DataFrame:
    """Ordered device pairs per sequence.

    ``(corpus_id, seq_id, source, target, n_pairs, n_sources_before_last)``:
    pairs of events with the source earlier, and how many source events precede
    the last target event. A device met only once has a row with both counts 0,
    so every sequence is present. By default this needs no shuffle beyond the
    one that numbered the events.
    """
    return (
        earlier_device_counts(events, part_events)
        .groupBy(*SEQ, F.col("earlier").alias("source"), F.col("device").alias("target"))
        .agg(F.sum("n_earlier").alias("n_pairs"), F.max("n_earlier").alias("n_sources_before_last"))
    )


def corpus_cells(events: DataFrame) -> DataFrame:
    """What describes a corpus, counted in one pass over its events: ``(corpus_id, kind, source, target, n)``.

    ``sequence``: how many there are; ``device``: events of a device;
    ``adjacent``: a device right before another; ``followed``: events of a
    device that have the other later in their sequence. Each event gives its
    part of the counts where its sequence is, walked once from its end: the
    devices met until then follow the event. Nothing is grouped by sequence;
    what the tasks count, and what is shuffled, is as large as the pairs of
    devices.
    """
    back = Window.partitionBy(*SEQ).orderBy(F.desc("pos"))
    rows = events.select(*SEQ, "pos", F.col("device_id").alias("device")).withColumns({
        "_next": F.lag("device").over(back),
        "_later": F.collect_set("device").over(back.rowsBetween(Window.unboundedPreceding, -1)),
    }).where(F.col("device").isNotNull())

    def cell(kind, source, target):
        return F.struct(F.lit(kind).alias("kind"), source.cast("int").alias("source"), target.cast("int").alias("target"))

    none, own = F.lit(None), F.col("device")
    cells = F.concat(
        F.array_compact(F.array(
            cell("device", own, none),
            F.when(F.col("pos") == 0, cell("sequence", none, none)),
            F.when(F.col("_next").isNotNull(), cell("adjacent", own, F.col("_next"))),
        )),
        F.transform(F.array_remove("_later", own), lambda x: cell("followed", own, x)),
    )
    return rows.select("corpus_id", F.explode(cells).alias("_c")).groupBy("corpus_id", "_c.kind", "_c.source", "_c.target").agg(F.count(F.lit(1)).alias("n"))
