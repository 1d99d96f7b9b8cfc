"""What a corpus looks like: counts, graphs, matrices, tensors."""

from pyspark.sql import DataFrame, Window, functions as F

from habitloom.functions.columns import channel_key, channel_order, device_key, device_name, time_index
from habitloom.model import FIELDS_PER_EVENT, SEQ, SLOTS_PER_WEEK
from habitloom.operators.sequences import ordered_pair_counts, with_neighbour
from habitloom.session import materialize


def channel_counts(events: DataFrame, level="action", min_frequency=1) -> DataFrame:
    """``(corpus_id, channel, n)`` of the channels met at least ``min_frequency`` times."""
    return (
        events.groupBy("corpus_id", channel_key(level).alias("channel")).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_frequency)
    )


def device_distribution(events: DataFrame) -> DataFrame:
    """``(corpus_id, device, n, p)``: share of a corpus' events per device."""
    counts = channel_counts(events, "device").withColumnRenamed("channel", "device")
    total = F.sum("n").over(Window.partitionBy("corpus_id"))
    return counts.withColumn("p", F.col("n") / total)


def device_transitions(events: DataFrame) -> DataFrame:
    """``(corpus_id, source, target, n)``: adjacent device pairs, ids as in the events."""
    return (
        with_neighbour(events, 1, _next="device_id").where(F.col("_next").isNotNull())
        .groupBy("corpus_id", F.col("device_id").alias("source"), F.col("_next").alias("target"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def transition_graph(events: DataFrame, names: DataFrame = None) -> DataFrame:
    """Adjacent device transitions with row-normalized probability.

    ``names`` is an optional ``(device_id, name)`` table.
    """
    outgoing = F.sum("n").over(Window.partitionBy("corpus_id", "source"))
    graph = device_transitions(events).withColumn("transition_score", F.col("n") / outgoing)
    named = {}
    for role in ("source", "target"):
        if names is not None:
            labels = names.select(F.col("device_id").alias(role), F.col("name").alias(f"{role}_label"))
            graph = graph.join(labels, role, "left")
            named[role] = f"{role}_label"
    return graph.select(
        "corpus_id",
        F.col("source").alias("source_device"), F.col("target").alias("target_device"),
        device_key("source").alias("source_device_key"), device_key("target").alias("target_device_key"),
        device_name(device_key("source"), named.get("source")).alias("source_name"),
        device_name(device_key("target"), named.get("target")).alias("target_name"),
        F.col("n").alias("count"), "transition_score",
    )


def graph_size(events: DataFrame) -> DataFrame:
    """``(corpus_id, num_sequences, num_edges)`` of the transition graph."""
    sequences = events.where(F.col("pos") == 0).groupBy("corpus_id").agg(F.count(F.lit(1)).alias("num_sequences"))
    edges = device_transitions(events).groupBy("corpus_id").agg(F.count(F.lit(1)).alias("num_edges"))
    return sequences.join(edges, "corpus_id", "left").fillna(0, ["num_edges"])


def channels_in_order(channels: DataFrame) -> DataFrame:
    """``(channel, channel_index)`` in numeric-suffix order; a vocabulary-sized table."""
    place = F.row_number().over(Window.orderBy(*channel_order("channel"))) - 1
    return channels.select("channel").distinct().select("channel", place.alias("channel_index"))


def transition_matrix(events: DataFrame, channels: DataFrame = None) -> DataFrame:
    """Sparse row-normalized matrix ``(corpus_id, source, target, value)``.

    Transitions with an end outside ``channels`` are left out before rows are
    normalized.
    """
    counts = device_transitions(events).select(
        "corpus_id", device_key("source").alias("source"), device_key("target").alias("target"), "n",
    )
    if channels is not None:
        for role in ("source", "target"):
            counts = counts.join(channels.select(F.col("channel").alias(role)), role, "left_semi")
    row = F.sum("n").over(Window.partitionBy("corpus_id", "source"))
    return counts.select("corpus_id", "source", "target", (F.col("n") / row).alias("value"))


def precedence_matrix(events: DataFrame) -> DataFrame:
    """Sparse ``(corpus_id, source, target, value)``.

    The share of source events that have the target later in their sequence:
    exactly the source events before the last target event of each sequence.
    """
    met = events.groupBy("corpus_id", F.col("device_id").alias("source")).agg(F.count(F.lit(1)).alias("met"))
    return (
        ordered_pair_counts(events)
        .where((F.col("source") != F.col("target")) & (F.col("n_sources_before_last") > 0))
        .groupBy("corpus_id", "source", "target").agg(F.sum("n_sources_before_last").alias("followed"))
        .join(met, ["corpus_id", "source"])
        .select(
            "corpus_id", device_key("source").alias("source"), device_key("target").alias("target"),
            (F.col("followed") / F.col("met")).alias("value"),
        )
    )


def densify(matrix: DataFrame, channels: DataFrame, corpora) -> DataFrame:
    """Fill a sparse matrix with zeros on the full channel grid.

    The channel list is vocabulary-sized: it becomes one array value and is
    exploded into rows and columns.
    """
    every = channels.agg(F.sort_array(F.collect_set("channel"))).scalar()
    grid = (
        channels.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(c) for c in corpora])).alias("corpus_id"), every.alias("_all"))
        .select("corpus_id", "_all", F.explode("_all").alias("source"))
        .select("corpus_id", "source", F.explode("_all").alias("target"))
    )
    return grid.join(matrix, ["corpus_id", "source", "target"], "left").fillna(0.0, ["value"])


def event_tensor(events: DataFrame, level="action", count_mode="count", min_frequency=1) -> DataFrame:
    """Sparse tensor ``(corpus_id, seq_id, slot, channel, value)`` on the 56 slots of a week."""
    if count_mode not in ("count", "binary"):
        raise ValueError("count_mode must be count or binary")
    slot = F.pmod(time_index(), F.lit(SLOTS_PER_WEEK)).cast("int")
    cells = events.select(*SEQ, slot.alias("slot"), channel_key(level).alias("channel"))
    if min_frequency > 1:
        kept = materialize(channel_counts(events, level, min_frequency).select("corpus_id", "channel"), "channels")
        cells = cells.join(kept, ["corpus_id", "channel"], "left_semi")
    value = F.count(F.lit(1)) if count_mode == "count" else F.max(F.lit(1))
    return cells.groupBy(*SEQ, "slot", "channel").agg(value.cast("double").alias("value"))


def weekly_activity(tensor: DataFrame, decay=0.0, keys=("channel",)) -> DataFrame:
    """``(corpus_id, seq_id, *keys, first, week)``: 56 values per sequence and channel.

    Each slot carries ``decay`` times the previous slot's activity, in closed
    form: a cell adds ``value * decay^(t - slot)`` to every slot ``t`` from its
    own on. Cells are gathered (56 at most) before slots are filled in, so the
    shuffle is no larger than the sparse tensor.
    """
    cells = F.collect_list(F.struct("slot", "value"))
    weeks = tensor.groupBy(*SEQ, *keys).agg(cells.alias("_cells"), F.min("slot").alias("first"))

    def at(t):
        def add(total, cell):
            reach = cell["value"] * F.pow(F.lit(float(decay)), t - cell["slot"])
            return total + F.when(cell["slot"] <= t, reach).otherwise(0.0)

        return F.aggregate("_cells", F.lit(0.0), add)

    slots = F.sequence(F.lit(0), F.lit(SLOTS_PER_WEEK - 1))
    return weeks.select(*SEQ, *keys, "first", F.transform(slots, at).alias("week"))


def decayed_tensor(tensor: DataFrame, decay: float) -> DataFrame:
    """The tensor with activity carried over; rows start at a channel's first slot."""
    return (
        weekly_activity(tensor, decay).select(*SEQ, "channel", "first", F.posexplode("week").alias("slot", "value"))
        .where(F.col("slot") >= F.col("first")).select(*SEQ, "slot", "channel", "value")
    )


def lag_windows(tensor: DataFrame, lag: int) -> DataFrame:
    """``(corpus_id, seq_id, slot, channel, lag_0 .. lag_<lag>)``.

    The value at a slot with the ``lag`` values before it, inside the sequence;
    windows that are zero throughout are left out.
    """
    def value(k):
        return F.get("week", F.col("slot") - k)

    slots = F.sequence(F.lit(lag), F.lit(SLOTS_PER_WEEK - 1))
    filled = F.filter(slots, lambda t: F.exists(F.slice("week", t - lag + 1, F.lit(lag + 1)), lambda x: x != 0))
    return (
        weekly_activity(tensor).select(*SEQ, "channel", "week", F.explode(filled).alias("slot"))
        .select(*SEQ, "slot", "channel", *[value(k).alias(f"lag_{k}") for k in range(lag + 1)])
    )


def top_successors(events: DataFrame, k=5) -> DataFrame:
    """``(corpus_id, action, next_action, count, rank)``.

    The ``k`` most common next actions; an action that is never followed keeps
    one row with nulls.
    """
    followed = (
        with_neighbour(events, 1, _next="action_id").where(F.col("_next").isNotNull())
        .groupBy("corpus_id", F.col("action_id").alias("action"), F.col("_next").alias("next_action"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    order = Window.partitionBy("corpus_id", "action").orderBy(F.desc("count"), "next_action")
    top = followed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    every = events.select("corpus_id", F.col("action_id").alias("action")).distinct()
    return every.join(top, ["corpus_id", "action"], "left")


def length_histogram(corpus: DataFrame) -> DataFrame:
    """``(corpus_id, length, n)`` over flat list lengths per sequence of ``(corpus_id, seq_id, flat)`` rows."""
    if "start" in corpus.columns:
        corpus = corpus.groupBy(*SEQ).agg(F.sum(F.size("flat")).cast("int").alias("length"))
    else:
        corpus = corpus.select("corpus_id", F.size("flat").alias("length"))
    return corpus.groupBy("corpus_id", "length").agg(F.count(F.lit(1)).alias("n"))


def event_length_histogram(events: DataFrame) -> DataFrame:
    """As ``length_histogram``, from events: positions are dense, so the last one gives the length."""
    length = (F.max("pos") + 1) * FIELDS_PER_EVENT
    per_sequence = events.groupBy(*SEQ).agg(length.cast("int").alias("length"))
    return per_sequence.groupBy("corpus_id", "length").agg(F.count(F.lit(1)).alias("n"))
