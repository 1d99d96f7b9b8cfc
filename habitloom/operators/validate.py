"""Check flat sequences against a vocabulary."""

from pyspark.sql import DataFrame, Window, functions as F

from habitloom.functions.columns import events_of_flat, is_usable_flat
from habitloom.model import DAYS_PER_WEEK, FIELDS_PER_EVENT, SEQ, SLOTS_PER_DAY

# This pairing is legal in stored data although the names differ.
UNPLACED_DEVICE, CATCH_ALL_DEVICE = "None", "Other"


def lenient(corpus: DataFrame) -> DataFrame:
    """Rows whose ``flat`` is a non-empty list of integers in whole events."""
    return corpus.where(is_usable_flat("flat"))


def action_devices(devices: DataFrame, actions: DataFrame) -> DataFrame:
    """``(action_id, device_id, allowed)`` from names such as ``Lamp:switch on``.

    ``device_id`` is null when the action's device name is not listed.
    """
    named = actions.select("action_id", F.get(F.split("name", ":"), F.lit(0)).alias("device_name"))
    known = devices.select(F.col("name").alias("device_name"), "device_id")
    other = devices.where(F.col("name") == CATCH_ALL_DEVICE).agg(F.max("device_id")).scalar()
    extra = F.when(F.col("device_name") == UNPLACED_DEVICE, other)
    allowed = F.array_compact(F.array(F.col("device_id"), extra))
    return named.join(known, "device_name", "left").select(
        "action_id", "device_id", F.when(F.col("device_id").isNotNull(), allowed).alias("allowed"),
    )


def _vocabulary(devices, actions):
    """One row: legal device ids, and the actions with their device and allowed devices in as many short lists as there are actions.

    An id's digest says which list it is in, so a lookup takes about one step
    however many actions there are and however far apart their ids lie.
    """
    entries = action_devices(devices, actions).where("action_id IS NOT NULL")
    lists = entries.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_lists"))
    by_list = entries.crossJoin(F.broadcast(lists)).groupBy(_list_of(F.col("action_id"), F.col("_lists")).alias("_list")).agg(  # one row
        F.collect_list(F.struct("action_id", F.struct("device_id", "allowed").alias("entry"))).alias("_entries"))
    kept = by_list.agg(F.map_from_entries(F.collect_list(F.struct("_list", "_entries"))).alias("_by_list")).crossJoin(lists)
    listed = F.transform(F.sequence(F.lit(0), F.col("_lists").cast("int") - 1), lambda i: F.try_element_at("_by_list", i))
    legal = devices.agg(F.collect_set("device_id").alias("_legal"))
    return kept.select(listed.alias("_listed")).crossJoin(legal)  # one row each


def _list_of(action, lists):
    return F.pmod(F.xxhash64(action.cast("bigint")), lists).cast("int")


def with_reasons(corpus: DataFrame, devices: DataFrame, actions: DataFrame, expected_length=None) -> DataFrame:
    """Add ``reasons``: what is wrong with each row, empty when valid.

    The vocabulary travels with the row as small values and the check stays
    inside the row, so no event-sized join or shuffle is needed. A column
    ``problem`` (see ``corpora.read_generated``) is taken over as the reason. A
    column ``start`` says where a row goes on in its sequence: events are
    counted from there, and an unexpected length of the whole sequence is
    reported at its first row.
    """
    corpus = corpus.crossJoin(F.broadcast(_vocabulary(devices, actions)))  # one row
    flat, legal = F.col("flat"), F.col("_legal")
    start = F.coalesce("start", F.lit(0)) if "start" in corpus.columns else F.lit(0)

    def at(text, event, value):
        return F.concat(F.lit(f"{text}@event_"), (event["pos"] + start).cast("string"), F.lit(":"), value)

    def event_reasons(event):
        day, slot, device, action = (event[c] for c in ("day", "hour_slot", "device_id", "action_id"))
        near = F.get("_listed", _list_of(action, F.size("_listed")))
        entry = F.get(F.filter(near, lambda x: x["action_id"] == action), 0)["entry"]
        legal_device = F.array_contains(legal, device)
        mismatch = legal_device & entry["allowed"].isNotNull() & ~F.array_contains(entry["allowed"], device)
        pair = F.concat(
            F.lit("device="), device.cast("string"), F.lit(",action="), action.cast("string"),
            F.lit(",expected_device="), entry["device_id"].cast("string"),
        )
        return F.array_compact(F.array(
            F.when(~day.between(0, DAYS_PER_WEEK - 1), at("day_out_of_range", event, day.cast("string"))),
            F.when(~slot.between(0, SLOTS_PER_DAY - 1), at("hour_slot_out_of_range", event, slot.cast("string"))),
            F.when(~legal_device, at("illegal_device_id", event, device.cast("string"))),
            F.when(entry.isNull(), at("illegal_action_id", event, action.cast("string"))),
            F.when(mismatch, at("device_action_mismatch", event, pair)),
        ))

    size = F.size(flat)
    of_row = [F.when(size % FIELDS_PER_EVENT != 0, F.lit("length_not_multiple_of_4"))]
    if expected_length is not None:
        whole = F.sum(size).over(Window.partitionBy(*SEQ)).cast("int") if "start" in corpus.columns else size
        corpus = corpus.withColumn("_whole", whole)
        text = F.concat(F.lit("length_mismatch:"), F.col("_whole").cast("string"), F.lit(f"!=expected_{expected_length}"))
        of_row.append(F.when((F.col("_whole") != expected_length) & (start == 0), text))
    of_events = F.flatten(F.transform(events_of_flat("flat"), event_reasons))
    problem = F.col("problem") if "problem" in corpus.columns else F.lit(None).cast("string")
    reasons = (
        F.when(problem.isNotNull(), F.array(problem)).when(flat.isNull(), F.array(F.lit("missing_sequence")))
        .when(F.exists(flat, lambda x: x.isNull()), F.array(F.lit("non_integer_value")))
        .when(size == 0, F.array(F.lit("empty_sequence")))
        .otherwise(F.concat(F.array_compact(F.array(*of_row)), of_events))
    )
    return corpus.withColumn("reasons", reasons).drop("_legal", "_listed", "_whole")


def validation_report(checked: DataFrame, expected_count: int, by=("corpus_id",)) -> DataFrame:
    """Counts of sequences per corpus.

    Equal valid sequences are told by a digest, so no list is shuffled. Rows of
    one sequence (column ``start``) are one sequence, valid if all of them are.
    """
    valid = F.size("reasons") == 0
    digest = F.sha2(F.array_join("flat", ","), 256)
    if "start" in checked.columns:
        rows = checked.groupBy(*dict.fromkeys([*by, *SEQ])).agg(
            F.bool_and(valid).alias("valid"), F.sha2(F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("start", digest.alias("d")))), lambda r: r["d"]), ","), 256).alias("digest"))
    else:
        rows = checked.select(*by, valid.alias("valid"), digest.alias("digest"))
    same = rows.groupBy(*by, "valid", F.when(F.col("valid"), F.col("digest")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    report = same.groupBy(*by).agg(
        F.sum("n").alias("num_rows"),
        F.coalesce(F.sum(F.when(F.col("valid"), F.col("n"))), F.lit(0)).alias("num_valid"),
        F.coalesce(F.sum(F.when(~F.col("valid"), F.col("n"))), F.lit(0)).alias("num_invalid"),
        F.count_if("valid").alias("unique_sequence_count"),
    )
    duplicates = F.col("num_valid") - F.col("unique_sequence_count")
    ok = (F.col("num_invalid") == 0) & (F.col("num_valid") == expected_count)
    return report.withColumns({
        "duplicate_sequence_count": duplicates,
        "duplicate_rate": F.try_divide(duplicates.cast("double"), F.col("num_valid")),
        "status": F.when(ok, "valid").otherwise("invalid"),
    })
