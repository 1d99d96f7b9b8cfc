"""Column expressions over events, edges and metric rows."""

from pyspark.sql import Column, functions as F

from habitloom.model import (
    FIELDS_PER_EVENT, HOURS_PER_SLOT, PADDED_LENGTH, SLOTS_PER_DAY,
)

# Channel levels.
CHANNEL_LEVELS = ("action", "device", "device_action")

# Field orders for edge endpoints and strengths.
GUARD_ENDPOINT_FIELDS = ("device", "device_id", "device_key", "", "id", "index")
METRIC_STRENGTH_FIELDS = (
    "target_adapted_weight", "guarded_weight", "weight", "raw_weight", "causal_strength",
)
SCORING_STRENGTH_FIELDS = (
    "target_adapted_weight", "guarded_weight", "weight", "causal_strength", "raw_weight", "final_score",
)


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def time_index(day="day", slot="hour_slot") -> Column:
    """Slot of the week: ``day * 8 + slot``."""
    return col(day) * SLOTS_PER_DAY + col(slot)


def hour_of_week(day="day", slot="hour_slot") -> Column:
    return col(day) * 24 + col(slot) * HOURS_PER_SLOT


def device_key(device="device_id") -> Column:
    return F.concat(F.lit("d:"), col(device).cast("string"))


def channel_key(level="action") -> Column:
    """Channel name of an event: ``a:<id>``, ``d:<id>`` or ``d:<id>|a:<id>``."""
    if level not in CHANNEL_LEVELS:
        raise ValueError(f"level must be one of {CHANNEL_LEVELS}")
    action = F.concat(F.lit("a:"), F.col("action_id").cast("string"))
    if level == "action":
        return action
    if level == "device":
        return device_key()
    return F.concat_ws("|", device_key(), action)


def canonical_device_key(value) -> Column:
    """``d:x`` stays, ``device_7`` and ``7`` become ``d:7``, other text stays."""
    text = col(value).cast("string")
    digits = F.regexp_extract(text, r"^(?:device_)?(\d+)$", 1)
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(text.startswith("d:"), text).when(digits != "", F.concat(F.lit("d:"), bare)).otherwise(text)


def first_present(fields, columns) -> Column:
    """First non-null of those ``fields`` the table has; null if it has none."""
    present = [F.col(field).cast("string") for field in fields if field in columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def endpoint_key(role, columns) -> Column:
    """Device key of an edge's ``source`` or ``target``, ``unknown`` if absent."""
    fields = [f"{role}_{suffix}" if suffix else role for suffix in GUARD_ENDPOINT_FIELDS]
    return F.coalesce(canonical_device_key(first_present(fields, columns)), F.lit("unknown"))


def edge_strength(columns, fields=METRIC_STRENGTH_FIELDS) -> Column:
    return F.coalesce(first_present(fields, columns).cast("double"), F.lit(0.0))


def device_name(key, name=None) -> Column:
    """Readable name of a device key, ``device_<id>`` when no name is known."""
    key = col(key)
    fallback = F.regexp_replace(key, r"^d:", "device_")
    return fallback if name is None else F.coalesce(col(name), fallback)


def channel_order(key="channel"):
    """Sort columns: numeric suffix first, then the key itself."""
    suffix = F.regexp_extract(col(key), r"^(?:d:)?(\d+)$", 1)
    number = F.when(suffix != "", suffix.cast("bigint")).otherwise(F.lit(10**9))
    return [number.asc(), col(key).asc()]


def events_of_flat(flat="flat") -> Column:
    """Array of event structs of a flat list whose length is a multiple of 4."""
    flat = col(flat)

    def field(i, offset):
        return F.element_at(flat, (i * FIELDS_PER_EVENT + offset + 1).cast("int"))

    count = F.floor(F.size(flat) / FIELDS_PER_EVENT).cast("int")
    whole = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(whole, lambda i: F.struct(
        i.alias("pos"), field(i, 0).alias("day"), field(i, 1).alias("hour_slot"),
        field(i, 2).alias("device_id"), field(i, 3).alias("action_id"),
    ))


def is_usable_flat(flat="flat") -> Column:
    """A non-empty list of integers whose length is a multiple of 4."""
    flat = col(flat)
    return F.coalesce(
        (F.size(flat) > 0) & (F.size(flat) % FIELDS_PER_EVENT == 0) & ~F.exists(flat, lambda x: x.isNull()),
        F.lit(False),
    )


def pad_or_truncate(flat="flat", vocab_size=223, length=PADDED_LENGTH) -> Column:
    """Fixed-length list; missing places hold the pad id ``vocab_size - 1``."""
    filler = F.array_repeat(F.lit(vocab_size - 1), length)
    return F.slice(F.concat(col(flat), filler), 1, length)


def seeded_uniform(seed, *parts) -> Column:
    """A reproducible uniform number in (0, 1) per key, from 52 bits of its md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(part).cast("string") for part in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def ratio_or_zero(numerator, denominator) -> Column:
    return F.coalesce(F.try_divide(col(numerator).cast("double"), col(denominator).cast("double")), F.lit(0.0))


def finite_or_null(value) -> Column:
    """Number from text or double; blank, unreadable and non-finite give null."""
    number = col(value).try_cast("double")
    return F.when(F.isnan(number) | F.abs(number).isin(float("inf")), None).otherwise(number)


def whole_or_null(value) -> Column:
    """Integer from text such as ``12`` or ``12.7`` (cut towards zero)."""
    text = col(value).try_cast("string")
    return F.coalesce(text.try_cast("bigint"), finite_or_null(text).try_cast("bigint"))


def true_or_false(value) -> Column:
    text = F.lower(col(value).cast("string"))
    return F.when(text == "true", True).when(text == "false", False)
