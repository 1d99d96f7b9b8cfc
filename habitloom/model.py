"""Table shapes and fixed values shared by all operators.

The canonical table holds one event per row::

    corpus_id, seq_id, pos, day, hour_slot, device_id, action_id

``(corpus_id, seq_id)`` names a sequence and ``pos`` runs 0..n-1 inside it.
The flat form holds the same as integer lists; ``start`` is the position of a
row's first event, as a sequence may go on in several rows.
"""

from pyspark.sql import types as T

# Fixed values of the event model.
HOURS_PER_SLOT = 3
SLOTS_PER_DAY = 8
DAYS_PER_WEEK = 7
SLOTS_PER_WEEK = SLOTS_PER_DAY * DAYS_PER_WEEK
FIELDS_PER_EVENT = 4
PADDED_LENGTH = 40

SEQ = ("corpus_id", "seq_id")
EVENT_COLUMNS = ("corpus_id", "seq_id", "pos", "day", "hour_slot", "device_id", "action_id")

CORPUS_SCHEMA = T.StructType([
    T.StructField("corpus_id", T.StringType()),
    T.StructField("seq_id", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("flat", T.ArrayType(T.IntegerType())),
])

EDGE_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("lag", T.IntegerType()),
])

LABELLED_SCHEMA = T.StructType([
    T.StructField("seq_id", T.StringType()),
    T.StructField("flat", T.ArrayType(T.IntegerType())),
    T.StructField("label", T.IntegerType()),
])
