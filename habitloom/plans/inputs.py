"""Inputs of the registered queries, all derived from the given tables.

What the tables do not hold (attacks, metric rows, lineage rows, faulty
corpora) is derived from them by fixed column rules, so that it grows with
them.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from habitloom.functions.columns import device_key
from habitloom.model import EVENT_COLUMNS, SEQ
from habitloom.operators.descriptive import device_distribution, precedence_matrix
from habitloom.operators.detect import Detector
from habitloom.operators.reporting import KEPT_VARIANTS
from habitloom.operators.sequences import events_to_flat
from habitloom.sources.event_log import id_in, sequences_from_log

DEVICES = ("click", "error", "purchase", "signup", "view")
DETECTORS = (
    Detector("spring", "action_id", 20, 95.0),
    Detector("night", "hour_slot", 8, 95.0),
    Detector("multiple", "device_id", 5, 99.0, whole_corpus=True),
)
# A vocabulary with the special pairing of ``None`` actions and ``Other``.
VALIDATION_DEVICES = ("click", "error", "None", "Other", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir, devices=DEVICES, corpus_id=None, per_second=False) -> DataFrame:
    """Sequences of the event log; first half of the month is ``source``, the rest ``target``."""
    device = id_in(devices, F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    if corpus_id is None:
        corpus_id = F.when(F.dayofmonth("ts") <= 15, "source").otherwise("target")
    return sequences_from_log(
        table(spark, sf_dir, "events"), entity="user_id", ts="ts", tie="event_id", device_id=device,
        action_id=device * 4 + F.floor(k / 25), corpus_id=corpus_id, per_second=per_second,
    )


def only(rows: DataFrame, corpus: str) -> DataFrame:
    return rows.where(F.col("corpus_id") == corpus)


def prior(rows: DataFrame) -> DataFrame:
    """Stand-in for a mined prior: the precedence matrix of the source half."""
    return precedence_matrix(only(rows, "source")).select("source", "target", F.col("value").alias("weight"))


def shares(rows: DataFrame, corpus: str) -> DataFrame:
    return device_distribution(only(rows, corpus)).select("device", "p")


def mixed_edges(rows: DataFrame) -> DataFrame:
    """Edges as older files write them: names or indices, one of several strength fields."""
    source, target = F.regexp_extract("source", r"\d+", 0).cast("int"), F.regexp_extract("target", r"\d+", 0).cast("int")
    by_name = (source + target) % 2 == 0
    return prior(rows).select(
        F.when(by_name, F.col("source")).alias("source"), F.when(~by_name, source).alias("source_index"),
        F.when(~by_name, F.col("target")).alias("target"), F.when(by_name, target).alias("target_index"),
        F.when(by_name, F.col("weight")).alias("weight"), F.when(~by_name, F.col("weight")).alias("raw_weight"),
    )


def channels(rows: DataFrame) -> DataFrame:
    from habitloom.operators.descriptive import channels_in_order

    return channels_in_order(rows.select(device_key().alias("channel")))


def losses(rows: DataFrame) -> DataFrame:
    """A loss per sequence from its own events, standing for an external loss vector."""
    return rows.groupBy(*SEQ).agg((F.avg("action_id") / 20 - 0.1).alias("loss"))


def attacked(rows: DataFrame) -> DataFrame:
    """Target sequences as they are (label 0) and after the attack aimed at each detector (label 1)."""
    base = only(rows, "target")
    attacks = {
        "spring": {"device_id": F.lit(1), "action_id": F.lit(4)},
        "night": {"hour_slot": 2 + F.col("hour_slot") % 4},
        "multiple": {"device_id": F.lit(4)},
    }
    kinds = []
    for env, changes in attacks.items():
        for label, change in ((0, {}), (1, changes)):
            kinds.append(F.struct(
                F.lit(env).alias("env"), F.lit(label).alias("label"),
                F.lit(f"{'attack' if label else 'normal'}:{env}").alias("corpus_id"),
                *[change.get(c, F.col(c)).cast("int").alias(c) for c in EVENT_COLUMNS[3:]],
            ))
    return base.select("seq_id", "pos", F.explode(F.array(*kinds)).alias("_k")).select("_k.*", "seq_id", "pos")


def cells_of(every=False):
    """The cells of a sequence, as an array: a dataset by its digest, two seeds, and variants with all and, unless ``every``, some sequences."""
    def cells(digest):
        dataset = F.when(F.substring(digest, 1, 1) < "8", "fr").otherwise("sp").alias("dataset")
        full, half = ([F.struct(dataset, F.lit(seed).alias("seed"), F.lit(v).alias("variant")) for seed in (42, 2024)] for v in ("full", "half"))
        return F.when(F.lit(every) | (F.substring(digest, 2, 1) < "8"), F.array(*full, *half)).otherwise(F.array(*full))

    # One digest per row, whatever is asked of it.
    return F.transform(F.array(F.md5("seq_id")), cells)[0]


def in_cells(rows: DataFrame) -> DataFrame:
    """Rows in every cell they belong to."""
    return rows.select("*", F.inline(cells_of()))


def described(spark, sf_dir) -> DataFrame:
    """The source and target corpora and the three attacked ones: four corpora to hold against the target."""
    rows = events(spark, sf_dir)
    return rows.select(*EVENT_COLUMNS).unionByName(attacked(rows).where("label = 1").select(*EVENT_COLUMNS))


def faulty_corpus(spark, sf_dir) -> DataFrame:
    """Flat sequences with every kind of fault, for the validator."""
    rows = events(spark, sf_dir)
    pos = F.col("pos")
    rows = rows.withColumns({
        "day": F.when(pos == 3, F.col("day") + 7).otherwise(F.col("day")),
        "hour_slot": F.when((pos == 4) & (F.col("device_id") == 0), F.col("hour_slot") + 8).otherwise(F.col("hour_slot")),
        "action_id": F.when(pos >= 2, (F.col("action_id") * 7 + pos) % 23).otherwise(F.col("action_id")),
        "device_id": F.when(pos == 5, F.col("device_id") + 5).otherwise(F.col("device_id")),
    })
    flat, size, day = F.col("flat"), F.size("flat"), F.element_at("flat", 1)
    return events_to_flat(rows).select(
        *SEQ,
        F.when((day == 5) & (size == 4), None)
        .when((day == 4) & (size == 4), F.array().cast("array<int>"))
        .when((day == 6) & (size >= 8), F.slice(flat, F.lit(1), size - 1))
        .otherwise(flat).alias("flat"),
    )


def validation_vocabulary(spark):
    devices = spark.createDataFrame(list(enumerate(VALIDATION_DEVICES)), "device_id int, name string")
    actions = spark.createDataFrame(
        [(d * 4 + j, f"{name}:{j}") for d, name in enumerate(VALIDATION_DEVICES) for j in range(4)], "action_id int, name string",
    )
    return devices, actions


def metric_rows(spark, sf_dir) -> DataFrame:
    """One raw metric row per order, fields as text with the blanks and oddities of report files."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(v) for v in (*KEPT_VARIANTS, "exploratory", "old_run")])
    score = (F.col("o_totalprice") / 500000).cast("string")
    dataset = F.get(F.array(*[F.lit(d) for d in ("fr", "sp", "us")]), (cust % 3).cast("int"))
    scenario = F.get(F.array(*[F.lit(s) for s in ("st", "tt", "nt")]), (key % 3).cast("int"))
    folder = F.when(key % 17 == 0, "diagnostics").when(key % 19 == 0, "run_beta0").otherwise("run")
    return table(spark, sf_dir, "orders").select(
        dataset.alias("dataset"), scenario.alias("scenario"),
        F.concat((2024 + cust % 5).cast("string"), F.when(key % 7 == 0, ".0").otherwise("")).alias("seed"),
        F.get(names, (key % 11).cast("int")).alias("variant"),
        F.when(key % 13 == 0, "").when(key % 13 == 1, "NaN").when(key % 13 == 2, "inf").otherwise(score).alias("f1"),
        score.alias("precision"), F.when(key % 5 == 0, "n/a").otherwise("0.5").alias("recall"),
        F.when(key % 2 == 0, "True").when(key % 4 == 1, "false").otherwise("yes").alias("used_causal_gss"),
        (key % 1000).cast("string").alias("train_size"),
        F.concat(F.lit("syn_"), key.cast("string")).alias("synthetic_pkl"),
        F.concat(F.lit("runs/"), folder, F.lit("/"), key.cast("string"), F.lit(".json")).alias("file_path"),
    )


def placed_results(spark, sf_dir) -> DataFrame:
    """Results with the path they are stored under; some disagree with it or lack fields."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    dataset = F.get(F.array(*[F.lit(d) for d in ("fr", "sp", "us")]), (cust % 3).cast("int"))
    variant = F.when(key % 3 == 0, "zero_target_full").otherwise("zero_target_baseline")
    return table(spark, sf_dir, "orders").select(
        F.concat(dataset, F.lit("_st/seed"), (cust % 500).cast("string"), F.lit("/downstream_ad/"), variant, F.lit("/"), key.cast("string"), F.lit(".json")).alias("path"),
        F.when(key % 11 != 0, "success").alias("status"),
        F.when(key % 10 == 0, "xx").otherwise(dataset).alias("dataset"),
        F.lit("st").alias("scenario"), (cust % 500 + F.when(key % 14 == 0, 1).otherwise(0)).alias("seed"),
        F.when(key % 15 == 0, "wrong").otherwise(variant).alias("variant"),
        F.when(key % 9 != 0, F.col("o_totalprice")).alias("f1"),
    )


def lineage_events(spark, sf_dir) -> DataFrame:
    """Lineage rows: a sequence is a pipeline run, a slot of the day one of its stages."""
    rows = events(spark, sf_dir)
    starts = rows.groupBy("seq_id", "hour_slot").agg(F.min("pos").alias("_start"))
    slot, action = F.col("hour_slot"), F.col("action_id")
    return rows.join(starts, ["seq_id", "hour_slot"]).select(
        F.col("seq_id").alias("variant"), F.concat(F.lit("stage_"), slot.cast("string")).alias("stage"),
        slot.alias("stage_order"),
        F.when(slot >= 6, "downstream_ad_evaluation").when(slot == 5, "offline_generation_quality_evaluation")
        .otherwise("filtering").alias("purpose"),
        (F.col("pos") - F.col("_start")).alias("event_index"),
        # A stage that begins late in its sequence was stopped.
        F.when(F.col("_start") >= 3, "blocked").otherwise("success").alias("status"),
        F.when(action % 4 == 3, "write").otherwise("read").alias("operation"),
        F.concat(F.lit("data/"), F.col("device_id").cast("string"), F.lit("/"), F.floor(action / 2).cast("string")).alias("path"),
        (F.col("device_id") == 2).alias("target_normal"),
        ((F.col("device_id") == 4) & (action % 4 == 1)).alias("target_attack"),
    )
