"""Read device and action vocabularies."""

from pyspark.sql import DataFrame, SparkSession, functions as F

def read_id_names(spark: SparkSession, path: str, section: str = None) -> DataFrame:
    """``(id, name)`` from a JSON object, or one of its sections.

    Entries may be ``name: id`` or ``id: name``; entries that are neither are
    left out. A document without the section is read as a whole.
    """
    text = F.col("value")
    if section is not None:
        text = F.coalesce(F.get_json_object(text, f"$.{section}"), text)
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "item"))
    by_name, by_id = F.col("item").try_cast("int"), F.col("key").try_cast("int")
    return entries.select(
        F.coalesce(by_name, by_id).alias("id"), F.when(by_name.isNotNull(), F.col("key")).otherwise(F.col("item")).alias("name"),
    ).where(F.col("id").isNotNull())


def devices_and_actions(devices: DataFrame, actions: DataFrame):
    """``(id, name)`` tables in the shape the validator and the name lookups take."""
    return devices.withColumnRenamed("id", "device_id"), actions.withColumnRenamed("id", "action_id")


def action_table(actions: DataFrame, devices: DataFrame, off_actions: DataFrame = None) -> DataFrame:
    """``(action_id, name, device_name, device_id, is_off)`` of ``Device:verb`` names.

    ``off_actions`` is a ``(name)`` table of the actions that switch something
    off, from whoever knows the vocabulary; without it ``is_off`` is null.
    """
    named = actions.select(F.col("id").alias("action_id"), "name", F.get(F.split("name", ":"), F.lit(0)).alias("device_name"))
    joined = named.join(devices.select(F.col("name").alias("device_name"), F.col("id").alias("device_id")), "device_name", "left")
    if off_actions is None:
        return joined.withColumn("is_off", F.lit(None).cast("boolean"))
    off = off_actions.select("name").distinct().withColumn("_off", F.lit(True))
    return joined.join(off, "name", "left").withColumn("is_off", F.coalesce("_off", F.lit(False))).drop("_off")
