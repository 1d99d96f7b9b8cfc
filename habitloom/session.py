"""Session settings and the shared folder for intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master=None, shuffle_partitions=None, app="habitloom", extra=None) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    command decides them, and adaptive execution coalesces small partitions.
    """
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.files.maxPartitionBytes": "128m",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="habitloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used for small derived tables that are joined to event-sized data (edges,
    distributions, fitted counts) and at stage boundaries. The file size then
    is a known statistic, so Catalyst broadcasts the table only below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a shuffled
    join, which adaptive execution splits on hot keys. The written table also
    outlives a lost executor. It is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    context = spark.sparkContext
    written = context._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` wrote, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        written = context._jvm.org.apache.hadoop.fs.Path(folder)
        written.getFileSystem(context._jsc.hadoopConfiguration()).delete(written, True)
