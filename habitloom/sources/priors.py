"""Read influence matrices and successor tables."""

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from habitloom.operators.edges import top_edges

# Channel prefix per level; device_action channels read d:<x>|a:<y>.
PREFIX_BY_LEVEL = {"device": "d", "action": "a"}

_MATRIX = "array<array<double>>"


def _cells(rows, default_prefix):
    """COO cells ``(source, target, source_index, target_index, weight, lag, …)`` of matrix rows."""
    size = F.size("matrix")
    square = F.forall("matrix", lambda row: F.size(row) == size)
    checked = rows.withColumn("matrix", F.when(square, F.col("matrix")).otherwise(
        F.raise_error("the influence matrix must be square").cast(_MATRIX)
    ))

    def name(index):
        return F.coalesce(F.get("channels", F.col(index)), F.concat(F.lit(f"{default_prefix}:"), F.col(index).cast("string")))

    keep = [c for c in rows.columns if c not in ("matrix", "channels")]
    return (
        checked.select(*keep, "channels", F.posexplode("matrix").alias("source_index", "_row"))
        .select(*keep, "channels", "source_index", F.posexplode("_row").alias("target_index", "weight"))
        .select(name("source_index").alias("source"), name("target_index").alias("target"), "source_index", "target_index", "weight", *keep)
    )


_EDGE = (
    "struct<source:string,target:string,source_key:string,target_key:string,source_id:int,target_id:int,"
    "source_index:int,target_index:int,weight:double,raw_weight:double,lag:int>"
)
_PRIOR = (
    f"matrix {_MATRIX}, causal_matrix {_MATRIX}, channels array<string>, channel_to_key array<string>, lag int,"
    f" sparse_threshold double, top_causal_edges array<{_EDGE}>,"
    " causal_relation_source string, method string, meta struct<causal_relation_source:string>"
)


def _provenance():
    return F.coalesce("causal_relation_source", "method", "meta.causal_relation_source", F.lit("existing_prior_json"))


def read_prior(spark: SparkSession, path: str, level="device", lag=4, sparse_threshold=0.001) -> DataFrame:
    """Prior documents ``{matrix, channels | channel_to_key, lag, …}`` as cells.

    Missing lag, threshold, source label and channel names get defaults.
    """
    rows = spark.read.schema(_PRIOR).json(path, multiLine=True)
    matrix = F.coalesce("matrix", "causal_matrix", F.raise_error("the document has no matrix").cast(_MATRIX))
    rows = rows.select(
        matrix.alias("matrix"), F.coalesce("channels", "channel_to_key").alias("channels"),
        F.coalesce("lag", F.lit(lag)).alias("lag"),
        F.coalesce("sparse_threshold", F.lit(sparse_threshold)).alias("sparse_threshold"), _provenance().alias("provenance"),
    )
    return _cells(rows, PREFIX_BY_LEVEL.get(level, "c"))


def read_prior_edges(spark: SparkSession, path: str, lag=4) -> DataFrame:
    """The edges a prior document lists itself as ``top_causal_edges``: ``(source, target, weight, lag, provenance)``.

    No rows if it lists none. Ends are given by name or, failing that, by number.
    """
    rows = spark.read.schema(_PRIOR).json(path, multiLine=True)
    listed = rows.select(
        F.coalesce("channels", "channel_to_key").alias("_names"), F.coalesce("lag", F.lit(lag)).alias("_lag"),
        _provenance().alias("provenance"), F.explode("top_causal_edges").alias("_e"),
    )

    def end(role):
        index = F.coalesce(f"_e.{role}_index", f"_e.{role}_id")
        return F.coalesce(F.nullif(f"_e.{role}", F.lit("")), f"_e.{role}_key", F.get("_names", index), F.concat(F.lit("c:"), index.cast("string")))

    return listed.select(
        end("source").alias("source"), end("target").alias("target"),
        F.coalesce("_e.weight", "_e.raw_weight", F.lit(0.0)).alias("weight"), F.coalesce("_e.lag", "_lag").alias("lag"), "provenance")


def read_matrix(spark: SparkSession, path: str, level="device", lag=4) -> DataFrame:
    """A bare matrix from ``.json`` (list of lists), ``.csv`` or ``.txt`` as cells.

    Row numbers come from the whole file; a matrix is vocabulary-sized.
    """
    whole = spark.read.text(path, wholetext=True)
    if path.endswith(".json"):
        matrix = F.from_json("value", _MATRIX)
    else:
        lines = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
        matrix = F.transform(lines, lambda line: F.transform(F.split(line, ","), lambda cell: F.trim(cell).cast("double")))
    rows = whole.select(matrix.alias("matrix"), F.lit(None).cast("array<string>").alias("channels"), F.lit(lag).alias("lag"))
    return _cells(rows, PREFIX_BY_LEVEL.get(level, "c"))


@dataclasses.dataclass(frozen=True)
class Prior:
    """The whole matrix as cells, and the edges that count as its strongest; both ``(source, target, weight, lag, provenance)``."""

    cells: DataFrame
    edges: DataFrame


def resolve_prior(
    spark: SparkSession, *, prior_path=None, matrix_path=None, source_events: DataFrame = None, miner=None,
    level="device", lag=4, sparse_threshold=0.001, k=None,
) -> Prior:
    """A given prior, else a given matrix, else one mined from source events.

    The edges are those the prior document lists itself; failing that, the
    ``k`` heaviest cells (all positive ones by default). ``miner`` maps events,
    level, lag and threshold to ``(source, target, weight)``; the default is
    the linear lagged miner.
    """
    listed = None
    if prior_path:
        cells = read_prior(spark, prior_path, level, lag, sparse_threshold)
        listed = read_prior_edges(spark, prior_path, lag)
    elif matrix_path:
        cells = read_matrix(spark, matrix_path, level, lag).withColumn("provenance", F.lit("prior_matrix_path"))
    elif source_events is not None:
        if miner is None:
            from habitloom.operators.mining import mine_prior as miner
        cells = miner(source_events, level=level, lag=lag, sparse_threshold=sparse_threshold)
        cells = cells.withColumns({"lag": F.lit(lag), "provenance": F.lit("mined_from_source")})
    else:
        raise ValueError("give prior_path, matrix_path or source_events")
    cells = cells.select("source", "target", "weight", "lag", "provenance")
    if listed is not None and not listed.isEmpty():  # one document
        return Prior(cells, listed)
    return Prior(cells, top_edges(cells, k))


def read_successors(spark: SparkSession, path: str, context: str) -> DataFrame:
    """``(context, action, next_action, count, rank)`` from ``{action: {message, transitions: […]}}``.

    An action without transitions keeps one row with nulls.
    """
    entry = "struct<message:string,transitions:array<struct<next_action:string,count:bigint>>>"
    table = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{entry}>").alias("_all"))
    return (
        table.select(F.explode("_all").alias("action", "_entry"))
        .select("action", F.posexplode_outer("_entry.transitions").alias("_place", "_t"))
        .select(F.lit(context).alias("context"), "action", "_t.next_action", "_t.count", (F.col("_place") + 1).alias("rank"))
    )


def write_prior(cells: DataFrame, path: str) -> None:
    """Edges or matrix cells as JSON lines."""
    cells.write.mode("errorifexists").json(path)
