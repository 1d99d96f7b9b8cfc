"""Writers for reports."""

from pyspark.sql import DataFrame, functions as F, types as T

from habitloom.operators.reporting import METRIC_ROW_FIELDS


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN has no JSON form: floating columns and arrays of them get null instead."""
    def clean(field):
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(column), column).alias(field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, (T.DoubleType, T.FloatType)):
            return F.transform(column, lambda x: F.when(~F.isnan(x), x)).alias(field.name)
        return column

    return df.select(*[clean(field) for field in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are written, NaN becomes null."""
    nan_to_null(df).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, fields=METRIC_ROW_FIELDS) -> None:
    """CSV with a header and exactly ``fields``: others are left out, missing ones are empty."""
    columns = [F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
    df.select(*columns).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)
