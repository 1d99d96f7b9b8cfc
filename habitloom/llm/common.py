"""Small helpers shared by the corpus operators."""

from pyspark.sql import Column, DataFrame, Window, functions as F

# ASCII white space, as the digest contracts define words.
BLANKS = r"[\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the columns ``names`` of ``df``.

    Columns are found by position and exact spelling, so further columns, also
    ones that differ in case only or repeat an internal name, do no harm.
    """
    places = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    missing = [name for name in names if name not in places]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    numbered = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_c{places[name]}").alias(name) for name in names])


def words(text: Column) -> Column:
    """Words of a text in order: runs of anything but ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def running_offsets(totals: DataFrame, part: str, *amounts: str) -> DataFrame:
    """Per part, for each amount, ``<amount>_before``: its sum over all earlier parts, and ``<amount>_all``.

    ``totals`` has one row per partition of a written table, whatever the number
    of rows, so a single ordered window over it is small.
    """
    every = Window.partitionBy()
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    columns = [part]
    for a in amounts:
        columns += [
            F.coalesce(F.sum(a).over(before), F.lit(0)).cast("bigint").alias(f"{a}_before"),
            F.sum(a).over(every).cast("bigint").alias(f"{a}_all"),
        ]
    return totals.select(*columns)


_kept = {}


def kept_in_worker(key, build):
    """What ``build`` makes, kept in this Python worker from task to task under ``key``.

    A worker keeps one such thing at a time: those of different operators
    would add up in the memory of an executor.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]
