"""Exact top-k inner-product search with vector-approximation files."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from habitloom.llm.common import pick
from habitloom.session import materialize

# Cells per component; a cell number fits a byte.
CELLS = 64
# Vectors per block of approximations or of queries: what one task holds of either side.
BLOCK = 4096


def scaled_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, dim, v)`` of ``(vec_id, embedding)``: components as ``floor(scale * x)``, x as double.

    Vectors that are null or hold a null, NaN or infinite component are left
    out, as are null ids. An empty vector has dimension 0.
    """
    x = F.col("embedding")
    number = x.cast("array<double>")
    good = x.isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(
        F.forall(number, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return pick(table, "vec_id", "embedding").where(good).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.size(x).alias("dim"),
        F.transform(number, lambda c: F.floor(scale * c).cast("bigint")).alias("v"),
    )


def _grid(vectors: DataFrame) -> DataFrame:
    """Per dimension: component-wise least values and cell widths; as small as a vector per dimension."""
    ranges = vectors.select("dim", F.posexplode("v").alias("i", "x")).groupBy("dim", "i").agg(
        F.min("x").alias("low"), F.max("x").alias("high"))
    cell = F.struct("i", "low", F.expr(f"(high - low) div {CELLS} + 1").alias("width"))
    cells = ranges.groupBy("dim").agg(F.sort_array(F.collect_list(cell)).alias("g"))
    return cells.select("dim", F.col("g.low").alias("low"), F.col("g.width").alias("width"))


def _blocks(rows: DataFrame, schema: str, payload) -> DataFrame:
    """Rows of one input partition in blocks per dimension; ``payload`` makes the binary of a block."""
    names = [field.split()[0] for field in schema.split(", ")]

    def gather(batches):
        held = {}
        for batch in batches:
            table = batch.to_pandas()
            for dim, group in table.groupby("dim", sort=False):
                held.setdefault(dim, []).append(group)
                if sum(map(len, held[dim])) >= BLOCK:
                    yield made(dim, held.pop(dim))
        for dim, groups in held.items():
            yield made(dim, groups)

    def made(dim, groups):
        import pandas as pd

        group = pd.concat(groups)
        row = {"dim": int(dim), "ids": group["vec_id"].to_numpy("<i8").tobytes(), **payload(int(dim), group)}
        return pa.RecordBatch.from_pylist([{name: row[name] for name in names}], schema=pa.schema(
            [(n, pa.int32() if n == "dim" else pa.binary()) for n in names]))

    return rows.mapInArrow(gather, schema)


def _matrix(column, dim, dtype):
    return np.array([np.asarray(v, dtype=dtype) for v in column], dtype=dtype).reshape(len(column), dim)


def _top(scores, keep):
    """Row-wise places of the ``keep`` greatest scores, in no order."""
    if scores.shape[1] <= keep:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(-scores, keep - 1, axis=1)[:, :keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` greatest integer inner products per query, exact.

    Both tables are as ``scaled_vectors`` gives them; a query (``vec_id`` of
    ``queries``) meets every vector of its dimension but those with its own id.
    Ties go to the smaller ``vec_id``; fewer candidates give fewer rows; equal
    rows of ``vectors`` count once. Products must fit 64 bits.

    1. Components are quantised to ``CELLS`` cells of equal width, one byte
       each; the approximations are kept in blocks.
    2. Scan: each block of queries meets each block of approximations (a stated
       query set against all rows, in blocks). A cell number gives a lower and
       an upper bound of the product. Every pair of blocks reports the k + 1
       greatest lower bounds per query; their kth over all blocks is a floor
       that the kth result can't be below.
    3. A second scan gives the candidates whose upper bound reaches the floor.
    4. Exact vectors are read in two steps in the order of bounds: first the
       best-bounded k of each query, which raise the floor to an exact product,
       then only candidates whose bound still reaches it. Then the kth result
       is certain.
    Equal vectors of a block have equal bounds; only the k + 1 least ids of
    them can be results, so the others aren't reported.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    vectors = materialize(pick(vectors, "vec_id", "dim", "v").distinct(), "va-exact")
    queries = materialize(pick(queries, "vec_id", "dim", "v").distinct(), "va-queries")
    grid = F.broadcast(materialize(_grid(vectors), "va-grid"))

    def approximate(dim, group):
        low, width = np.array(group["low"].iloc[0]), np.array(group["width"].iloc[0])
        exact = _matrix(group["v"], dim, np.int64)
        # Of equal vectors, the k + 1 least ids.
        ids = group["vec_id"].to_numpy("<i8")
        order = np.lexsort((ids, *exact.T))
        same = np.concatenate([[False], (exact[order][1:] == exact[order][:-1]).all(axis=1)]) if len(order) else np.zeros(0, bool)
        starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        kept = order[np.arange(len(order)) - starts <= k]
        cells = (exact[kept] - low) // width if dim else exact[kept]
        return {"ids": ids[kept].tobytes(), "cells": cells.astype(np.uint8).tobytes(), "low": low.astype("<i8").tobytes(), "width": width.astype("<i8").tobytes()}

    data_blocks = materialize(
        _blocks(vectors.join(grid, "dim"), "dim int, ids binary, cells binary, low binary, width binary", approximate), "va-cells")
    query_blocks = materialize(
        _blocks(queries, "dim int, ids binary, v binary", lambda dim, group: {"v": _matrix(group["v"], dim, "<i8").tobytes()}), "va-query-blocks")
    # Both sides are blocks, a few thousand times fewer than rows.
    pairs = query_blocks.select("dim", F.col("ids").alias("q_ids"), F.col("v").alias("q_v")).join(data_blocks, "dim")

    def bounds(row, first, last):
        """Lower bounds of queries ``first`` to ``last`` against a block, ids, and what to add for the upper ones."""
        dim = row["dim"]
        ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")[first:last]
        low, width = (np.frombuffer(row[name], "<i8").astype(float) for name in ("low", "width"))
        cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dim)
        q = np.frombuffer(row["q_v"], "<i8").reshape(-1, dim)[first:last].astype(float)
        half = (width - 1) / 2
        centres = low + cells * width + half
        spread = np.abs(q) @ half
        # Rounding of the products themselves.
        spread += 1e-9 * (1 + np.abs(q) @ np.max(np.abs(centres), axis=0, initial=0))
        scores = q @ centres.T - spread[:, None]
        scores[q_ids[:, None] == ids] = -np.inf
        return q_ids, ids, scores, 2 * spread

    def slices(row):
        """Queries so many at a time that a matrix of scores stays at some tens of megabytes."""
        n = len(row["q_ids"]) // 8
        return [(a, min(a + 512, n)) for a in range(0, n, 512)]

    def scan_floors(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for first, last in slices(row):
                    q_ids, _, lower, _ = bounds(row, first, last)
                    best = np.take_along_axis(lower, _top(lower, k), axis=1)
                    at, place = np.nonzero(best > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(best[at, place])], names=["query_id", "lower"])

    greatest = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    floors = pairs.mapInArrow(scan_floors, "query_id bigint, lower double") \
        .withColumn("r", F.row_number().over(greatest)).where(F.col("r") <= k).groupBy("query_id").agg(
            F.min("lower").alias("floor"), F.count(F.lit(1)).alias("n"))
    # With fewer than k candidates there is no floor.
    floors = materialize(floors.select("query_id", F.when(F.col("n") == k, F.col("floor")).otherwise(float("-inf")).alias("floor")), "va-floors")
    # The floors of a query block travel with the block.
    with_floors = query_blocks.select("dim", "ids", "v", F.xxhash64("dim", "ids").alias("block"))

    def ids_of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids))), pa.array(ids)], names=["block", "place", "query_id"])

    placed = with_floors.select("block", "ids").mapInArrow(ids_of, "block bigint, place bigint, query_id bigint").join(floors, "query_id", "left")
    # At most BLOCK floors per list, plus what an Arrow batch has above it.
    lists = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))).alias("l")) \
        .select("block", F.col("l.floor").alias("floors"))
    pairs = with_floors.join(lists, "block").select("dim", F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), "floors").join(data_blocks, "dim")

    def scan_candidates(batches):
        for batch in batches:
            for row in batch.to_pylist():
                floors = np.array(row["floors"])
                for first, last in slices(row):
                    q_ids, ids, lower, spread = bounds(row, first, last)
                    at, place = np.nonzero((lower + spread[:, None] >= floors[first:last, None]) & (lower > -np.inf))
                    upper = lower[at, place] + spread[at]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[place]), pa.array(upper)], names=["query_id", "vec_id", "upper"])

    candidates = materialize(pairs.mapInArrow(scan_candidates, "query_id bigint, vec_id bigint, upper double"), "va-candidates")
    in_order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    ranked = candidates.withColumn("r", F.row_number().over(in_order))

    def exact(rows):
        score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, b: a + b)
        return rows.join(vectors.select("vec_id", "dim", "v"), "vec_id").join(
            queries.select(F.col("vec_id").alias("query_id"), "dim", F.col("v").alias("q")), ["query_id", "dim"],
        ).select("query_id", "vec_id", "upper", score.alias("score"))

    first = materialize(exact(ranked.where(F.col("r") <= k).drop("r")), "va-first")
    raised = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    still = ranked.where(F.col("r") > k).join(raised, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("kth")))
    found = first.unionByName(exact(still.select("query_id", "vec_id", "upper")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
