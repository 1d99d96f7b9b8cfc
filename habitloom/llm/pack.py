"""Concatenate token streams and cut them into full sequences."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from habitloom.llm.common import pick, running_offsets
from habitloom.llm.wordpieces import word_pieces
from habitloom.session import materialize

STREAMS = "part struct<file:string,first:bigint>, doc_id bigint, start_in_part bigint, n_ids bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _flush(size):
    """Whether an output batch has grown enough to be sent on."""
    return size >= 1 << 23


def in_stored_order(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, file, row)`` of a table just read from files: where each row is stored."""
    inner = docs.toDF(*[f"_d{i}" for i in range(len(docs.columns))])
    place = {c: f"_d{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    return inner.select(F.col(place["doc_id"]).alias("doc_id"), F.col(place["text"]).alias("text"), "_metadata.file_name", "_metadata.row_index") \
        .toDF("doc_id", "text", "file", "row")


def token_streams(docs: DataFrame, tokenizer_path: str, end_id: int, stored: bool = False) -> DataFrame:
    """First pass: every document's ids with ``end_id`` behind them, written once.

    Each row has the part it belongs to, its offset in ids inside that part,
    and its ids as little-endian unsigned 16- or 32-bit integers. A part is
    what one task read; with ``stored`` it is a run of rows of one file, named
    by the file and the row it begins with, so that the order of parts is that
    in which the table was written. Written, the numbering no longer depends
    on how often a task ran.
    """
    part_type = pa.struct([("file", pa.string()), ("first", pa.int64())])
    schema = pa.schema([
        ("part", part_type), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()),
    ])

    def tokenize(batches):
        pieces = word_pieces(tokenizer_path)
        end = np.array([end_id], dtype=pieces.dtype).tobytes()
        part, start, last = {"file": "", "first": TaskContext.get().partitionId()}, 0, None

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

        for batch in batches:
            out, held = ([], [], [], [], []), 0
            places = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True) if stored else [None] * batch.num_rows
            for doc_id, text, place in zip(batch.column(0).to_pylist(), batch.column(1), places, strict=True):
                if stored:
                    if last is None or place != (last[0], last[1] + 1):
                        part, start = {"file": place[0], "first": place[1]}, 0
                    last = place
                ids = pieces.encode(text.as_py()) + end
                count = len(ids) // len(end)
                for column, value in zip(out, (part, doc_id, start, count, ids), strict=True):
                    column.append(value)
                start, held = start + count, held + len(ids)
                if _flush(held):
                    yield made(out)
                    out, held = ([], [], [], [], []), 0
            yield made(out)

    rows = in_stored_order(docs) if stored else pick(docs, "doc_id", "text")
    return materialize(rows.mapInArrow(tokenize, STREAMS), "token-streams")


def concatenate_and_cut(streams: DataFrame, length: int, id_bytes: int) -> DataFrame:
    """Second pass: cut the concatenated streams of ``token_streams`` every ``length`` ids.

    The order is that of partitions and of rows inside them, so no row is
    shuffled: partition totals are summed in order (one row per partition or
    run of a file, sent to every executor) and give each document its global
    offset. A
    document that crosses a cut gives one boundary record per sequence it
    touches. All sequences are full but the last. Pieces hold their ids as
    little-endian unsigned 32-bit integers. No documents give no pieces.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    totals = streams.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    offsets = F.broadcast(running_offsets(totals, "part", "ids"))
    placed = streams.join(offsets, "part").select("doc_id", F.expr("ids_before + start_in_part").alias("at"), "ids")
    names = [field.split()[0] for field in PIECES.split(", ")]

    def cut(batches):
        for batch in batches:
            out, held = {name: [] for name in names}, 0
            for doc_id, at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(ids.as_buffer(), dtype=f"<u{id_bytes}").astype("<u4")
                start, total = 0, len(ids)
                while start < total:
                    sequence, offset = divmod(at + start, length)
                    count = min(length - offset, total - start)
                    row = (doc_id, start, count, ids[start:start + count].tobytes(), total, sequence, offset)
                    for name, value in zip(names, row, strict=True):
                        out[name].append(value)
                    start, held = start + count, held + 4 * count
                    if _flush(held):
                        yield pieces_batch(out)
                        out, held = {name: [] for name in names}, 0
            yield pieces_batch(out)

    def pieces_batch(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(out[name], pa.binary() if name == "ids" else pa.int64()) for name in names], names=names,
        )

    return placed.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int, stored: bool = False) -> DataFrame:
    """Pieces of all documents of ``(doc_id, text)`` in sequences of ``length`` ids.

    With ``stored``, ``docs`` must be a table as read from files, and documents
    follow each other in the order in which that table was written.

    A null or empty text is the end id alone. Repeated rows are packed as often
    as they occur. Columns as in ``PIECES``.
    """
    return concatenate_and_cut(token_streams(docs, tokenizer_path, end_id, stored), length, word_pieces(tokenizer_path).dtype.itemsize)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    )
