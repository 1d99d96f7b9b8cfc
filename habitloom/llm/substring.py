"""Removal of word windows that start in an earlier document, over the whole corpus."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from habitloom.llm.common import pick
from habitloom.llm.recompress import Words
from habitloom.session import materialize

# Text of a part, and of what is worked on at a time inside it.
PART_BYTES, STEP_BYTES = 4 << 20, 1 << 20
# Kinds of the rows that travel between the passes.
COPY, STRETCH, WINDOW, REMOVED = 0, 1, 2, 3
ROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("upto", pa.int64())])
ROW_DDL = "kind int, a bigint, b bigint, doc bigint, upto bigint"
RESULT_DDL = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"


def _rows(kind, a, b, doc, upto=None):
    n = len(a)
    as_long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
    return pa.Table.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), as_long(a), as_long(b), as_long(doc), as_long(np.zeros(n, int) if upto is None else upto)], schema=ROW)


def _ends(a, b, doc):
    """Places of the rows with the least and the greatest ``doc`` of each equal (a, b)."""
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    last = np.concatenate([new[1:], [True]])
    # A last row of the first row's document says nothing new.
    first_of = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[new | (last & (doc != doc[first_of]))]


def _column(table, name):
    return table.column(name).to_numpy()


def _steps(docs, window):
    """Documents of a part, some megabytes at a time: row numbers and ``Words``."""
    texts = docs.column("text")
    rows, texts_held, size = [], [], 0
    for i in range(docs.num_rows):
        text = texts[i].as_py() or b""
        rows.append(i)
        texts_held.append(text)
        size += len(text)
        if size >= STEP_BYTES:
            yield np.array(rows), Words(texts_held, window)
            rows, texts_held, size = [], [], 0
    if rows:
        yield np.array(rows), Words(texts_held, window)


def _copies(docs, answers):
    """Which rows of a part are copies of an earlier document."""
    mine = answers.filter(pc.equal(answers.column("kind"), COPY))
    known = set(zip(mine.column("a").to_pylist(), mine.column("b").to_pylist(), strict=True))
    return np.array([key in known for key in zip(docs.column("doc_id").to_pylist(), docs.column("digest").to_pylist(), strict=True)], dtype=bool)


def _ids(docs):
    """Ids, and which rows have one; null takes part in no comparison."""
    ids = docs.column("doc_id")
    return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy()


def _repeats(docs, copies, window):
    """First pass: a row per named stretch of the part."""
    ids, named = _ids(docs)
    copy = _copies(docs, copies)
    a, b, doc = [], [], []
    for rows, words in _steps(docs, window):
        owner = rows[words.document[words.windows[words.anchors]]]
        use = named[owner] & ~copy[owner]
        a.append(words.names[use])
        b.append(words.stretches()[use])
        doc.append(ids[owner[use]])
    out = []
    if a:
        a, b, doc = map(np.concatenate, (a, b, doc))
        chosen = _ends(a, b, doc)
        out.append(_rows(STRETCH, a[chosen], b[chosen], doc[chosen]))
    out.append(_rows(COPY, *(np.array(c, dtype=np.int64) for c in (copies.column("a").to_pylist(), copies.column("b").to_pylist(), copies.column("doc").to_pylist()))))
    return pa.concat_tables(out)


def _candidates(docs, answers, window):
    """Second pass: stretches that are settled, and a row per window that has to be compared."""
    ids, named = _ids(docs)
    digests = docs.column("digest").to_numpy()
    copy = _copies(docs, answers)
    shared = answers.filter(pc.equal(answers.column("kind"), STRETCH))
    names, uniform, least = _column(shared, "a").view(np.uint64), _column(shared, "upto") == 1, _column(shared, "b")
    order = np.argsort(names, kind="stable")
    names, uniform, least = names[order], uniform[order], least[order]
    compared_rows, removed = [], []
    for rows, words in _steps(docs, window):
        # Copies go as a whole, if they have a window.
        places = np.flatnonzero(copy[rows] & (words.counts >= window))
        removed.append((digests[rows[places]], np.zeros(len(places), int), ids[rows[places]], words.counts[places]))
        if not len(names) or not len(words.anchors):
            continue
        at = np.minimum(np.searchsorted(names, words.names), len(names) - 1)
        first = words.windows[words.anchors]
        owner = rows[words.document[first]]
        hit = (names[at] == words.names) & named[owner] & ~copy[owner]
        compared = np.flatnonzero((hit & ~uniform[at])[words.anchor_of])
        keys = words.window_digests(compared)
        compared_rows.append((keys[:, 0], keys[:, 1], ids[rows[words.document[words.windows[compared]]]], words.names[words.anchor_of[compared]]))
        settled = hit & uniform[at] & (ids[owner] > least[at])
        last = words.windows[np.concatenate([words.anchors[1:], [len(words.windows)]]) - 1] + window
        new = np.concatenate([[True], (owner[settled][1:] != owner[settled][:-1]) | (first[settled][1:] > last[settled][:-1])])[:settled.sum()]
        run = np.flatnonzero(new)
        base = words.first[words.document[first[settled]]]
        if len(run):
            removed.append((digests[owner[settled][run]], (first[settled] - base)[run], ids[owner[settled][run]], np.maximum.reduceat(last[settled] - base, run)))
    out = [_rows(REMOVED, *map(np.concatenate, zip(*removed, strict=True)))] if removed else []
    if compared_rows:
        a, b, doc, name = map(np.concatenate, zip(*compared_rows, strict=True))
        chosen = _ends(a, b, doc)
        out.append(_rows(WINDOW, a[chosen], b[chosen], doc[chosen], name[chosen]))
    return pa.concat_tables(out) if out else ROW.empty_table()


def _result(docs, answers, window):
    """Third pass: words of each document, how many go, and the rest."""
    ids, named = _ids(docs)
    digests = docs.column("digest").to_numpy()
    kinds = _column(answers, "kind")
    a, b, doc, upto = (_column(answers, name) for name in ("a", "b", "doc", "upto"))
    settled, wanted = kinds == REMOVED, kinds == WINDOW
    ranges = {}
    for digest, start, row, end in zip(a[settled].tolist(), b[settled].tolist(), doc[settled].tolist(), upto[settled].tolist(), strict=True):
        ranges.setdefault((row, digest), []).append((start, end))
    least_of = {(x, y): d for x, y, d in zip(a[wanted].tolist(), b[wanted].tolist(), doc[wanted].tolist(), strict=True)}
    names = np.unique(upto[wanted].view(np.uint64))
    out = [], [], [], []
    for rows, words in _steps(docs, window):
        gone = np.zeros(len(words.document) + 1, dtype=np.int64)
        for place, row in enumerate(rows):
            for start, end in ranges.get((int(ids[row]), int(digests[row])), ()) if named[row] else ():
                gone[words.first[place] + start] += 1
                gone[words.first[place] + end] -= 1
        if len(names) and len(words.anchors):
            at = np.minimum(np.searchsorted(names, words.names), len(names) - 1)
            compared = np.flatnonzero((names[at] == words.names)[words.anchor_of])
            starts = words.windows[compared]
            owner = rows[words.document[starts]]
            for p, o, key in zip(starts.tolist(), owner.tolist(), words.window_digests(compared).tolist(), strict=True):
                least = least_of.get((key[0], key[1]))
                if least is not None and named[o] and least < ids[o]:
                    gone[p] += 1
                    gone[p + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        for place, row in enumerate(rows):
            lo, hi = words.first[place], words.first[place + 1]
            text = words.joined[words.starts[lo]:words.ends[hi - 1]] if hi > lo else b""
            if gone[lo:hi].any():
                keep = ~gone[lo:hi]
                text = b" ".join([words.joined[s:e] for s, e in zip(words.starts[lo:hi][keep].tolist(), words.ends[lo:hi][keep].tolist(), strict=True)])
            for column, value in zip(out, (int(ids[row]) if named[row] else None, int(hi - lo), int(gone[lo:hi].sum()), text), strict=True):
                column.append(value)
    return pa.Table.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Remove every word under a window of ``window`` words that also starts in a document with a smaller id.

    ``docs`` has ``doc_id, text``; windows are judged on the input. Returns per
    row ``doc_id, n_words, n_removed, kept`` (the other words joined by a
    space, UTF-8). Null texts have no words. A null id is neither smaller nor
    greater than any, so its row keeps all words and takes none from others;
    rows of one id take nothing from each other.

    Documents are dealt into parts by id once; three passes over the parts
    share that exchange, each with what the pass before found out globally.
    1. Recompression rounds (``recompress``) name the words, and each part
       reports the names its windows hang on, with a digest of the words under
       those windows: per name and digest the least and the greatest id, so a
       passage in a third of all documents costs a few rows per part.
    2. Names in more than one document are shared. Where all stretches of a
       name have one digest, their windows are equal, and documents above the
       least id lose them. Elsewhere each part reports 128-bit digests of the
       windows themselves.
    3. The least id per window digest decides over those.
    Equal texts are found first, by digest; all but the least id go as a whole
    and stay out of the rounds.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    sizes = materialize(rows.select("doc_id", "digest", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size")), "repeat-sizes")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(4 * partitions, (sizes.agg(F.sum("size")).first()[0] or 0) // PART_BYTES)

    def part(doc, digest=None):
        own = F.pmod(F.xxhash64(doc), F.lit(parts))
        return (own if digest is None else F.when(F.col(doc).isNotNull(), own).otherwise(F.pmod(digest, F.lit(parts)))).cast("int").alias("part")

    firsts = materialize(sizes.where("sha IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first"), "repeat-firsts")
    copies = sizes.join(firsts, "sha").where("doc_id > first").select(
        part("doc_id"), F.lit(COPY).alias("kind"), F.col("doc_id").alias("a"), F.col("digest").alias("b"), F.col("doc_id").alias("doc"), F.lit(0).cast("bigint").alias("upto"))
    copies = materialize(copies, "repeat-copies")
    texts = rows.select(part("doc_id", F.col("digest")), "doc_id", "digest", F.col("text").cast("binary").alias("text"))

    def passed(function, answers, ddl):
        names = ("kind", "a", "b", "doc", "upto")
        return texts.groupBy("part").cogroup(answers.select("part", *names).groupBy("part")).applyInArrow(
            lambda left, right: function(left, right, window) if left.num_rows else pa.Table.from_pylist([], schema=_schema(ddl)), ddl)

    # Rows that only pass through must not meet under one key.
    own = F.when(F.col("kind").isin(COPY, REMOVED), F.col("doc")).otherwise(0)
    by_name = Window.partitionBy("kind", "a", own)
    is_stretch = F.col("kind") == STRETCH
    named = passed(_repeats, copies, ROW_DDL).withColumns({
        "least": F.min("doc").over(by_name), "most": F.max("doc").over(by_name),
        "one": (F.min("b").over(by_name) == F.max("b").over(by_name)).cast("bigint")})
    shared = named.where(~is_stretch | ((F.col("least") < F.col("most")) & ~((F.col("one") == 1) & (F.col("doc") == F.col("least"))))).select(
        part("doc"), "kind", "a", F.when(is_stretch, F.col("least")).otherwise(F.col("b")).alias("b"), "doc", F.when(is_stretch, F.col("one")).otherwise(0).alias("upto"))
    by_window = Window.partitionBy("kind", "a", "b", own)
    is_window = F.col("kind") == WINDOW
    judged = passed(_candidates, shared, ROW_DDL).withColumn("least", F.min("doc").over(by_window)).where(~is_window | (F.col("doc") > F.col("least"))).select(
        part("doc"), "kind", "a", "b", F.when(is_window, F.col("least")).otherwise(F.col("doc")).alias("doc"), "upto")
    return passed(_result, judged, RESULT_DDL)


def _schema(ddl):
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, types[kind]) for name, kind in (field.split() for field in ddl.split(", "))])
