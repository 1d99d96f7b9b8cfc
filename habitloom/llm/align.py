"""Tokens of two tokenizers aligned where both end, in fragments that compose."""

import dataclasses
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from habitloom.llm.common import kept_in_worker, pick
from habitloom.session import materialize

# Bytes of a chunk; longer documents are cut every so many bytes, wherever that falls.
CHUNK = 1 << 16
# Fragments composed by one task of a round.
FAN = 16
# Segments kept from text to text, in each of two generations, and the longest of them: bounds of memory only.
KEPT, KEPT_LENGTH = 160_000, 64
DOCS_AT_ONCE = 256
# A blank between two characters that are none: neither tokenizer joins across it, and both begin a token with it.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
# The same in UTF-8; the odd sequences are the white space beyond ASCII.
_ODD = [rb"\xc2[\x85\xa0]", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80"]
_SURE = re.compile(rb"(?<=[!-~\x80-\xff])" + b"".join(b"(?<!" + o + b")" for o in _ODD) + rb" (?=[!-~\x80-\xff])" + b"".join(b"(?!" + o + b")" for o in _ODD))


@dataclasses.dataclass(frozen=True)
class Fragment:
    """Groups of a byte range: an open prefix, closed groups and an open suffix.

    ``head`` holds the ids of both sides up to the first place where both end,
    ``tail`` those after the last one; ``closed`` the groups between as text.
    Without such a place (``cut`` false) everything is ``head``.
    """

    cut: bool = False
    head: tuple = ((), ())
    closed: str = ""
    tail: tuple = ((), ())

    def then(self, after: "Fragment") -> "Fragment":
        """The fragment of both ranges, one after the other. Associative; ``Fragment()`` changes nothing."""
        if not self.cut:
            return dataclasses.replace(after, head=_both(self.head, after.head))
        if not after.cut:
            return dataclasses.replace(self, tail=_both(self.tail, after.head))
        middle = group_text(*_both(self.tail, after.head))
        return Fragment(True, self.head, ";".join(filter(None, (self.closed, middle, after.closed))), after.tail)

    def text(self) -> str:
        """All groups of a whole document."""
        return ";".join(filter(None, (group_text(*self.head), self.closed, group_text(*self.tail))))


def _both(x, y):
    return (*x[0], *y[0]), (*x[1], *y[1])


def group_text(a, b) -> str:
    """``a1,a2|b1``, or nothing without ids."""
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}" if a or b else ""


def fragment_of(a, a_ends, b, b_ends) -> tuple[Fragment, list]:
    """The fragment of two token runs with their end offsets, and the pairs of tokens that end together."""
    groups, pairs, i, j, from_a, from_b = [], [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if a_ends[i] == b_ends[j]:
            pairs.append(a[i] << 32 | b[j])
            groups.append((tuple(a[from_a:i + 1]), tuple(b[from_b:j + 1])))
            i = from_a = i + 1
            j = from_b = j + 1
        elif a_ends[i] < b_ends[j]:
            i += 1
        else:
            j += 1
    rest = tuple(a[from_a:]), tuple(b[from_b:])
    if not groups:
        return Fragment(False, rest), pairs
    return Fragment(True, groups[0], ";".join(group_text(*g) for g in groups[1:]), rest), pairs


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others in order from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the segments met before."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = byte_level()
        with open(path_a, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        # An entry with a character that stands for no byte is taken as it is.
        self.a_bytes = {i: bytes(map(of.__getitem__, t)) if all(c in of for c in t) else t.encode() for t, i in entries.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_lengths[list(self.a_bytes)] = [len(t) for t in self.a_bytes.values()]
        self.b_lengths = np.array([len(t) for t in self.b_bytes], np.int64)
        self.marked = [f"{i}{mark}" for i in range(max(len(self.a_lengths), len(self.b_lengths))) for mark in ",|;\n"]
        self.known, self.before = {}, {}

    def tokens(self, segments):
        """Ids, their number per segment and their end offsets, of both sides, over all segments each behind a blank; and which segments come back byte by byte."""
        raw = [b" " + s.encode() for s in segments]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        of_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
        of_b = self.b.encode(segments, num_threads=1)
        sides, good = [], np.ones(len(segments), bool)
        for lists, token_bytes, lengths in ((of_a, self.a_bytes, self.a_lengths), (of_b, self.b_bytes, self.b_lengths)):
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(counts.sum()))
            if b"".join(map(token_bytes.__getitem__, ids.tolist())) != b"".join(raw):
                good &= np.fromiter((b"".join(map(token_bytes.__getitem__, x)) == r for x, r in zip(lists, raw, strict=True)), bool, len(raw))
            sides.append((ids, counts, lengths))
        if not good.all():  # what does not come back has no tokens
            sides = [(ids[np.repeat(good, counts)], np.where(good, counts, 0), lengths) for ids, counts, lengths in sides]
        return [(ids, counts, np.cumsum(lengths[ids])) for ids, counts, lengths in sides], np.cumsum(np.where(good, sizes, 0)), good

    def learn(self, segments):
        """Numbers, groups as text and links of whole segments, whose ends close a group on both sides."""
        if not segments:
            return {}
        ((a, count_a, a_ends), (b, count_b, b_ends)), ends, good = self.tokens(segments)
        common, at_a, at_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        # Of each group first the tokens of A, then those of B; a mark behind each tells what follows.
        text = np.empty(len(a) + len(b), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[at_a], mark_b[at_b] = 1, np.where(np.isin(common, ends), 3, 2)
        before = np.concatenate([[0], at_b + 1])
        text[np.arange(len(a)) + before[np.searchsorted(at_a, np.arange(len(a)))]] = 4 * a + mark_a
        text[np.arange(len(b)) + at_a[np.searchsorted(at_b, np.arange(len(b)))] + 1] = 4 * b + mark_b
        groups = iter("".join(map(self.marked.__getitem__, text.tolist())).split("\n"))
        pairs = tuple((a[at_a] << 32 | b[at_b]).tolist())
        # Only segments that come back have ends; each of those ends a group.
        last = np.searchsorted(common, ends, "right").tolist()
        return {s: (n_a, n_b, next(groups), pairs[first:end]) if ok else False for s, ok, n_a, n_b, first, end in zip(
            segments, good.tolist(), count_a.tolist(), count_b.tolist(), [0, *last[:-1]], last, strict=True)}

    def aligned(self, chunks):
        """``(ok, n_a, n_b, fragment, pairs)`` per ``(slice, start, low, high, end)``: the tokens that end in the byte range ``low`` to ``high``.

        A slice has the bytes ``start`` to ``end``; it begins with a blank and
        ends where both tokenizers have a boundary, so that its tokens are those
        of the whole text. Only its first and last segments may reach beyond
        the range.
        """
        if len(self.known) > KEPT:
            self.known, self.before = {}, self.known
        split = []
        for text, *_ in chunks:
            segments = _SPLIT.split(text)
            segments[0] = segments[0][1:]
            split.append(segments)
        found = [list(map(self.known.get, segments)) for segments in split]
        missing = {s for segments, values in zip(split, found, strict=True) if None in values for s, v in zip(segments, values, strict=True) if v is None}
        new = {s: self.before[s] for s in missing if s in self.before}
        new |= self.learn([s for s in missing if s not in new])
        self.known.update((s, v) for s, v in new.items() if len(s) <= KEPT_LENGTH)
        for (_, start, low, high, end), segments, values in zip(chunks, split, found, strict=True):
            if None in values:
                values = [new[s] if v is None else v for s, v in zip(segments, values, strict=True)]
            if False in values:
                yield False, 0, 0, Fragment(), []
                continue
            edges = {}
            if start < low:
                edges[0] = start
            if high < end:
                edges[len(values) - 1] = end - len(segments[-1].encode()) - 1
            whole = values[int(start < low):len(values) - int(high < end)]
            counts_a, counts_b, texts, links = zip(*whole, strict=True) if whole else ((), (), (), ())
            n_a, n_b, pairs = sum(counts_a), sum(counts_b), list(itertools.chain.from_iterable(links))
            fragment = Fragment(True, closed=";".join(texts)) if whole else Fragment()
            for place, at in edges.items():
                sides, _, _ = self.tokens([segments[place]])
                own = [(ids[(low < at + ends) & (at + ends <= high)].tolist(), ends[(low < at + ends) & (at + ends <= high)].tolist()) for ids, _, ends in sides]
                edge, links = fragment_of(*own[0], *own[1])
                n_a, n_b, pairs = n_a + len(own[0][0]), n_b + len(own[1][0]), pairs + links
                fragment = edge.then(fragment) if place == 0 else fragment.then(edge)
            yield True, n_a, n_b, fragment, pairs


def chunks_of(raw: bytes, chunk: int):
    """``(start, end, low, high)`` of the chunks of a text: the byte ranges, and slices around them that end at sure boundaries.

    Where both tokenizers have no sure boundary within a quarter of a chunk of
    a cut, the chunk goes on to the next one.
    """
    bounds = []
    for at in range(chunk, len(raw), chunk):
        sure = [m.start() for m in _SURE.finditer(raw, max(0, at - chunk // 4), min(len(raw), at + chunk // 4 + 1))]
        before, after = [p for p in sure if p <= at], [p for p in sure if p >= at]
        if before and after:
            bounds.append((at, before[-1], after[0]))
    low = start = 0
    for at, before, after in bounds:
        yield start, after, low, at
        low, start = at, before
    yield start, len(raw), low, len(raw)


def _counted(pairs):
    pair, n = np.unique(np.array(pairs, np.int64), return_counts=True)
    return pair, n


def _row_keys():
    """Numbers that no other task gives; a task that runs again gives the same."""
    return itertools.count(TaskContext.get().partitionId() << 33)


def _lists(values, kind):
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), kind))


LINKS = "pairs array<bigint>, n array<bigint>"


def _short(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents of one chunk: numbers, digest and links, written once."""
    def compute(batches):
        aligner, keys = kept_in_worker(("align", path_a, path_b), lambda: Aligner(path_a, path_b)), _row_keys()
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                texts = [" " + (t or "") for t in part.column(1).to_pylist()]
                found = aligner.aligned([(t, 0, 0, 0, 0) for t in texts])
                rows = []
                for text, (ok, n_a, n_b, fragment, pairs) in zip(texts, found, strict=True):
                    ok = ok and text != " "
                    digest = hashlib.sha256(fragment.text().encode()).hexdigest() if ok else ""
                    rows.append((next(keys), n_a, n_b, len(pairs), digest, *_counted(pairs)) if ok else (next(keys), 0, 0, 0, "", *_counted([])))
                key, n_a, n_b, links, digest, pair, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key, pa.int64()), part.column(0), *(pa.array(c, pa.int64()) for c in (n_a, n_b, links)), pa.array(digest), _lists(pair, pa.int64()), _lists(n, pa.int64()),
                ], names=["key", "doc_id", "n_a", "n_b", "n_links", "digest", "pairs", "n"])

    return materialize(docs.mapInArrow(compute, f"key bigint, doc_id bigint, n_a bigint, n_b bigint, n_links bigint, digest string, {LINKS}"), "align-short")


FRAGMENT = "cut boolean, head_a array<bigint>, head_b array<bigint>, closed string, tail_a array<bigint>, tail_b array<bigint>"


def _packed(fragment):
    return {"cut": fragment.cut, "head_a": list(fragment.head[0]), "head_b": list(fragment.head[1]), "closed": fragment.closed,
            "tail_a": list(fragment.tail[0]), "tail_b": list(fragment.tail[1])}


def _unpacked(row):
    return Fragment(row["cut"], (tuple(row["head_a"]), tuple(row["head_b"])), row["closed"], (tuple(row["tail_a"]), tuple(row["tail_b"])))


_ids = pa.list_(pa.int64())
_FRAGMENT_FIELDS = [("cut", pa.bool_()), ("head_a", _ids), ("head_b", _ids), ("closed", pa.string()), ("tail_a", _ids), ("tail_b", _ids)]


def _chunk_rows(docs: DataFrame, chunk: int) -> DataFrame:
    """``(key, doc_id, number, start, low, high, slice)`` of long documents, written once."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("number", pa.int64()), ("start", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("slice", pa.binary())])

    def cut(batches):
        keys = _row_keys()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, key = b" " + text.as_py().encode(), -1 - next(keys)
                rows = [(key, doc_id, i, start, low, high, raw[start:end]) for i, (start, end, low, high) in enumerate(chunks_of(raw, chunk))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return materialize(docs.mapInArrow(cut, "key bigint, doc_id bigint, number bigint, start bigint, low bigint, high bigint, slice binary"), "align-chunks")


def _fragments(chunks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A fragment per chunk, each aligned by itself in whatever task; links are those that end in the chunk."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("number", pa.int64()), ("ok", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_links", pa.int64()), ("pairs", _ids), ("n", _ids), *_FRAGMENT_FIELDS])

    def compute(batches):
        aligner = kept_in_worker(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ok, n_a, n_b, fragment, pairs = next(aligner.aligned([(row["slice"].decode(), row["start"], row["low"], row["high"], row["start"] + len(row["slice"]))]))
                pair, n = _counted(pairs)
                yield pa.RecordBatch.from_pylist([{
                    "key": row["key"], "doc_id": row["doc_id"], "number": row["number"], "ok": ok, "n_a": n_a, "n_b": n_b, "n_links": len(pairs), "pairs": pair, "n": n, **_packed(fragment)}], schema=schema)

    partitions = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(partitions, "key", "number")
    return materialize(dealt.mapInArrow(compute, f"key bigint, doc_id bigint, number bigint, ok boolean, n_a bigint, n_b bigint, n_links bigint, {LINKS}, {FRAGMENT}"), "align-fragments")


def composed(fragments: DataFrame, fan: int) -> DataFrame:
    """``(key, number, ...)``: the fragments of each key composed in the order of ``number``, ``fan`` at a time, round by round."""
    schema = pa.schema([("key", pa.int64()), ("number", pa.int64()), *_FRAGMENT_FIELDS])

    def join(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        whole = Fragment()
        for row in rows:
            whole = whole.then(_unpacked(row))
        return pa.Table.from_pylist([{"key": rows[0]["key"], "number": rows[0]["number"] // fan, **_packed(whole)}], schema=schema)

    names = ["key", "number", *[name for name, _ in _FRAGMENT_FIELDS]]
    left = fragments.agg(F.max("number")).first()[0] or 0
    found = fragments.select(*names)
    while left:
        found = materialize(found.groupBy("key", F.floor(F.col("number") / fan).alias("bunch")).applyInArrow(
            lambda table: join(table.select(names)), f"key bigint, number bigint, {FRAGMENT}"), "align-composed")
        left //= fan
    return found


def _long(docs: DataFrame, path_a: str, path_b: str, chunk: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Documents of several chunks: the same columns as ``_short`` without links, and their links chunk by chunk."""
    fragments = _fragments(_chunk_rows(docs, chunk), path_a, path_b)
    sums = fragments.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.min("ok").alias("ok"), *[F.sum(c).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_links")])
    sums = materialize(sums, "align-long")

    def digest(batches):
        for batch in batches:
            texts = (_unpacked(batch.slice(i, 1).to_pylist()[0]).text() for i in range(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())], names=["key", "digest"])

    digests = composed(fragments, fan).select("key", *[name for name, _ in _FRAGMENT_FIELDS]).mapInArrow(digest, "key bigint, digest string")
    number = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(0).alias(c)
    rows = sums.join(digests, "key").select(
        "key", "doc_id", number("n_a"), number("n_b"), number("n_links"), F.when(F.col("ok"), F.col("digest")).otherwise("").alias("digest"))
    links = fragments.join(sums.where("ok").select("key"), "key", "left_semi").select("key", "pairs", "n")
    return rows, links


def align(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``(doc_id, text)``.

    A blank and the text are encoded by the byte-level file ``path_a``, the
    text by the piece model ``path_b``, which adds that blank itself. Where
    tokens of both end at one byte, a group ends and its two last tokens are
    linked. A pair of ids counts how many links of the corpus hold it;
    ``n_best`` are the links whose pair counts most for its id of B, ties
    included, ``count_sum`` adds up the counts of all links. The digest is of
    the groups as text (``Fragment.text``).

    Null and empty texts, and those that either tokenizer does not give back
    byte by byte, have no tokens: zeros, and no digest. Repeated rows count as
    often as they occur. Documents of ``chunk`` bytes or more are cut into byte
    ranges that are aligned apart: whatever is open at their ends is closed as
    fragments are composed, so the ranges change nothing. A document with no
    sure boundary of both tokenizers near any cut stays one chunk.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    is_long = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))
    short = _short(rows.where(~is_long), path_a, path_b)
    long_rows, long_links = _long(rows.where(is_long), path_a, path_b, chunk, fan)
    columns = ["key", "doc_id", "n_a", "n_b", "n_links", "digest"]
    every = short.select(*columns).unionByName(long_rows)
    links = short.select("key", "pairs", "n").unionByName(long_links).select("key", F.explode(F.arrays_zip("pairs", "n")).alias("l")) \
        .select("key", F.col("l.pairs").alias("pair"), F.col("l.n").alias("n"))
    # At most a row per pair of the two vocabularies.
    counts = materialize(links.groupBy("pair").agg(F.sum("n").alias("count")), "align-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id")
    highest = counts.groupBy(b_id).agg(F.max("count").alias("highest"))
    judged = materialize(counts.select("*", b_id).join(highest, "b_id").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "align-best")
    sums = links.join(judged, "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return every.join(sums, "key", "left").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), F.col("digest").alias("groups_sha256"))
