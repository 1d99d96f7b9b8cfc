"""Exact links between sets of 64-bit tokens, group by group."""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from habitloom.llm.common import pick
from habitloom.session import discard, materialize

# Tokens of a group that one task holds; larger groups are split into parts of about this size.
GROUP_TOKENS = 1 << 19
# Sets of one side that are compared at once, and shared tokens of them that are multiplied at once.
ROWS, COLUMNS = 512, 2048
# A token in more pairs of sets than these is a column of a matrix product; rarer ones are counted pair by pair.
DENSE = 4096
# Bits of the map that leaves out texts nobody asks for: so many for each that is asked for, but no more than these in all.
MAP_SHARE, MAP_BITS = 8, 1 << 24
# Bytes of text that are hashed at once.
PIECE = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
# Odd, so that its powers have inverses.
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(inverse):
    """Powers of the base, or of its inverse, up to a piece."""
    factor = np.full(PIECE + 1, pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
    factor[0] = 1
    return np.cumprod(factor)


def _hashed_words(raw: bytes):
    """Where each word of a lower-cased text begins, and its 64-bit hash: a polynomial in its bytes, mixed."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):  # no word is cut; one longer than a piece is hashed in steps
            blanks = np.flatnonzero(_BLANK[np.frombuffer(raw, np.uint8, end - at, at)])
            end = at + int(blanks[-1]) + 1 if len(blanks) else end
        piece = np.frombuffer(raw, np.uint8, end - at, at)
        sums = np.cumsum(_BYTES[piece] * _powers(False)[:len(piece)])
        inside = np.concatenate([[False], ~_BLANK[piece], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        value = (sums[last - 1] - np.where(first > 0, sums[first - 1], np.uint64(0))) * _powers(True)[first]
        size = last - first
        if starts and len(first) and first[0] == 0 and not _BLANK[raw[at - 1]]:
            # The word goes on from the piece before, which it began.
            hashes[-1][-1:] = _mixed(hashes[-1][-1:] + value[:1] * np.uint64(3) + size[:1].astype(np.uint64))
            first, value, size = first[1:], value[1:], size[1:]
        if len(first):
            starts.append(first + at)
            hashes.append(_mixed(value + size.astype(np.uint64)))
        at = end
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.uint64), *hashes])


def _folded(hashes, size):
    """Hashes of all runs of ``size`` words."""
    n = len(hashes) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mixed(total * np.uint64((_BASE * (2 * k + 1) | 1) % (1 << 64)) + hashes[k:k + n])
    return total


def shingle_sets(texts, shingle: int):
    """Per UTF-8 text the distinct 64-bit hashes, in order, of its word shingles.

    A-Z are lowered; words are runs of anything but ASCII white space. A text of
    fewer words is one shingle; null and a text without words have none. Texts
    are hashed many at a time.
    """
    held, size = [], 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1]) + 1
        if size >= PIECE:
            yield from _sets_of(held, shingle)
            held, size = [], 0
    yield from _sets_of(held, shingle)


def _sets_of(texts, shingle):
    if not texts:
        return
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, hashes = _hashed_words(b"\n".join([*texts, b""]).translate(_LOWER))
    cuts = np.searchsorted(starts, bounds).tolist()
    every = _folded(hashes, shingle) if len(hashes) >= shingle else hashes[:0]
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        if last - first >= shingle:
            yield np.unique(every[first:last - shingle + 1])
        else:
            yield _folded(hashes[first:last], last - first) if last > first else hashes[:0]


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return next(shingle_sets([text], shingle))


def least_overlap(n, percent: int):
    """Tokens of a set of ``n`` that any set of that Jaccard percentage has in common with it."""
    return -(-percent * n // 100)


def thin(u, v, n):
    """A forest over nodes 0 to n - 1 with the components of the links (u, v)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        if (label[u] == low).all() and (label[v] == low).all():
            break
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


class Group:
    """Sets of a group: their ids and sizes, the token union, in how many sets each token is, and these sets in token order."""

    FIELDS = {"ids": "<i8", "sizes": "<i8", "union": "<u8", "counts": "<i4", "rows": "<i4"}

    def __init__(self, ids, sizes, union, counts, rows):
        self.ids, self.sizes, self.union, self.counts, self.rows = ids, sizes, union, counts, rows

    @classmethod
    def of(cls, ids, sets):
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
        rows = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        return cls(np.asarray(ids, np.int64), sizes, *np.unique(tokens, return_counts=True), rows[order])

    @classmethod
    def read(cls, row, prefix=""):
        ids, sizes, union, counts, rows = (np.frombuffer(row[prefix + name], kind) for name, kind in cls.FIELDS.items())
        return cls(ids, sizes, union, counts.astype(np.int64), rows.astype(np.int64))

    def row(self, prefix=""):
        return {prefix + name: getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS.items()}

    def overlaps(self, union):
        """How many tokens of each set are in ``union``, sorted tokens of another group: a bound on any overlap inside it."""
        at = np.minimum(np.searchsorted(union, self.union), max(0, len(union) - 1))
        inside = union[at] == self.union if len(union) else np.zeros(len(self.union), bool)
        return np.bincount(self.rows[np.repeat(inside, self.counts)], minlength=len(self.ids))

    def only(self, kept):
        """The group with the sets of the mask ``kept`` alone."""
        held = kept[self.rows]
        token = np.repeat(np.arange(len(self.union)), self.counts)[held]
        counts = np.bincount(token, minlength=len(self.union))
        return Group(self.ids[kept], self.sizes[kept], self.union[counts > 0], counts[counts > 0], (np.cumsum(kept) - 1)[self.rows[held]])

    def stretch(self, start, rows):
        """Tokens of the sets ``start`` to ``start + rows``, and where each begins and ends in the list of these sets, counted from ``start``."""
        mine = (self.rows >= start) & (self.rows < start + rows)
        counts = np.bincount(np.repeat(np.arange(len(self.union)), self.counts)[mine], minlength=len(self.union))
        last = np.cumsum(counts[counts > 0])
        return self.union[counts > 0], last - counts[counts > 0], last, self.rows[mine] - start


def similar(a: Group, b: Group, same: bool, percent: int):
    """Links between the sets of two groups, thinned to a forest: indices into ``a`` followed by ``b``.

    Overlaps are counted exactly, for some sets of ``a`` and all of ``b`` at
    once: tokens that few pairs share pair by pair, others as a product of
    matrices with a column per token. Empty sets have no links.
    """
    nodes, shift = (len(a.ids), 0) if same else (len(a.ids) + len(b.ids), len(a.ids))
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    b_last = np.cumsum(b.counts)
    b_first, width = b_last - b.counts, len(b.ids)
    for start in range(0, len(a.ids), ROWS):
        rows = min(ROWS, len(a.ids) - start)
        own, first, last, at = a.stretch(start, rows)
        _, i, j = np.intersect1d(own, b.union, assume_unique=True, return_indices=True)
        n_a, n_b = last[i] - first[i], b_last[j] - b_first[j]
        counts = np.zeros(rows * width, np.float32)
        rare = n_a * n_b <= DENSE
        if rare.any():
            for some in np.array_split(np.flatnonzero(rare), max(1, int((n_a * n_b)[rare].sum() >> 24))):
                pairs = n_a[some] * n_b[some]
                token = np.repeat(some, pairs)
                within = np.arange(len(token)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                left, right = np.divmod(within, n_b[token])
                key = at[first[i[token]] + left] * width + b.rows[b_first[j[token]] + right]
                counts += np.bincount(key, minlength=rows * width).astype(np.float32)
        counts = counts.reshape(rows, width)
        dense = np.flatnonzero(~rare)
        for some in (dense[k:k + COLUMNS] for k in range(0, len(dense), COLUMNS)):
            left, right = np.zeros((rows, len(some)), np.float32), np.zeros((width, len(some)), np.float32)
            for matrix, of, begin, n in ((left, at, first[i[some]], n_a[some]), (right, b.rows, b_first[j[some]], n_b[some])):
                column = np.repeat(np.arange(len(some)), n)
                within = np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n)
                matrix[of[begin[column] + within], column] = 1
            counts += left @ right.T
        # A float holds every whole number up to 2 ** 24, more than the words that a text of a task has.
        overlap = counts.astype(np.int64)
        close = (100 + percent) * overlap >= percent * (a.sizes[start:start + rows, None] + b.sizes[None, :])
        u, v = np.nonzero(close & (overlap > 0))
        held.append((u + start, v + shift))
        if sum(len(u) for u, _ in held) > 1 << 20:
            held = [thin(*map(np.concatenate, zip(*held, strict=True)), nodes)]
    return thin(*map(np.concatenate, zip(*held, strict=True)), nodes)


GROUP = ", ".join(f"{name} binary" for name in Group.FIELDS)


def parts_of(members: DataFrame, *by: str) -> DataFrame:
    """``members`` (with ``sid`` and ``n``) and ``part``, ``parts``: groups by ``by`` dealt into parts of about ``GROUP_TOKENS`` tokens."""
    sizes = materialize(members.groupBy(*by).agg(F.ceil(F.sum("n") / GROUP_TOKENS).cast("int").alias("parts")), "set-sizes")
    return members.join(sizes, list(by)).withColumn("part", F.pmod(F.xxhash64("sid"), F.greatest("parts", F.lit(1))).cast("int"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, text)``; ``digest`` tells rows of one ``doc_id`` apart."""
    return pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))


def likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most of the rows that ``wanted``, a written table, does not name by ``doc_id`` and ``digest``.

    Each wanted row sets the bit of its hash in a map, words of which are sent
    to every executor. The map does not grow beyond ``MAP_BITS``; the fuller
    it is, the more rows stay that an exact join has to leave out.
    """
    bits = min(MAP_BITS, 1 << max(6, (MAP_SHARE * wanted.count() - 1).bit_length()))
    placed = lambda df: df.withColumn("_place", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(bits))).withColumns({
        "_word": F.expr("_place div 64"), "_bit": F.expr("shiftleft(1L, CAST(_place % 64 AS INT))")})
    words = placed(wanted.select("doc_id", "digest")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = placed(texts).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    return held.select(*texts.columns)


def hashed_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(gid, sid, hashes)``: the shingle sets of the rows of ``docs`` that ``wanted``, a written table, names as ``(doc_id, digest, sid, gid)``.

    A set comes once, in the partition of its group; texts are moved by the
    join alone, and only those likely to be wanted. Repeated rows that follow
    each other, as a sorted join gives them, are left out before sets are moved.
    """
    def compute(batches):
        last = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            batch = batch.filter(pa.array([key != before for key, before in zip(keys, [last, *keys[:-1]], strict=True)], pa.bool_()))
            last = keys[-1] if keys else last
            sets = [s.astype("<u8").tobytes() for s in shingle_sets((t.as_py() for t in batch.column(2)), shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], names=["gid", "sid", "hashes"])

    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.digest") == F.col("w.digest"))
    rows = likely(keyed_texts(docs), wanted).alias("t").join(wanted.alias("w"), same).select("gid", "sid", "text")
    return rows.mapInArrow(compute, "gid bigint, sid bigint, hashes binary").repartition("gid").dropDuplicates(["gid", "sid"])


def gathered(sets: DataFrame) -> DataFrame:
    """``(gid, n_sets, ...)`` of ``(gid, sid, hashes)``: each group with its token union, written once."""
    fields = pa.schema([("gid", pa.int64()), ("n_sets", pa.int64()), *[(name, pa.binary()) for name in Group.FIELDS]])

    def gather(table):
        group = Group.of(table.column("sid").to_numpy(), [np.frombuffer(h.as_buffer(), "<u8") for h in table.column("hashes")])
        return pa.Table.from_pylist([{"gid": table.column("gid")[0].as_py(), "n_sets": len(group.ids), **group.row()}], schema=fields)

    return materialize(sets.groupBy("gid").applyInArrow(gather, f"gid bigint, n_sets bigint, {GROUP}"), "set-groups")


def _links(query: Group, group: Group, same: bool, percent: int):
    u, v = similar(query, group, same, percent)
    ids = query.ids if same else np.concatenate([query.ids, group.ids])
    return pa.RecordBatch.from_arrays([pa.array(ids[v]), pa.array(ids[u])], names=["a", "b"])


def _one_by_one(batches):
    """Rows as dicts; only one is held in Python at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def linked(groups: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links between the sets of a group, and of the paired groups ``(a, b)`` of ``gathered``; a forest per pair of groups.

    First each set of ``a`` is held against the token union of ``b``: a set
    with fewer tokens there than any similar set must share can't have a
    partner in ``b``. Only groups with a set left to ask are opened.
    """
    partitions = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = materialize(pairs.where("a <> b"), "set-pairs")
    meeting = materialize(pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct(), "set-meeting")
    some = groups.join(meeting, "gid", "left_semi")
    queries = some.select(F.col("gid").alias("a"), *Group.FIELDS)
    asked = pairs.join(some.select(F.col("gid").alias("b"), F.col("union").alias("asked")), "b").join(queries, "a")
    prefixed = [f"q_{name}" for name in Group.FIELDS]
    schema = pa.schema([("b", pa.int64()), *[(name, pa.binary()) for name in prefixed]])

    def bound(batches):
        for row in _one_by_one(batches):
            group = Group.read(row)
            kept = (group.overlaps(np.frombuffer(row["asked"], "<u8")) >= least_overlap(group.sizes, percent)) & (group.sizes > 0)
            if kept.any():
                yield pa.RecordBatch.from_pylist([{"b": row["b"], **group.only(kept).row("q_")}], schema=schema)

    def inside(batches):
        for row in _one_by_one(batches):
            group = Group.read(row)
            yield _links(group, group, True, percent)

    def across(batches):
        for row in _one_by_one(batches):
            yield _links(Group.read(row, "q_"), Group.read(row), False, percent)

    # Comparing takes longer than reading, so what is opened is dealt out by number.
    open_ = materialize(asked.select("b", "asked", *Group.FIELDS).mapInArrow(bound, "b bigint, " + ", ".join(f"{name} binary" for name in prefixed)), "set-queries")
    opened = open_.join(some.withColumnRenamed("gid", "b"), "b").select(*prefixed, *Group.FIELDS).repartition(partitions, F.xxhash64("ids", "q_ids"))
    own = groups.where("n_sets > 1").select(*Group.FIELDS).mapInArrow(inside, "a bigint, b bigint")
    links = materialize(own.unionByName(opened.mapInArrow(across, "a bigint, b bigint")), "set-links")
    discard(open_)
    return links
