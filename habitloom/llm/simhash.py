"""Near-duplicates by SimHash, all fingerprints compared exactly in tiles."""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from habitloom.llm.common import pick, running_offsets
from habitloom.llm.components import components
from habitloom.llm.setjoin import gathered, hashed_sets, least_overlap, linked, parts_of, thin
from habitloom.session import discard, materialize

# Fingerprints of one tile, at least and at most; what a task holds of either side of a comparison.
TILE, LARGEST_TILE = 7 << 12, 1 << 18
# Tiles of as many fingerprints as lie between these two sizes: their pairs occupy the tasks, and fewer tiles are sent less often.
TILES = 16
# Sorted fingerprints that are written together; tiles are made of them.
RUN = 4096
# Fingerprints of either tile that are compared at once, so that what is made of them stays in a core's cache; links held before they are thinned.
ROWS, COLUMNS, HELD = 32, 4096, 1 << 20
# Shingles hashed before their bits are added up.
CHUNK = 1 << 16
BLOCKS = (0, 16, 32, 48)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def radius_for(similarity: float, bits: int, deviations: float = 2) -> int:
    """Bits within which fingerprints of texts with this share of common shingles lie, but for one pair in forty.

    The share gives the cosine of the shingle counts, its angle the chance
    that a bit differs; the allowance is two standard deviations, or as many
    as are given.
    """
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * chance + deviations * math.sqrt(bits * chance * (1 - chance)))


def _spread(hashes, word):
    """Independent further 64-bit hashes from given ones; the first word's are the given ones."""
    if not word:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(text: bytes | None, shingle: int, seed: int):
    """XXH64 of each shingle of a UTF-8 text, some at a time, repeats included."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), CHUNK):
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist(), strict=True)])
        yield np.frombuffer(raw, ">u8").astype(np.uint64)


def _majority(chunks, size: int) -> bytes:
    """Bits that are set in more than half of the hashes, for ``size`` words."""
    counts, n = np.zeros((size, 64), dtype=np.int64), 0
    for hashes in chunks:
        n += len(hashes)
        for word in range(size):
            bits = np.unpackbits(_spread(hashes, word).astype(">u8").view(np.uint8))
            counts[word] += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts.ravel() > n).tobytes()


def fingerprint(text: bytes | None, shingle: int, seed: int, size: int = 1) -> bytes:
    """SimHash of a UTF-8 text in ``size`` words of 64 bits, greatest bit first.

    A-Z are lowered; words are runs of anything but ASCII white space; each
    shingle of ``shingle`` words joined by a space is hashed by XXH64, repeats
    included. A shorter text is one shingle; a text without words gives 0. A
    bit is set if it is set in more than half of the hashes.
    """
    return _majority(_shingles(text, shingle, seed), size)


def shingle_set(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order; none for a text without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, shingle, seed)]))


def set_fingerprint(text: bytes | None, shingle: int, seed: int, size: int) -> bytes:
    """SimHash like ``fingerprint``, each distinct shingle once, and two words more: a digest of their set and how many they are."""
    hashes = shingle_set(text, shingle, seed)
    chunks = (hashes[at:at + CHUNK] for at in range(0, len(hashes), CHUNK))
    return _majority(chunks, size) + xxhash.xxh3_64_digest(hashes.tobytes()) + len(hashes).to_bytes(8, "big")


def fingerprints(docs: DataFrame, shingle: int, seed: int, size: int, of=fingerprint) -> DataFrame:
    """``(doc_id, digest, fp)``: a row per row of ``(doc_id, text)``, written once.

    ``digest`` tells rows of one ``doc_id`` apart; ``of`` makes the fingerprint.
    """
    def compute(batches):
        for batch in batches:
            fps = [of(t.as_py(), shingle, seed, size) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], names=["doc_id", "digest", "fp"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(compute, "doc_id bigint, digest bigint, fp binary"), "simhash-rows")


def _array(fps: bytes, size: int):
    """Fingerprints end to end as a table of 64-bit words."""
    return np.frombuffer(fps, ">u8").astype(np.uint64).reshape(-1, size)


def _tiles(fps: DataFrame, size: int, sized: bool = False) -> DataFrame:
    """Distinct fingerprints in tiles, ordered by population count of the first word, in whole and by 16-bit blocks.

    A tile carries the least and greatest of these counts. How many there are
    goes by the number of fingerprints, not by that of partitions: each is sent
    to as many tasks as there are others. If ``sized``, the last word is the
    size of a set; the order, and what a tile carries, is that size alone.
    """
    first = F.conv(F.hex(F.substring("fp", 8 * size - 7 if sized else 1, 8)), 16, -10).cast("bigint")
    block = lambda shift: F.bit_count(F.shiftrightunsigned("first", shift).bitwiseAND(F.lit(0xFFFF)))
    order = [F.col("first"), F.col("fp")] if sized else [F.bit_count("first"), *[block(shift) for shift in BLOCKS[:-1]], F.col("fp")]
    total = fps.count()
    number = max(1, math.ceil(total / min(LARGEST_TILE, max(TILE, total // TILES))))
    dealt = fps.select("fp", first.alias("first")).repartitionByRange(max(1, math.ceil(total / TILE)), *order).sortWithinPartitions(*order).select("fp")

    def cut(batches):
        held, run = [], TaskContext.get().partitionId() << 32
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= RUN:
                yield written(run, held[:RUN])
                held, run = held[RUN:], run + 1
        if held:
            yield written(run, held)

    def written(run, fps):
        return pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([len(fps)], pa.int64()), pa.array([b"".join(fps)], pa.binary())], names=["run", "n", "fps"])

    def tile(table):
        raw = b"".join(table.sort_by("run").column("fps").to_pylist())
        first = _array(raw, size)[:, -1 if sized else 0]
        counts = [first] if sized else [np.bitwise_count(first), *[np.bitwise_count((first >> np.uint64(s)) & np.uint64(0xFFFF)) for s in BLOCKS]]
        return pa.Table.from_pylist([{
            "tile": table.column("tile")[0].as_py(), "least": [int(c.min()) for c in counts], "most": [int(c.max()) for c in counts], "fps": raw,
        }], schema=pa.schema([("tile", pa.int64()), ("least", pa.list_(pa.int32())), ("most", pa.list_(pa.int32())), ("fps", pa.binary())]))

    runs = materialize(dealt.mapInArrow(cut, "run bigint, n bigint, fps binary"), "simhash-runs")
    offsets = F.broadcast(running_offsets(runs.select("run", "n"), "run", "n"))  # a row per run
    placed = runs.join(offsets, "run").select(F.floor(F.col("n_before") * number / F.col("n_all")).alias("tile"), "run", "fps")
    tiles = materialize(placed.groupBy("tile").applyInArrow(tile, "tile bigint, least array<int>, most array<int>, fps binary"), "simhash-tiles")
    discard(runs)
    return tiles


def _pairs(tiles: DataFrame, radius: int, percent: int | None = None) -> DataFrame:
    """Pairs of tiles that may hold fingerprints within the radius.

    Two fingerprints differ in at least as many bits as their population counts
    do, in whole and summed over the blocks. Tiles meet on a common count. With
    a ``percent``, tiles carry sizes of sets: those of a pair of such a
    similarity differ by that share at most.
    """
    ends = tiles.select("tile", "least", "most")
    if percent is not None:
        side = lambda x: ends.select(F.col("tile").alias(x), F.col("least")[0].alias(f"{x}_least"), F.col("most")[0].alias(f"{x}_most"))
        near = (100 * F.col("a_most") >= percent * F.col("b_least")) & (100 * F.col("b_most") >= percent * F.col("a_least"))
        # A row per tile, which holds thousands of fingerprints.
        return side("a").join(F.broadcast(side("b")), (F.col("a") <= F.col("b")) & near).select("a", "b")
    left = ends.select(F.col("tile").alias("a"), F.col("least").alias("a_least"), F.col("most").alias("a_most"),
                       F.explode(F.sequence(F.get("least", F.lit(0)), F.get("most", F.lit(0)))).alias("ones"))
    right = ends.select(F.col("tile").alias("b"), F.col("least").alias("b_least"), F.col("most").alias("b_most"),
                        F.explode(F.sequence(F.get("least", F.lit(0)) - radius, F.get("most", F.lit(0)) + radius)).alias("ones"))
    gap = F.zip_with(F.arrays_zip("a_least", "a_most"), F.arrays_zip("b_least", "b_most"), lambda x, y: F.greatest(
        x["a_least"] - y["b_most"], y["b_least"] - x["a_most"], F.lit(0)))
    apart = F.aggregate(F.slice(gap, F.lit(2), F.lit(len(BLOCKS))), F.lit(0), lambda x, y: x + y)
    return left.join(right, "ones").where(F.col("a") <= F.col("b")).where(apart <= radius).select("a", "b").distinct()


def tile_links(a, b, same: bool, radius: int, first_radius: int, compared: int | None = None, percent: int | None = None):
    """Links between the fingerprints of two tiles, thinned to a forest: indices into ``a`` followed by ``b``.

    The first ``compared`` words are compared (all, if not given); further ones only name a fingerprint.

    Both are sorted by population count, so each few rows of ``a`` meet only
    the stretch of ``b`` whose counts are near enough. With a ``percent``, both
    are sorted by the last word, the size of a set, and rows meet the stretch
    whose sizes allow that similarity. First words are all
    compared; where there are more, pairs within ``first_radius`` are compared
    in whole. Of a dense group no more than a link per fingerprint is kept;
    its component stays the same.
    """
    compared = compared or a.shape[1]
    if percent is None:
        order_a, order_b = np.bitwise_count(a[:, 0]).astype(int), np.bitwise_count(b[:, 0]).astype(int)
        least, most = order_a - first_radius, order_a + first_radius
    else:
        order_a, order_b = a[:, -1].astype(int), b[:, -1].astype(int)
        least, most = least_overlap(order_a, percent), 100 * order_a // percent
    n, shift = (len(a), 0) if same else (len(a) + len(b), len(a))
    held, size = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))], 0
    words_a, words_b = ([np.ascontiguousarray(x[:, k]) for k in range(compared)] for x in (a, b))
    differ, ones = np.empty(ROWS * COLUMNS, np.uint64), np.empty(ROWS * COLUMNS, np.uint8)
    near = np.zeros(ROWS * COLUMNS + 8, bool)
    for at in range(0, len(a), ROWS):
        rows = min(ROWS, len(a) - at)
        first = np.searchsorted(order_b, least[at], "left")
        last = np.searchsorted(order_b, most[at + rows - 1], "right")
        if same:
            first = max(first, at)
        for start in range(first, last, COLUMNS):
            columns = min(COLUMNS, last - start)
            pairs = rows * columns
            np.bitwise_xor(words_a[0][at:at + rows, None], words_b[0][start:start + columns], out=differ[:pairs].reshape(rows, columns))
            np.bitwise_count(differ[:pairs], out=ones[:pairs])
            np.less_equal(ones[:pairs], first_radius, out=near[:pairs])
            near[pairs:pairs + 8] = False
            # Few pairs are near, so eight are looked at in one step.
            eights = np.flatnonzero(near[:-(-pairs // 8) * 8].view(np.uint64))
            if not len(eights):
                continue
            found = np.flatnonzero(near.reshape(-1, 8)[eights])
            found = eights[found >> 3] * 8 + (found & 7)
            bits = ones[found].astype(np.int64)
            i, j = np.divmod(found, columns)
            i, j = i + at, j + start
            for k in range(1, compared):
                bits += np.bitwise_count(words_a[k][i] ^ words_b[k][j])
            kept = bits <= radius
            i, j = i[kept], j[kept]
            kept = (least[i] <= order_b[j]) & (order_b[j] <= most[i])
            if same:
                kept &= i < j
            if kept.any():
                held.append((i[kept], j[kept] + shift))
                size += len(held[-1][0])
                if size > HELD:
                    held, size = [thin(*map(np.concatenate, zip(*held, strict=True)), n)], 0
    return thin(*map(np.concatenate, zip(*held, strict=True)), n)


def _dealt(fps: DataFrame, size: int, radius: int, percent: int | None = None) -> DataFrame:
    """``(a, b, tile, fps)``: for every pair of tiles that the counts or sizes can't tell apart, each of them, in the partition of the pair."""
    tiles = _tiles(fps, size, percent is not None)
    pairs = materialize(_pairs(tiles, radius, percent), "simhash-pairs")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    # Comparing takes far longer than reading, so pairs are dealt out by number, not by bytes.
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sides.join(tiles.select("tile", "fps"), "tile").select("a", "b", "tile", "fps").repartition(partitions, "a", "b")


def links(fps: DataFrame, radius: int, size: int, first_radius: int, width: int | None = None, percent: int | None = None) -> DataFrame:
    """``(a, b)``: links of distinct fingerprints ``fp`` within ``radius`` bits, a forest per pair of tiles.

    Every pair of tiles that the counts can't tell apart is compared in whole.
    Fingerprints are ``width`` words long, of which ``size`` are compared. With
    a ``percent``, the last word is the size of a set, and pairs whose sizes
    rule out that similarity in hundredths are not linked.
    """
    width = width or size

    def compare(table):
        tiles = dict(zip(table.column("tile").to_pylist(), table.column("fps").to_pylist(), strict=True))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        u, v = tile_links(_array(tiles[a], width), _array(tiles[b], width), a == b, radius, first_radius, size, percent)
        nodes = tiles[a] if a == b else tiles[a] + tiles[b]
        name = lambda k: pa.array([nodes[8 * width * i:8 * width * (i + 1)] for i in k.tolist()], pa.binary())
        return pa.table([name(v), name(u)], names=["a", "b"])

    return _dealt(fps, width, first_radius, percent).groupBy("a", "b").applyInArrow(compare, "a binary, b binary")


def _key(name):
    """An id as text, so that null is a value."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _similar(docs: DataFrame, nodes: DataFrame, similarity: float, radius: int, shingle: int, size: int, first_radius: int) -> DataFrame:
    """``(node, root)`` over ``nodes`` ``(fp, first)`` whose shingle sets are similar enough.

    Fingerprints only form groups: whatever is reachable within the radius,
    from sizes to sizes that such a similarity allows. The sets of a group are then compared with each other exactly, part by
    part, so a group of thousands costs a few exchanges of its sets and no
    pair is sent anywhere.
    """
    percent = round(100 * similarity)
    near = components(links(nodes.select("fp"), radius, size, first_radius, size + 2, percent)).select(F.col("node").alias("fp"), "root")
    members = materialize(near.join(nodes, "fp").select(
        F.monotonically_increasing_id().alias("sid"), "fp", F.xxhash64("root").alias("gid"), "first.doc_id", "first.digest"), "simhash-members")
    sets = materialize(hashed_sets(docs, members, shingle).select("sid", F.col("gid").alias("group"), (F.length("hashes") / 8).cast("bigint").alias("n"), "hashes"), "simhash-sets")
    dealt = parts_of(sets, "group")
    name = lambda part: F.xxhash64("group", part)
    # A group is as many parts as its tokens need; each part meets itself and those after it.
    last = F.greatest("parts", F.lit(1)) - 1
    several = dealt.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.max("parts").alias("parts")).where("size > 1")
    ahead = several.select("group", "parts", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    pairs = materialize(ahead.select("group", "i", F.explode(F.sequence("i", last)).alias("j")).select(name("i").alias("a"), name("j").alias("b")), "simhash-parts")
    groups = gathered(dealt.select(name("part").alias("gid"), "sid", "hashes"))
    discard(sets)
    found = linked(groups, pairs, percent)
    discard(groups)
    of = lambda x: members.select(F.col("sid").alias(x), F.col("fp").alias(f"{x}_fp"))
    return components(found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")))


def classes(docs: DataFrame, radius: int, shingle: int, seed: int, size: int = 1, first_radius: int | None = None, similarity: float | None = None) -> DataFrame:
    """``(doc_id, digest, fp, component)`` per row of ``(doc_id, text)``.

    ``component`` is a struct ``(nameless, doc_id, digest)``: the first row of
    those reachable over fingerprints at most ``radius`` bits apart, by
    ``doc_id``, rows without one last. Equal fingerprints are collapsed before
    any comparison, so exact copies cost one row. Null and texts without words
    have fingerprint zero and are linked like any other. With more than one
    word of 64 bits, a pair is only linked if the first words differ in
    ``first_radius`` bits at most.

    With a ``similarity``, fingerprints take each distinct shingle once and end
    in two words that tell different sets apart; they only form groups. Two rows
    of a group are linked if their distinct shingles have that share in common,
    counted on their hashes, however far apart their fingerprints are. A pair
    that no chain of fingerprints within the radius joins, each link between
    sets whose sizes allow that share, is not looked at.
    """
    rows = fingerprints(docs, shingle, seed, size, fingerprint if similarity is None else set_fingerprint)
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    found = materialize(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-fingerprints")
    first_radius = radius if first_radius is None else first_radius
    if similarity is None:
        ends = components(links(found.select("fp"), radius, size, first_radius))
    else:
        ends = _similar(docs, found, similarity, radius, shingle, size, first_radius)
    roots = ends.select(F.col("node").alias("fp"), "root")
    rooted = materialize(found.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "simhash-roots")
    firsts = materialize(rooted.groupBy("root").agg(F.min("first").alias("component")), "simhash-firsts")
    members = materialize(rooted.join(firsts, "root").select("fp", "component"), "simhash-members")
    for done in (found, rooted, firsts):
        discard(done)
    return rows.join(members, "fp").select("doc_id", "digest", "fp", "component")


def deduplicate(docs: DataFrame, radius: int, shingle: int, seed: int, size: int = 1, first_radius: int | None = None, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each class of ``classes``: that with the least ``doc_id``.

    Of equal rows one stays; all columns are kept. What ``classes`` says of
    pairs beyond the radius holds here.
    """
    found = classes(docs, radius, shingle, seed, size, first_radius, similarity)
    # Join and removal of equal rows share one exchange.
    kept = materialize(found.select(_key("component.doc_id").alias("_key"), F.col("component.digest").alias("_digest")).distinct(), "simhash-kept")
    discard(found)
    keyed = docs.withColumns({"_key": _key("doc_id"), "_digest": F.xxhash64("text")})
    return keyed.join(kept, ["_key", "_digest"], "left_semi").dropDuplicates(["_key", "_digest"]).drop("_key", "_digest")
