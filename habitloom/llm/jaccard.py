"""Documents linked by the Jaccard similarity of their word shingles, by a token-group matrix."""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from habitloom.llm.components import components
from habitloom.llm.setjoin import gathered, hashed_sets, keyed_texts, least_overlap, linked, parts_of, shingle_sets
from habitloom.session import discard, materialize

# Tokens whose counts order the tokens of a set, at most: what is sent to every executor.
FREQUENT = 1 << 18
# Tokens counted by one task of the corpus count, and tokens held before they are sent there.
COUNTED, SENT = 1 << 21, 1 << 20
# Sizes in one group differ by this factor at most.
SIZE_CLASS = 1.05


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, digest, n, name)`` per row of ``(doc_id, text)``, written once.

    ``name`` is a 128-bit digest of the row's shingle set, null for an empty
    one; ``digest`` tells rows of one ``doc_id`` apart.
    """
    def compute(batches):
        for batch in batches:
            found = [(len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None) for s in shingle_sets((t.as_py() for t in batch.column(2)), shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([n for n, _ in found], pa.int64()), pa.array([name for _, name in found], pa.binary())], names=["doc_id", "digest", "n", "name"])

    return materialize(keyed_texts(docs).mapInArrow(compute, "doc_id bigint, digest bigint, n bigint, name binary"), "jaccard-rows")


def frequent_tokens(docs: DataFrame, shingle: int, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent shingle hashes of all texts, in how many rows each is, and by how many bits the hashes are shortened.

    Counted over the whole corpus; ``total`` counts all incidences. Tasks count
    the tokens of some rows and send them to the part of the hash range that
    they lie in, as the 32 bits that follow those of the part: the larger the
    corpus, the more bits tell tokens apart. Each part gives its share of the
    most frequent ones, ``FREQUENT`` in all, whatever the corpus. They only
    order the tokens of a set: any order gives the same links.
    """
    part_bits = max(0, (total // COUNTED).bit_length())
    shift, share = 32 - part_bits, max(1, FREQUENT >> part_bits)

    def count(batches):
        def send():
            tokens, n = np.unique(np.concatenate(held) >> np.uint64(shift), return_counts=True)
            cuts = np.searchsorted(tokens, np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(32))
            rows = [(p, t.astype("<u4").tobytes(), c.astype("<u4").tobytes()) for p, (t, c) in enumerate(zip(np.split(tokens, cuts), np.split(n, cuts), strict=True)) if len(t)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "tokens", "counts"])

        held, size = [], 0
        for batch in batches:
            for found in shingle_sets((t.as_py() for t in batch.column(0)), shingle):
                held.append(found)
                size += len(held[-1])
                if size >= SENT:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    def most(table):
        tokens, counts = (np.concatenate([np.frombuffer(b.as_buffer(), "<u4") for b in table.column(name)]) for name in ("tokens", "counts"))
        tokens, at = np.unique(tokens, return_inverse=True)
        counts = np.bincount(at, counts).astype(np.int64)
        often = np.flatnonzero(counts > 1)
        if len(often) > share:
            often = often[np.argpartition(-counts[often], share - 1)[:share]]
        found = tokens[often].astype(np.int64) | table.column("part")[0].as_py() << 32
        return pa.table({"token": pa.array(found), "n": pa.array(counts[often])})

    counted = keyed_texts(docs).select("text").mapInArrow(count, "part int, tokens binary, counts binary").groupBy("part").applyInArrow(most, "token bigint, n bigint")
    found = counted.toArrow()  # FREQUENT rows at most
    tokens = found.column("token").to_numpy().astype(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found.column("n").to_numpy()[order], shift


def _prefixes(docs: DataFrame, shingle: int, percent: int, frequent) -> DataFrame:
    """``(sid, name, n, tokens)``: the first tokens of each distinct set, rare ones first, written once.

    Two sets of the wanted similarity share at least ``least_shared`` of these.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def compute(batches):
        tokens, counts, shift = shared.value

        def prefix(found):
            n = len(found)
            short = found >> np.uint64(shift)
            at = np.minimum(np.searchsorted(tokens, short), max(0, len(tokens) - 1))
            often = np.where(tokens[at] == short, counts[at], 0) if len(tokens) else np.zeros(n, np.int64)
            first = n - least_overlap(n, percent) + 1
            return xxhash.xxh3_128_digest(found.tobytes()), n, found[np.lexsort((found, often))[:first]].view(np.int64)

        for batch in batches:
            sets = shingle_sets((t.as_py() for t in batch.column(0)), shingle)
            rows = [prefix(s) for s in sets if len(s)]
            if rows:
                name, n, first = zip(*rows, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate(first)))
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(n, pa.int64()), lists], names=["name", "n", "tokens"])

    rows = keyed_texts(docs).select("text").mapInArrow(compute, "name binary, n bigint, tokens array<bigint>")
    return materialize(rows.dropDuplicates(["name"]).select(F.monotonically_increasing_id().alias("sid"), "*"), "jaccard-prefixes")


def least_shared(small, large, percent: int):
    """Tokens that the prefixes of two similar sets of these sizes, or of sizes between them, have in common, as a column.

    Sets of ``x`` and ``y >= x`` tokens overlap in ``o = percent / (100 + percent) * (x + y)``
    or more; prefixes that leave out all but ``k`` of what may differ share
    ``k``. It falls with ``y`` up to the greatest size that can be similar; one
    less allows for rounding.
    """
    large = F.least(large, F.floor(100 * small / percent))
    overlap = F.ceil(percent * (small + large) / (100 + percent))
    return F.greatest(overlap - F.ceil(percent * large / 100), F.lit(1))


def _partners(prefixes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups ``(sid, gid)`` of sets that may have a partner, and pairs ``(a, b)`` of groups that may hold partners.

    A set's group goes by its size and by the token of its prefix that most
    prefixes have, so similar sets meet in few groups. The matrix has a row per
    token and group. Groups whose sizes are near enough are paired if they have
    as many tokens in common as two similar sets must.
    """
    tokens = prefixes.select("sid", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = materialize(tokens.join(often, "token"), "jaccard-shared")
    homes = shared.groupBy("sid").agg(F.max(F.struct("often", "token"))["token"].alias("home")).join(prefixes.select("sid", "n"), "sid")
    homes = materialize(homes.withColumn("class", F.floor(F.log("n") / math.log(SIZE_CLASS))), "jaccard-homes")
    members = materialize(parts_of(homes, "home", "class").select("sid", "n", F.xxhash64("home", "class", "part").alias("gid")), "jaccard-members")
    sizes = materialize(members.groupBy("gid").agg(F.min("n").alias("least"), F.max("n").alias("most")), "jaccard-groups")
    matrix = shared.select("sid", "token").join(members.select("sid", "gid"), "sid").groupBy("token", "gid").agg(F.count(F.lit(1)).alias("sets"))
    matrix = materialize(matrix.join(sizes, "gid"), "jaccard-matrix")
    side = lambda x: matrix.select("token", F.col("gid").alias(x), F.col("least").alias(f"{x}_least"), F.col("most").alias(f"{x}_most"))
    low, high = F.least("a_least", "b_least"), F.greatest("a_most", "b_most")
    near = (100 * F.col("a_most") >= percent * F.col("b_least")) & (100 * F.col("b_most") >= percent * F.col("a_least"))
    across = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & near) \
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first(low).alias("low"), F.first(high).alias("high"))
    inside = matrix.where("sets > 1").groupBy(F.col("gid").alias("a"), F.col("gid").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.first("least").alias("low"), F.first("most").alias("high"))
    pairs = across.unionByName(inside).where(F.col("shared") >= least_shared(F.col("low"), F.col("high"), percent))
    pairs = materialize(pairs.select("a", "b"), "jaccard-pairs")
    discard(shared)
    discard(matrix)
    return members.select("sid", "gid"), pairs


def jaccard_classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``(doc_id, n, component)`` per row of ``(doc_id, text)``: the size of its shingle set and its class.

    Rows whose sets have a Jaccard similarity of ``percent`` hundredths or more
    are linked; ``component`` is the least ``doc_id`` reachable. Every link
    counts, also those between members of very large groups. Null texts and
    texts without words have no shingles and no links, and are their own
    component; repeated rows are in the same one; a null id takes the least id
    of its class. Shingles are told apart by 64-bit hashes.

    1. Equal sets are taken together, so exact copies cost a row each.
    2. Tokens are ordered by their number in the corpus; the first ones of each
       set, where similar sets must meet, make the token-group matrix.
    3. Groups that share enough there ask each other's token unions; those that
       may hold a partner are opened, and overlaps counted exactly.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1 to 100")
    rows = _sets(docs, shingle)
    total = rows.agg(F.sum("n")).first()[0] or 0
    prefixes = _prefixes(docs, shingle, percent, frequent_tokens(docs, shingle, total))
    members, pairs = _partners(prefixes, percent)
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct(), "jaccard-asked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")).alias("first")
    named = materialize(rows.where("name IS NOT NULL").groupBy("name").agg(first), "jaccard-names")
    wanted = members.join(asked, "gid").join(prefixes.select("sid", "name"), "sid").join(named, "name").select("first.doc_id", "first.digest", "sid", "gid")
    groups = gathered(hashed_sets(docs, materialize(wanted, "jaccard-wanted"), shingle))
    links = linked(groups, pairs, percent)
    discard(groups)
    roots = components(links).select(F.col("node").alias("sid"), "root")
    classes = materialize(prefixes.select("sid", "name").join(roots, "sid", "left").join(named, "name")
                          .select("name", F.coalesce("root", "sid").alias("root"), F.col("first.doc_id").alias("doc_id")), "jaccard-classes")
    least = materialize(classes.groupBy("root").agg(F.min("doc_id").alias("component")), "jaccard-least")
    found = materialize(classes.join(least, "root").select("name", "component"), "jaccard-found")
    return rows.join(found, "name", "left").select("doc_id", "n", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component"))
