"""The near-copy stage against brute-force similarity, with repeated passages and around the limit."""

import random

import numpy as np
import pytest

import corpus_pipeline
from habitloom.llm import setjoin, simhash


def brute_kept(rows):
    """Least id of each component over pairs with a share of 0.8 of their distinct 5-word shingles."""
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(least.values())


@pytest.mark.parametrize("tokens", [1 << 19, 2000])
def test_near_copies_equal_brute_force(spark, monkeypatch, tokens):
    monkeypatch.setattr(setjoin, "GROUP_TOKENS", tokens)
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    texts, phrase = [], fresh(6)
    for times in (0, 20, 40, 60):
        # Unrelated, with one passage in common; and a copy that only the passage tells apart.
        base = fresh(300)
        texts += [base + phrase * times, fresh(300) + phrase * times, base + phrase * 10]
    for _ in range(12):
        # Edits that leave a similarity of 0.7 to 0.9.
        base = fresh(300)
        for edits in (4, 5, 6, 7, 8, 9, 10):
            copy = list(base)
            for at in rng.sample(range(5, 295), edits):
                copy[at] = fresh(1)[0]
            texts.append(copy)
        texts.append(base)
    # A group whose members are like the first only.
    base = fresh(300)
    texts.append(base)
    for k in range(40):
        texts.append(base[:10 + 7 * k] + fresh(1) + base[11 + 7 * k:290] + fresh(20))
    rows = list(enumerate(" ".join(t) for t in texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, None)
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_template_pages_below_the_limit_stay(spark):
    """Pages of one template, too different to be copies, in one group with true copies."""
    rng = random.Random(7)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for edits, count in ((6, 300), (1, 60)):
        for _ in range(count):
            page = list(base)
            for at in rng.sample(range(300), edits):
                page[at] = f"u{rng.randrange(10 ** 9)}"
            rows.append((len(rows), " ".join(page)))
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), None)
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_tiles_whose_sets_differ_too_much_in_size_do_not_meet(spark, monkeypatch):
    """The limit lies between sizes, and some pairs are just as far apart as it allows."""
    monkeypatch.setattr(simhash, "TILE", 20)
    monkeypatch.setattr(simhash, "RUN", 4)
    monkeypatch.setattr(simhash, "LARGEST_TILE", 20)
    written, materialize = {}, simhash.materialize

    def counted(df, label):
        table = materialize(df, label)
        written[label] = table.count()
        return table

    monkeypatch.setattr(simhash, "materialize", counted)
    rng = random.Random(9)
    fresh = lambda n: [f"s{rng.randrange(10 ** 6)}" for _ in range(n)]
    texts = [[], ["one"], ["One"]]
    for size in [round(6 * 1.04 ** k) for k in range(110)]:
        base = fresh(size + 4)
        # A text of all these shingles, of four fifths of them, of one less, and an unrelated one.
        texts += [base, base[:-(-4 * size // 5) + 4], base[:-(-4 * size // 5) + 3]][:1 + rng.randrange(3)] + [fresh(size + 4)]
    rng.shuffle(texts)
    rows = list(enumerate(" ".join(t) for t in texts))
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), None)
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)
    tiles = -(-written["simhash-fingerprints"] // 20)
    assert tiles > 12 and written["simhash-pairs"] <= 3 * tiles


@pytest.mark.parametrize("columns", [16, 4096])
def test_sized_tiles_link_all_that_sizes_allow(monkeypatch, columns):
    monkeypatch.setattr(simhash, "ROWS", 8)
    monkeypatch.setattr(simhash, "COLUMNS", columns)
    rng = np.random.default_rng(3)
    fps = np.repeat(rng.integers(0, 1 << 63, (30, 4), dtype=np.uint64), 12, axis=0)
    for row in range(len(fps)):
        fps[row, rng.integers(2)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    # The third word names a fingerprint, the fourth is a size.
    fps[:, 3] = rng.integers(0, 60, len(fps))
    fps = fps[np.lexsort((fps[:, 2], fps[:, 3]))]
    a, b = fps[:150], fps[150:]
    size = fps[:, 3].astype(int)
    bits = np.bitwise_count(fps[:, None, :2] ^ fps[None, :, :2])
    near = (bits.sum(axis=2) <= 2) & (bits[..., 0] <= 1) & (100 * np.minimum.outer(size, size) >= 80 * np.maximum.outer(size, size))

    def label(links, n):
        found = np.arange(n)
        for _ in range(n):
            for x, y in links:
                found[x] = found[y] = min(found[x], found[y])
        return found.tolist()

    for left, right, same, wanted in (
        (a, a, True, [(i, j) for i, j in np.argwhere(near[:150, :150])]), (a, b, False, [(i, j + 150) for i, j in np.argwhere(near[:150, 150:])]),
    ):
        n = len(left) if same else len(fps)
        assert label(zip(*simhash.tile_links(left, right, same, 2, 1, 2, 80)), n) == label(wanted, n)


def test_tiles_go_by_the_number_of_fingerprints_not_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 100)
    monkeypatch.setattr(simhash, "RUN", 16)
    monkeypatch.setattr(simhash, "LARGEST_TILE", 200)
    rng = random.Random(6)
    roots = [rng.getrandbits(64) for _ in range(150)]
    values = sorted({root ^ sum(1 << rng.randrange(64) for _ in range(k)) % (1 << 64) for root in roots for k in range(4)})
    fps = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fp binary")
    frame = type(fps)
    by_range = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *by: by_range(self, max(n, 40), *by))
    tiles = simhash._tiles(fps, 1).collect()
    assert len(tiles) == -(-len(values) // 100)
    assert sorted(b"".join(t.fps for t in tiles)[8 * i:8 * i + 8] for i in range(len(values))) == sorted(v.to_bytes(8, "big") for v in values)
    ones = [[int.from_bytes(t.fps[i:i + 8], "big").bit_count() for i in range(0, len(t.fps), 8)] for t in sorted(tiles)]
    assert sum(ones, []) == sorted(sum(ones, []))

    def root(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x

    def classes(links):
        parent = {v: v for v in values}
        for a, b in links:
            a, b = sorted((root(parent, a), root(parent, b)))
            parent[b] = a
        return [root(parent, v) for v in values]

    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    found = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in simhash.links(fps, 4, 1, 4).collect()]
    assert classes(found) == classes(near)
