"""Classes of similar texts against all pairs, in groups of one and of many parts."""

import collections
import itertools
import random

import numpy as np
import pytest

from habitloom.llm import jaccard, setjoin
from habitloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def brute(rows):
    """``(doc_id, n, component)``: links over all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    holders, shared, parent = collections.defaultdict(list), collections.Counter(), list(range(len(rows)))
    for i, shingles in enumerate(sets):
        for s in shingles:
            holders[s].append(i)
    for held in holders.values():
        shared.update(itertools.combinations(held, 2))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)].append(doc)
    return sorted(((doc, len(sets[i]), min(least[root(i)], default=None) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def found(frame):
    return sorted(((r.doc_id, r.n, r.component) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("tokens", [1 << 19, 3000])
def test_classes_equal_all_pairs(spark, monkeypatch, tokens):
    monkeypatch.setattr(setjoin, "GROUP_TOKENS", tokens)
    monkeypatch.setattr(setjoin, "ROWS", 16)
    monkeypatch.setattr(setjoin, "DENSE", 64)
    monkeypatch.setattr(jaccard, "COUNTED", 20_000)
    rng = random.Random(2)
    fresh = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    passage, template, texts = fresh(60), fresh(150), []
    for _ in range(60):  # unrelated but for a passage
        texts.append(fresh(rng.randint(5, 100)) + passage + fresh(50))
    for edits in [4] * 60 + [2] * 60 + [1] * 40 + [0] * 30:  # one template, far and near
        page = list(template)
        for at in rng.sample(range(150), edits):
            page[at] = fresh(1)[0]
        texts.append(page)
    for size in (1, 3, 4, 5, 6, 9, 30, 45, 54, 400):  # around the limit, and copies of two
        base = fresh(size)
        texts += [base, list(base), base + fresh(1), base[:-1], base + fresh(max(1, size // 5))]
    texts += [template[:k] for k in range(100, 150, 3)]
    rows = [*enumerate(" ".join(t) for t in texts), (9000, ""), (9001, None), (None, " ".join(template)), (None, None), (9002, " \t "), (5, "a b c"), (5, "a b c"), (9003, "A  B\nC")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS n", "'y' AS token", "1 AS sid")
    assert found(jaccard.jaccard_classes(docs.repartition(3), 5, 80)) == brute(rows)


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op13_token_group_matrix"](spark, SF_DIR).collect())
    assert sorted(got, key=repr) == brute(rows)


@pytest.mark.parametrize("dense", [0, 30, 10 ** 9])
def test_overlaps_are_counted_exactly(monkeypatch, dense):
    monkeypatch.setattr(setjoin, "DENSE", dense)
    monkeypatch.setattr(setjoin, "ROWS", 7)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 12, rng.integers(0, 20)).astype(np.uint64)) for _ in range(60)]
    a, b = setjoin.Group.of(range(30), sets[:30]), setjoin.Group.of(range(30, 60), sets[30:])
    for left, right, same in ((a, a, True), (a, b, False)):
        both = sets[:30] if same else sets
        links = [(i, j) for i in range(30) for j in (range(30) if same else range(30, 60))
                 if i != j and len(both[i]) and 100 * len(np.intersect1d(both[i], both[j])) >= 80 * len(np.union1d(both[i], both[j]))]
        expected = setjoin.thin(np.array([x for x, _ in links]), np.array([y for _, y in links]), len(both))
        got = setjoin.similar(left, right, same, 80)
        assert [x.tolist() for x in got] == [x.tolist() for x in expected]
    bound = a.overlaps(b.union)
    assert bound.tolist() == [len(np.intersect1d(s, b.union)) for s in sets[:30]]


@pytest.mark.parametrize("piece", [1 << 20, 37, 8])
def test_shingles_are_told_apart(monkeypatch, piece):
    monkeypatch.setattr(setjoin, "PIECE", piece)
    setjoin._powers.cache_clear()
    rng = random.Random(6)
    texts = [None, b"", b" ", b"a", b"A b", b"a\tB\n", b"x" * 300, b"x" * 301, b"a b c d e", b"a b c d e f", b" a b c d  e\r\n", "été ÉTÉ λ 中文 x y z".encode()]
    texts += [" ".join(rng.choice(["ab", "ba", "abc", "a", "ABC", "zzzzzzzzzzzz"]) for _ in range(rng.randint(1, 60))).encode() for _ in range(200)]
    names = {}
    for text, hashes in zip(texts, setjoin.shingle_sets(texts, 5), strict=True):
        words = (text or b"").translate(setjoin._LOWER).split()
        shingles = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(hashes) == len(shingles) and (np.diff(hashes.astype(object)) > 0).all()
        assert hashes.tolist() == setjoin.shingle_set(text, 5).tolist()
        names.setdefault(frozenset(shingles), set()).add(tuple(hashes.tolist()))
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)
    setjoin._powers.cache_clear()


def moved_rows(plan):
    """Rows that the shuffles of an executed plan wrote."""
    name = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    if inner is not None:
        return moved_rows(inner)
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(moved_rows(children.apply(i)) for i in range(children.size()))


def test_only_wanted_texts_are_moved(spark, tmp_path):
    texts = [(i if i % 7 else None, f"word{i} " * 9 + str(i % 5)) for i in range(3000)]
    docs = spark.createDataFrame([*texts, *texts[:40]], "doc_id bigint, text string")
    keyed = setjoin.keyed_texts(docs).select("doc_id", "digest").distinct().where("digest % 50 = 0")
    keyed.selectExpr("doc_id", "digest", "digest AS sid", "pmod(digest, 4) AS gid").write.parquet(f"{tmp_path}/wanted")
    wanted = spark.read.parquet(f"{tmp_path}/wanted")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = setjoin.hashed_sets(docs, wanted, 5)
        found = sets.collect()
        moved = moved_rows(sets._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expected = {row.sid: row.gid for row in wanted.collect()}
    assert 20 < len(expected) < 200 and {row.sid: row.gid for row in found} == expected and len(found) == len(expected)
    assert moved < 1000
