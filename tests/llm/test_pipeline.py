"""The pipeline's stages on planted cases."""

import collections

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from habitloom.llm.queries import END_ID, tokenizer_path
from habitloom.llm.wordpieces import WordPieces
from habitloom.llm import mixing
from habitloom.llm.queries import MAX_REPETITION, MIX_SEED, n_words
from habitloom.session import materialize

SF_DIR = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    base = docs.collect()
    planted = [
        (5000, "123 456 ### --", "en", "src0", 14), (5001, None, "en", "src0", 0), (5002, base[3].text, "fr", "src1", 1),
        (5003, base[6].text + " end", "en", "src1", 1), (5004, 'the password = "swordfish99" is not for you and me', "en", "src2", 50),
    ]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    extra = ("score", "lang_pred", "epoch", "weight", "place", "fp", "spans")
    docs = materialize(docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id")) for name in extra}), "planted")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "secrets", "mixture", "sequences"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF_DIR), "stage"))
        if name != "sequences":
            assert kept[-1].columns == columns
    ids = [collections.Counter(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    # Only what has no letters goes for its language.
    assert set(ids[0]) - set(ids[1]) == {5000, 5001}
    assert not {5002, 5003} & set(ids[2]) and {base[3].doc_id, base[6].doc_id} <= set(ids[2]) and max(ids[2].values()) == 1
    assert ids[3] == ids[2]
    secret = {r.doc_id: r for r in kept[3].collect()}[5004]
    assert secret.text == 'the [secret]" is not for you and me' and secret.n_chars == len(secret.text)
    # Columns that are named like an operator's own keep what they hold.
    assert all(r[name] == f"{name}{r.doc_id}" for r in kept[4].collect() for name in extra)
    # The mixture drops nothing; what follows it takes every copy.
    assert set(ids[4]) == set(ids[3]) and 1 <= max(ids[4].values()) <= 3
    tokenizer = WordPieces(tokenizer_path())._tokenizer
    expected = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept[4].collect())
    pieces = kept[5].collect()
    assert sum(p.length for p in pieces) == expected
    per_sequence = collections.Counter()
    for p in pieces:
        per_sequence[p.sequence_id] += p.length
    full = [per_sequence[s] for s in range(len(per_sequence))]
    assert full[:-1] == [4096] * (len(full) - 1) and sum(np.frombuffer(bytes(p.ids), "<u4")[-1] == END_ID for p in pieces) >= sum(ids[4].values())


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF_DIR), "stage")
    key = lambda rows: sorted((r.doc_id, r.length, bytes(r.ids)) for r in rows)
    total = lambda rows: collections.Counter({r.doc_id: 0 for r in rows}) + collections.Counter(r.doc_id for r in rows if r.start == 0)
    assert total(corpus_pipeline.run(spark, SF_DIR).collect()) == total(docs.collect())
    assert key(docs.collect())


def test_sequences_follow_the_mixture(spark):
    """Places rise along the sequences, though files are read by size and in several tasks."""
    docs = materialize(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "docs")
    place = {}
    for r in mixing.mix(docs, n_words(), "repetition", MAX_REPETITION, None, MIX_SEED).collect():
        place.setdefault(r.doc_id, []).append(r.place)
    mixed = corpus_pipeline.mix_sources(spark, docs, SF_DIR)
    stored = materialize(mixed.repartitionByRange(7, F.rand(3)).sortWithinPartitions("doc_id"), "shuffled")
    assert stored.rdd.getNumPartitions() > 1
    for written, rises in ((materialize(mixed, "mixed"), True), (stored, False)):
        pieces = sorted(corpus_pipeline.pack_sequences(spark, written, SF_DIR).where("start = 0").collect(), key=lambda p: (p.sequence_id, p.offset))
        assert collections.Counter(p.doc_id for p in pieces) == {doc: len(at) for doc, at in place.items()}
        left = {doc: sorted(at, reverse=True) for doc, at in place.items()}
        along = [left[p.doc_id].pop() for p in pieces]
        assert (along == sorted(along)) == rises
