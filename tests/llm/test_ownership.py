"""Exact counts of owners and repositories, and verdicts that use both."""

import random

import corpus_pipeline
from habitloom.llm import secret_scan
from habitloom.llm.queries import QUERIES

EXAMPLE, OWN = "Zx9" + "kQ7bT2mN4vR8wL1pD6hJ3", "Bq4" + "tY8nC1fG5sK9xM2zV7aW0"


def test_counts_are_exact(spark):
    rows = [("v", f"o{i % 3}", f"r{i}") for i in range(5003)] + [("v", "o0", "r0")] * 50 + [("v", "o9", "r0"), ("w", None, None), ("w", None, None)]
    random.Random(1).shuffle(rows)
    found = secret_scan.ownership(spark.createDataFrame(rows, "value string, owner string, repository string")).collect()
    assert {r.value: (r.owners, r.repositories) for r in found} == {"v": (4, 5003), "w": (1, 0)}


def test_example_in_many_documents_of_one_source_is_no_secret(spark):
    rows = [(i, f"use {EXAMPLE} here {i}", "en", "s0", 1) for i in range(200)] + [(1000, f"my {OWN} key", "en", "s0", 1), (1001, f"my {OWN} key too", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spans = {r.doc_id: r.spans for r in secret_scan.scan(docs, "doc_id", "source", 3, 30).collect()}
    assert not any(spans[i] for i in range(200))
    assert [(s.kind, s.live, s.owners, s.repositories) for i in (1000, 1001) for s in spans[i]] == [("owned", True, 2, 2)] * 2
    clean = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, docs, None).collect()}
    assert all(EXAMPLE in clean[i] for i in range(200)) and not any(OWN in clean[i] for i in (1000, 1001))


def test_query_counts_an_example_of_one_source_as_copied(spark, tmp_path):
    rows = [(i, f"use {EXAMPLE} here {i}", "en", "s0", 1) for i in range(500)] + [(1000, f"my {OWN} key", "en", "s0", 1), (1001, "password = swordfish99", "en", "s1", 1), (1002, None, "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op3_ownership_frequency"](spark, str(tmp_path)).collect()}
    assert all((found[i].n_owned, found[i].n_live, found[i].most_owners) == (0, 0, 0) for i in range(500))
    assert (found[1000].n_owned, found[1000].n_live, found[1000].most_owners, found[1000].most_repositories) == (1, 1, 1, 1)
    assert (found[1001].n_assign, found[1001].n_live, found[1001].most_repositories) == (1, 1, 1) and found[1002].spans == ""
