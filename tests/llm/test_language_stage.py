"""The language stage on texts of no learned language, and on short clean ones."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
POLISH = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
RUSSIAN = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства"


@pytest.mark.parametrize("scale", ["sf0.01"])
def test_language_stage_rejects_what_no_language_explains(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(9)
    noise = lambda letters, words: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(words))
    bad = [noise("abcdefghijklmnopqrstuvwxyz", 300), noise("abcdefghijklmnopqrstuvwxyz", 30), noise("bcdfghjklmnpqrstvwxz", 3000),
           FINNISH * 20, POLISH * 20, RUSSIAN * 20, FINNISH, POLISH, RUSSIAN]
    # Beginnings of texts of the corpus, with words that languages share.
    clean = [" ".join(r.text.split()[:n]) for r in docs.where("length(text) > 400").orderBy("doc_id").limit(12).collect() for n in (1, 2, 3, 8)]
    planted = [(10 ** 6 + i, text, None, "src0", 1) for i, text in enumerate(bad)] + [(2 * 10 ** 6 + i, text, None, "src0", 1) for i, text in enumerate(clean + ["de la"])]
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(planted, docs.schema)), None)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not [text for i, text in enumerate(bad) if 10 ** 6 + i in ids]
    assert not [text for i, text in enumerate(clean + ["de la"]) if 2 * 10 ** 6 + i not in ids]
    lettered = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert not lettered - ids
