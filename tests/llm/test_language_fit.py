"""Language models and limits of evidence learn from every labelled row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitloom.llm import langid
from habitloom.llm.queries import fitted_languages

SCHEMA = "doc_id bigint, text string, lang string"


def test_words_of_the_last_row_are_learned(spark):
    ids = spark.range(9000).withColumnRenamed("id", "doc_id").where(~langid.held_out(F.col("doc_id")))
    # Rows that a share of some 4,000 by this digest would leave out are the only ones with the second word.
    late = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) >= F.lit(float(1 << 20)) * 4000 / ids.count()
    docs = ids.select("doc_id", F.when(late, "water").otherwise("house").alias("text"), F.lit("xx").alias("lang"))
    other = spark.createDataFrame([(100_000 + i, "water " + "house " * 9, "yy") for i in range(400)], SCHEMA)
    model = fitted_languages(docs.unionByName(other))
    share = docs.where("text = 'water'").count() / docs.count()
    assert share > 0.2
    found = langid.predict(spark.createDataFrame([(1, "water", None)], SCHEMA), model).head()
    # One word in five against one in ten: where no row is left out, the first language is likelier.
    assert found.lang_pred == "xx"


def test_limits_are_taken_over_all_rows(spark):
    model = fitted_languages(spark.createDataFrame([(i, "house water " * (1 + i % 3), "xx") for i in range(100)], SCHEMA))
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('water house ', int(1 + id % 50))").alias("text"), F.lit("xx").alias("lang"))
    every = langid.predict(rows, model, ("p", "s"), langid.EVIDENCE).collect()
    limits = langid.limits(rows, model)
    assert set(limits) == {None, "xx"} and limits["xx"] == pytest.approx(limits[None])
    mean = sum(r.log for r in every) / sum(r.letters for r in every)
    rates, excesses = sorted(r.log / r.letters for r in every), sorted((r.log - mean * r.letters) / math.sqrt(r.words) for r in every)

    def at(values, share):
        place = (len(values) - 1) * share
        low = int(place)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low)

    middle = at(rates, 0.5)
    assert limits["xx"] == pytest.approx((mean, min(2 * at(rates, 0.01) - middle, langid.SLACK * middle), 7 * at(excesses, 0.25) - 6 * at(excesses, 0.5)), abs=1e-9)


def test_languages_without_letters_and_corpora_without_labels(spark):
    assert langid.fit(spark.createDataFrame([(1, "12 34", "xx"), (2, "word", "yy"), (3, None, "zz")], SCHEMA), ("▁word",)).languages == ("xx", "yy")
    assert langid.limits(spark.createDataFrame([], SCHEMA), fitted_languages(spark.createDataFrame([], SCHEMA))) == {}


def test_limits_do_not_depend_on_the_order_in_which_means_are_summed(spark, monkeypatch):
    model = langid.Model(("a", "b", "c"), ("xx",), np.array([[0.31], [0.47], [0.22], [1e-7]]))
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, " ".join(rng.choices(["a", "ab", "bbc", "cab"], k=rng.randint(1, 60))), "xx") for i in range(2000)], SCHEMA)
    rows, percentiles, name = rows.repartition(4), langid.exact_percentiles, "spark.sql.files.minPartitionNum"

    def in_other_tasks(of, value, *args):
        # Where the mean is summed anew, it is summed in another order.
        spark.conf.set(name, "1" if value == "excess" else "4")
        try:
            return percentiles(of, value, *args)
        finally:
            spark.conf.unset(name)

    expected = langid.limits(rows, model)
    monkeypatch.setattr(langid, "exact_percentiles", in_other_tasks)
    assert langid.limits(rows, model) == {k: pytest.approx(v) for k, v in expected.items()}


def test_steps_of_a_lattice_are_found_for_all_starts_at_once(monkeypatch):
    pieces, follow, calls = ("▁", "a", "ab", "abab", "ba", "中", "\U00010428a"), langid._Pieces.follow, []
    monkeypatch.setattr(langid._Pieces, "follow", lambda self, *args: calls.append(1) or follow(self, *args))
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choices("abx中\U00010428\U0010fffd", k=rng.randint(0, 90))) for _ in range(300)] + ["", "▁"]
    for known in (pieces, ()):
        lattice = langid._Lattice(words, langid._Pieces(known))
        place = {p: i for i, p in enumerate(known)}
        expected = [(w, i, j, place[text[i:j]]) for w, text in enumerate(words) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in place]
        expected += [(w, i, i + 1, len(known)) for w, text in enumerate(words) for i in range(len(text)) if text[i] not in place]
        assert sorted(zip(lattice.word, lattice.start, lattice.end, lattice.piece)) == sorted(expected)
    assert len(calls) <= 2 * langid.PIECE
