"""The corpus operators as registered queries, with production parameters, and their SQL."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from habitloom.llm import align, jaccard, langid, mixing, pack, quality, rollup, secret_scan, shard, simhash, substring, vafile, whitening
from habitloom.llm.common import words
from habitloom.session import shared_folder

QUERIES, ORACLES = {}, {}
N_SHARDS = 24
WINDOW_WORDS = 13
SEQUENCE_LENGTH = 4096
END_ID = 2
NEIGHBOURS = 5
# A value that more sources than these hold is a copied example.
MAX_OWNERS = 3
# A value in more documents than these is a copied example, however few sources hold it.
MAX_REPOSITORIES = 30
MAX_REPETITION = 2
MIX_SEED = "mix"
COMPONENTS = 32


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def _limit(measure, floor):
    low, high = f"quantile_disc({measure}, 0.25)", f"quantile_disc({measure}, 0.75)"
    spread = f"3.0 * greatest({high} - {low}, {floor})"
    return f"CASE WHEN count(*) >= 20 THEN {high} + {spread} END AS {measure}_high, CASE WHEN count(*) >= 20 THEN {low} - {spread} END AS {measure}_low"


_LIMITS = ", ".join(_limit(*m) for m in quality.LEAST_SPREAD.items())


def _beyond(measure):
    high = f"coalesce({measure} > coalesce(o.{measure}_high, l.{measure}_high, e.{measure}_high), false)"
    low = f"coalesce({measure} < coalesce(o.{measure}_low, l.{measure}_low, e.{measure}_low), false)"
    return f"({high} OR {low})" if measure in quality.TWO_SIDED else high


# Groups of up to 4,096 documents have exact sketches.
@query(r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM d JOIN l USING (doc_id) LEFT JOIN repeats USING (doc_id)),
m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols / n_words END AS symbol_ratio, CASE WHEN n_words > 0 THEN n_repeat_words / n_words END AS repeat_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines END AS dup_line_ratio, CASE WHEN n_words > 0 THEN word_chars / n_words END AS mean_word_chars
  FROM counted),
o AS (SELECT lang, source, """ + _LIMITS + """ FROM m WHERE NOT base_failed GROUP BY lang, source),
l2 AS (SELECT lang, """ + _LIMITS + """ FROM m WHERE NOT base_failed GROUP BY lang),
e AS (SELECT """ + _LIMITS + """ FROM m WHERE NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (""" + " OR ".join(_beyond(m) for m in quality.LEAST_SPREAD) + """) AS kept
FROM m LEFT JOIN o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source
  LEFT JOIN l2 l ON m.lang IS NOT DISTINCT FROM l.lang, e
""")
def op2_sketched_thresholds(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
found AS (
  SELECT *, string_split_regex(t, re) AS gaps, regexp_extract_all(t, re, 0) AS hits, regexp_extract_all(t, re, grp) AS vals
  FROM d, (VALUES
    (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24), (3, 'owned', '[A-Za-z0-9_-]+', 0, 20)
  ) k(rank, kind, re, grp, least)),
spots AS (
  SELECT doc_id, source, rank, kind, least, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, source, rank, kind, vals[i] AS value,
    CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS a,
    a + length(hits[i]) AS b
  FROM spots WHERE length(vals[i]) >= least AND (rank < 3
    OR regexp_matches(vals[i], '[0-9]') AND regexp_matches(vals[i], '[A-Z]') AND regexp_matches(vals[i], '[a-z]'))),
candidates AS (
  SELECT * FROM spans s WHERE rank < 3 OR NOT EXISTS (
    SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND o.rank < 3 AND o.a < s.b AND s.a < o.b)),
held AS (SELECT value, count(DISTINCT coalesce(source, '(none)')) AS owners, count(DISTINCT doc_id) AS repositories FROM candidates GROUP BY value),
judged AS (SELECT *, owners <= 3 AND repositories <= 30 AS is_live FROM candidates JOIN held USING (value)),
kept AS (SELECT *, kind || ':' || a || ':' || b AS span FROM judged WHERE rank < 3 OR is_live)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY a, rank), '') AS spans,
  count(*) FILTER (kind = 'owned') AS n_owned, count(*) FILTER (is_live) AS n_live,
  coalesce(max(owners), 0) AS most_owners, coalesce(max(repositories), 0) AS most_repositories
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
""")
def op3_ownership_frequency(spark, sf_dir):
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents"), "doc_id", "source", MAX_OWNERS, MAX_REPOSITORIES))


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY t) < doc_id),
removed AS (SELECT DISTINCT doc_id, i + k AS i FROM repeated, range(13) r(k)),
places AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM places ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op1_recompression(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents"), WINDOW_WORDS).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op4_concatenate_and_cut(spark, sf_dir):
    pieces = pack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, SEQUENCE_LENGTH)
    return pack.with_checksums(pieces)


@query("""
WITH RECURSIVE crc AS (
  SELECT n, 0 AS step, n AS c FROM range(256) t(n)
  UNION ALL SELECT n, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE step < 8),
lookup AS (SELECT list(c ORDER BY n) AS l FROM crc WHERE step = 8),
sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda c, b: xor(l[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) END AS text_crc32
  FROM documents, lookup),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start,
    sum(size) OVER () AS total FROM sized),
placed AS (SELECT *, CAST((2 * start + size) * 24 // (2 * total) AS INTEGER) AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
""")
def op5_byte_balanced_shards(spark, sf_dir):
    return shard.balanced_shards(table(spark, sf_dir, "documents"), N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op6_tiled_simhash(spark, sf_dir):
    found = simhash.classes(table(spark, sf_dir, "documents"), radius=4, shingle=4, seed=42)
    return found.select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component.doc_id").alias("component_id"))


@query()
def op7_delta_rollups(spark, sf_dir):
    """Load all documents, revise every count by its end id, retire later copies; the revision is committed twice."""
    counts = rollup.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), "word_bpe_49k")
    store = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    with_end = counts.withColumn("n_tokens", F.col("n_tokens") + 1)
    rollup.commit(store, "load", rollup.inserted(counts))
    rollup.commit(store, "revise", rollup.revised(counts, with_end))
    rollup.commit(store, "retire", rollup.deleted(rollup.later_copies(with_end)))
    rollup.commit(store, "revise", rollup.revised(counts, with_end))
    return rollup.totals(spark, store)


def fitted_languages(docs):
    return langid.fit(docs.where(~langid.held_out(F.col("doc_id"))), langid.vocabulary(tokenizer_path("piece_bpe_32k.model")))


@query()
def op8_marginal_unigrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs.select("doc_id", "text"), fitted_languages(docs)).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op9_vector_approximation_files(spark, sf_dir):
    vectors = vafile.scaled_vectors(table(spark, sf_dir, "embeddings"))
    return vafile.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), NEIGHBOURS)


def n_words(text="text"):
    return F.size(words(F.col(text))).cast("bigint")


@query(r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
sums AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM r GROUP BY source),
shares AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM sums),
spread AS (SELECT min(share) / max(share) AS ratio FROM shares WHERE share > 0),
bisection AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT step + 1, CASE WHEN pow(ratio, (low + high) / 2 - 1) <= 2 THEN low ELSE (low + high) / 2 END,
    CASE WHEN pow(ratio, (low + high) / 2 - 1) <= 2 THEN (low + high) / 2 ELSE high END
  FROM bisection, spread WHERE step < 60),
raised AS (
  SELECT source, tokens, CASE WHEN share > 0 THEN pow(share, high) ELSE 0 END AS raised FROM shares, bisection WHERE step = 60),
weights AS (SELECT *, raised / sum(raised) OVER () AS weight FROM raised),
quotas AS (
  SELECT source, tokens, weight, CASE WHEN weight > 0 THEN greatest(round(weight * max(tokens / weight) FILTER (weight > 0) OVER (), 3), tokens) ELSE tokens END AS quota
  FROM weights),
epochs AS (
  SELECT *, CAST(CASE WHEN tokens > 0 THEN floor(quota / tokens) ELSE 1 END AS INTEGER) AS epochs,
    round(quota - CASE WHEN tokens > 0 THEN floor(quota / tokens) ELSE 1 END * tokens, 3) AS rest FROM quotas),
keyed AS (
  SELECT r.doc_id, r.source, n, epochs, rest, weight, md5('mix:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM r JOIN epochs e ON r.source IS NOT DISTINCT FROM e.source),
cut AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) < rest AS extra
  FROM keyed),
begun AS (SELECT *, epochs + CAST(max(CAST(extra AS INTEGER)) OVER (PARTITION BY source) AS INTEGER) AS begun FROM cut),
taken AS (SELECT *, CAST(unnest(range(epochs + CAST(extra AS INTEGER))) AS INTEGER) AS epoch FROM begun)
SELECT doc_id, source, epoch,
  (epoch + CAST('0x' || md5('mix:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:12] AS BIGINT) / CAST(281474976710656 AS DOUBLE)) / begun AS place,
  round(weight, 9) AS weight
FROM taken
""")
def op10_temperature_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), n_words(), "repetition", MAX_REPETITION, None, MIX_SEED)
    return mixed.select("doc_id", "source", "epoch", "place", F.round("weight", 9).alias("weight"))


@query()
def op11_bit_sliced_scatter(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), COMPONENTS)


@query()
def op12_fragment_monoid(spark, sf_dir):
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query()
def op13_token_group_matrix(spark, sf_dir):
    found = jaccard.jaccard_classes(table(spark, sf_dir, "documents"), shingle=5, percent=80)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
