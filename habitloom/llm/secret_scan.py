"""Secrets in texts, and how widely each candidate is owned across the corpus."""

from pyspark.sql import Column, DataFrame, functions as F

from habitloom.llm.common import pick
from habitloom.session import materialize

# Base kinds in the order of the contract: pattern, group of the value, least length of the value.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A run of 24 or more is a maximal run of 24 or more: short runs need not be listed.
    ("hex", r"[0-9a-f]{24,}+", 0, 24),
)
# Looks like a random key: long, with a digit and letters in both cases.
LOOSE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[a-z0-9_-]*+[A-Z])(?=[A-Z0-9_-]*+[a-z])[A-Za-z0-9_-]{20,}+"
# Hits whose positions are summed one by one; longer lists are summed in two levels.
STRIDE = 128
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _earlier_sums(numbers: Column) -> Column:
    """For each place of an integer array, the sum of all places before it."""
    def both(a):
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / STRIDE).cast("int")), lambda b: total(F.slice(a, (b * STRIDE + 1).cast("int"), F.lit(STRIDE))))
        return F.transform(F.array(blocks), lambda s: F.transform(a, lambda _, i: total(F.slice(s, F.lit(1), (i / STRIDE).cast("int")))
                           + total(F.slice(a, ((i / STRIDE).cast("int") * STRIDE + 1).cast("int"), i % STRIDE))))[0]

    def total(part):
        return F.aggregate(part, F.lit(0), lambda x, y: x + y)

    return F.transform(F.array(numbers), lambda a: F.when(F.size(a) > 0, both(a)).otherwise(F.array().cast("array<int>")))[0]


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of ``pattern``, leftmost and not overlapping, whose value is long enough.

    The parts between the matches give the positions, in code points.
    """
    regex = F.lit(pattern)
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    values = F.regexp_extract_all(text, regex, F.lit(group)) if group else hits
    gaps = F.transform(F.split(text, pattern, -1), lambda part: F.length(part))

    def placed(hits, gaps):
        sizes = F.transform(hits, lambda h, i: F.length(h) + F.get(gaps, i))
        return F.transform(F.array(_earlier_sums(sizes)), lambda before: F.transform(hits, lambda h, i: F.struct(
            (F.get(before, i) + F.get(gaps, i)).alias("start"), (F.get(before, i) + F.get(gaps, i) + F.length(h)).alias("end"))))[0]

    def build(hits):
        at = F.transform(F.array(gaps), lambda g: placed(hits, g))[0]
        return F.zip_with(at, values, lambda p, v: F.struct(
            p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind"), v.alias("value")))

    found = F.transform(F.array(hits), lambda h: build(h))[0]
    # Texts without a match skip the rest.
    return F.when(F.regexp_like(text, regex), F.filter(found, lambda s: F.length(s["value"]) >= least)).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(text: Column) -> tuple[Column, Column]:
    """Base spans of a text, and loose ones that touch no base span; each sorted by start, then kind."""
    base = F.sort_array(F.flatten(F.array(*[_spans(text, i, *kind) for i, kind in enumerate(BASE)])))
    loose = _spans(text, len(BASE), "loose", LOOSE, 0, 20)
    return base, loose


def ownership(values: DataFrame) -> DataFrame:
    """``(value, owners, repositories)`` from ``(value, owner, repository)`` rows: how widely a value is held.

    Both are exact; null is one owner, but no repository. Rows are reduced to
    distinct pairs with an owner and with a repository, and these are counted
    per task, before anything meets per value: no task holds all of a value that
    is in a third of all documents.
    """
    def distinct(of):
        return values.select("value", of).distinct().groupBy("value").agg(
            F.count(F.lit(1) if of == "owner" else of).alias("n"), F.lit(of).alias("of"))

    number = lambda of: F.max(F.when(F.col("of") == of, F.col("n")))
    return distinct("owner").unionByName(distinct("repository")).groupBy("value").agg(
        number("owner").alias("owners"), number("repository").alias("repositories"))


def scan(docs: DataFrame, repository: str, owner: str, max_owners: int, max_repositories: int | None = None) -> DataFrame:
    """Secrets of every whole text of ``docs`` with their ownership across all of it.

    ``docs`` has ``doc_id, text`` and the columns that name a document's
    repository and its owner (both may be ``doc_id`` or ``source``; nulls are
    one owner). Candidates are the base spans and loose ones, which only look
    like a random key. The digest of a candidate's value is aggregated over
    the corpus: a value held by more than ``max_owners`` owners, or in more
    than ``max_repositories`` repositories where that is given, is a widely
    copied example; any other is owner-specific and looks live.
    Base spans are all kept, whatever their verdict; a loose span is added
    (kind ``owned``) only if owner-specific.

    Returns a row per input row: ``doc_id, spans`` (array of start, rank, end,
    kind, live, owners, repositories), start and end in code points, by start and
    then rank; the last two say how many hold the value. Null
    and empty texts have no spans. Documents with the same id and text share
    one verdict, so repeated rows are safe.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base, loose = candidates(text)
    # The inputs carry no name that could be taken for ``text`` or ``doc_id``.
    rows = F.col("doc_id"), F.sha2("text", 256).alias("digest")
    held = pick(docs, *dict.fromkeys(("doc_id", "text", repository, owner))).select(
        *rows, F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"),
        base.alias("base"), loose.alias("loose"))
    # Overlap is judged with the spans in hand, once per text that has any loose span.
    held = held.withColumn("loose", F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    held = materialize(held, "secret-candidates")

    values = held.select("doc_id", "digest", "repository", "owner", F.explode(F.array_distinct(
        F.transform(F.concat("base", "loose"), lambda s: F.sha2(s["value"], 256)))).alias("value"))
    held_by = ownership(values)
    few = F.col("owners") <= max_owners
    if max_repositories is not None:
        few &= F.col("repositories") <= max_repositories
    counted = materialize(held_by.withColumn("live", few), "secret-owners")
    # A list per text that has a candidate; it is no longer than the text's own spans.
    verdicts = values.select("doc_id", "digest", "value").join(counted, "value").distinct() \
        .groupBy("doc_id", "digest").agg(F.map_from_entries(F.collect_list(F.struct("value", F.struct("live", "owners", "repositories")))).alias("verdicts"))
    some = (F.size("base") > 0) | (F.size("loose") > 0)
    judged = held.where(some).alias("h").join(
        materialize(verdicts, "secret-verdicts").alias("v"),
        F.col("h.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("h.digest") == F.col("v.digest")), "left",
    ).select("h.doc_id", "h.digest", "base", "loose", "verdicts")

    def verdict(s, kind):
        found = F.col("verdicts")[F.sha2(s["value"], 256)]
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), kind.alias("kind"),
                        found["live"].alias("live"), found["owners"].alias("owners"), found["repositories"].alias("repositories"))

    every = F.concat(F.transform("base", lambda s: verdict(s, s["kind"])),
                     F.filter(F.transform("loose", lambda s: verdict(s, F.lit("owned"))), lambda s: s["live"]))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,live:boolean,owners:bigint,repositories:bigint>>")
    return judged.select("doc_id", "digest", F.sort_array(every).alias("spans")) \
        .unionByName(held.where(~some).select("doc_id", "digest", nothing.alias("spans")))


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """A text with each of its sorted spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc, s):
        # A span inside an earlier one only moves the end.
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def redact(docs: DataFrame, repository: str, owner: str, max_owners: int, mark: str = "[secret]", max_repositories: int | None = None) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mark``, and ``n_chars`` counted anew where it exists.

    All rows and columns are kept; texts without spans are unchanged. A row's
    base spans follow from its text alone. Only rows with a loose candidate,
    whose verdict depends on the corpus, are joined with the scan.
    """
    text = F.col("text")
    loose = F.coalesce(F.regexp_like(text, F.lit(LOOSE)), F.lit(False))
    ends = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    owned = scan(docs, repository, owner, max_owners, max_repositories).where(F.exists("spans", lambda s: s["kind"] == "owned")).select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), ends(F.col("spans")).alias("_found")).dropDuplicates(["_id", "_digest"])
    judged = docs.where(loose).join(
        materialize(owned, "secret-owned"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.sha2("text", 256) == F.col("_digest")), "left")

    def masked(rows, spans):
        rows = rows.withColumn("_spans", spans)
        hit = F.size("_spans") > 0
        rows = rows.withColumn("text", F.when(hit, _masked(text, F.col("_spans"), mark)).otherwise(text))
        if "n_chars" in docs.columns:
            rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
        return rows.select(*docs.columns)

    base = ends(candidates(text)[0])
    return masked(docs.where(~loose), base).unionByName(masked(judged, F.coalesce("_found", base)))


def digests(found: DataFrame) -> DataFrame:
    """Counts, base digest and span list per row of ``scan``, and how many owners and repositories hold its most widely held span."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE], F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"), count("owned").alias("n_owned"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"),
        *[F.coalesce(F.array_max(F.col("spans")[of]), F.lit(0)).cast("bigint").alias(f"most_{of}") for of in ("owners", "repositories")])
