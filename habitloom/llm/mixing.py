"""Temperature mixing of sources to a target entropy or repetition limit."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitloom.llm.common import pick
from habitloom.session import materialize

# Halvings of the exponent's interval; more than a double can tell apart.
STEPS = 60
# Keys are cut by their first four hexadecimal digits, then exactly inside one of those buckets.
BUCKET_DIGITS = 4


def temperature_weights(shares: DataFrame, target: str, limit: float) -> DataFrame:
    """``(source, tokens)`` with weights ``share ** exponent``, normalised, and the exponent.

    The exponent lies in 0 (all sources alike) to 1 (as they are). ``target``
    ``"repetition"`` bisects for the least exponent at which no source is
    repeated more than ``limit`` times as often as the least repeated one;
    ``"entropy"`` for the greatest at which the weights have ``limit`` nats or
    more (0 if none has). Sources without tokens get weight 0. One row per
    source goes in and out; the bisection itself runs over one list of shares.
    """
    if target not in ("repetition", "entropy"):
        raise ValueError("target must be 'repetition' or 'entropy'")
    if limit < (1 if target == "repetition" else 0):
        raise ValueError("limit is too small")
    total = F.sum("tokens").over(Window.partitionBy())
    shares = shares.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
    zero = F.lit(0.0)

    def powers(p: Column, a: Column) -> Column:
        return F.transform(p, lambda x: F.pow(x, a))

    def fits(p, a):
        if target == "repetition":
            # Repetition is weight over share: share ** (a - 1), up to a factor.
            return F.pow(F.array_min(p) / F.array_max(p), a - 1) <= limit
        w = powers(p, a)
        return F.transform(F.array(F.aggregate(w, zero, lambda x, y: x + y)), lambda t: F.aggregate(
            w, zero, lambda x, y: x - y / t * F.ln(y / t)))[0] >= limit

    def halve(p):
        start = F.struct(zero.alias("low"), F.lit(1.0).alias("high"))

        def step(s, _):
            middle = (s["low"] + s["high"]) / 2
            upper = F.when(fits(p, middle), middle)
            if target == "repetition":
                return F.struct(F.when(upper.isNull(), middle).otherwise(s["low"]).alias("low"), F.coalesce(upper, s["high"]).alias("high"))
            return F.struct(F.coalesce(upper, s["low"]).alias("low"), F.when(upper.isNull(), middle).otherwise(s["high"]).alias("high"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["high" if target == "repetition" else "low"])

    positive = shares.where(F.col("share") > 0).agg(F.sort_array(F.collect_list("share")).alias("p"))
    exponent = positive.select(F.when(F.size("p") > 0, halve(F.col("p"))).otherwise(F.lit(1.0)).alias("exponent"))
    raised = shares.crossJoin(F.broadcast(exponent)).withColumn(  # one row
        "raised", F.when(F.col("share") > 0, F.pow("share", "exponent")).otherwise(zero))
    norm = F.sum("raised").over(Window.partitionBy())
    return raised.select("source", "tokens", "share", "exponent", F.when(norm > 0, F.col("raised") / norm).otherwise(zero).alias("weight"))


def permutation_key(seed: str, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in the permutation of one epoch: a hexadecimal digest."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def plan(docs: DataFrame, tokens: Column, target: str, limit: float, budget: int | None, seed: str) -> DataFrame:
    """One row per source: weight, whole epochs, and the key up to which one more epoch goes.

    ``budget`` is in tokens; ``None`` takes the least at which every document
    comes at least once. A source's quota is its weight of the budget: so many
    whole epochs, and of the next epoch's permutation the documents before
    which less than the remaining quota has gone. That cut is found per source
    from token sums by key prefix, then by key inside the crossing prefix
    only, so no source is put in order as a whole.
    """
    rows = pick(docs, "doc_id", "text", "source").select("doc_id", "source", tokens.cast("bigint").alias("n"))
    rows = materialize(rows, "mix-rows")
    sums = materialize(rows.groupBy("source").agg(F.sum("n").alias("tokens")), "mix-sources")
    weights = temperature_weights(sums, target, limit)
    if budget is None:
        amount = F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))).over(Window.partitionBy())
    else:
        amount = F.lit(float(budget))
    # Rounded so that sums in another order give the same whole numbers.
    quota = F.round(F.coalesce(amount * F.col("weight"), F.lit(0.0)), 3)
    if budget is None:
        quotas = weights.withColumn("quota", F.when(F.col("weight") > 0, F.greatest(quota, F.col("tokens"))).otherwise(F.col("tokens").cast("double")))
    else:
        quotas = weights.withColumn("quota", quota)
    repeats = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1 if budget is None else 0))
    quotas = quotas.withColumn("epochs", repeats.cast("int")).withColumn("rest", F.round(F.col("quota") - F.col("epochs") * F.col("tokens"), 3))
    quotas = materialize(quotas, "mix-quotas")

    same = lambda other: F.col("r.source").eqNullSafe(F.col(f"{other}.source"))
    keyed = rows.alias("r").join(quotas.where(F.col("rest") > 0).alias("q"), same("q")).select(
        "r.source", "n", "rest", permutation_key(seed, F.col("epochs"), F.col("doc_id")).alias("key")) \
        .withColumn("prefix", F.substring("key", 1, BUCKET_DIGITS))
    # 16 ** BUCKET_DIGITS rows per source at most.
    buckets = keyed.groupBy("source", "prefix").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossing = materialize(buckets.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("n")))
                           .select("source", "prefix", "before"), "mix-crossing")
    keys = keyed.alias("r").join(crossing.alias("c"), same("c") & (F.col("r.prefix") == F.col("c.prefix"))) \
        .groupBy("r.source", "before", "rest", "key").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cuts = keys.withColumn("gone", F.col("before") + F.coalesce(F.sum("n").over(ordered), F.lit(0))) \
        .where(F.col("gone") < F.col("rest")).groupBy("source").agg(F.max("key").alias("last_key"))
    return materialize(quotas.alias("r").join(cuts.alias("c"), same("c"), "left").select(
        "r.source", "tokens", "exponent", "weight", "epochs", F.coalesce("last_key", F.lit("")).alias("last_key")), "mix-plan")


def mix(docs: DataFrame, tokens: Column, target: str, limit: float, budget: int | None, seed: str, names=("epoch", "place", "weight")) -> DataFrame:
    """``docs`` with ``epoch``, ``place`` and ``weight``: a row per time a document is taken.

    ``names`` are the names of these three; columns of ``docs`` that have them are replaced.

    ``place`` in 0 to 1 spreads each source's epochs evenly over the mixture:
    its whole and begun epochs follow each other, each a permutation of its
    own. Ordering by it, or dealing ranges of it, gives the mixed stream.
    ``tokens`` is computed from ``text``; null texts have none if it says so.
    A null source is a source. Repeated rows are taken alike.
    """
    chosen = plan(docs, tokens, target, limit, budget, seed)
    inner = docs.toDF(*[f"_d{i}" for i in range(len(docs.columns))])
    name = {c: f"_d{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    joined = inner.join(chosen.alias("p"), F.col(name["source"]).eqNullSafe(F.col("p.source")))
    extra = permutation_key(seed, F.col("epochs"), F.col(name["doc_id"])) <= F.col("last_key")
    times = F.col("epochs") + extra.cast("int")
    taken = joined.where(times > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    part = F.conv(F.substring(permutation_key(seed, F.col("_epoch"), F.col(name["doc_id"])), 1, 12), 16, 10).cast("double") / float(16 ** 12)
    begun = F.col("epochs") + (F.col("last_key") != "").cast("int")
    return taken.select(
        *[F.col(f"_d{i}").alias(c) for i, c in enumerate(docs.columns) if c not in names],
        *[x.alias(name) for x, name in zip((F.col("_epoch"), (F.col("_epoch") + part) / begun, F.col("weight")), names, strict=True)])
