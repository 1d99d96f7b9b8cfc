"""Edge tables and influence matrices.

These tables are bounded by the square of the vocabulary. They carry one row
per directed pair ``source -> target``.
"""

from pyspark.sql import DataFrame, Window, functions as F

from habitloom.functions.columns import (
    canonical_device_key, device_name, edge_strength, endpoint_key, first_present,
)
from habitloom.session import materialize

FUSION_MODES = ("multiplicative", "additive")
GUARD_MODES = ("suppress", "downweight")
ENDPOINT_POLICIES = ("target", "source_or_target", "both")


def with_endpoints(edges: DataFrame) -> DataFrame:
    """Add canonical ``source_device_key`` and ``target_device_key``."""
    keys = {f"{role}_device_key": endpoint_key(role, edges.columns) for role in ("source", "target")}
    return edges.withColumns(keys)


def standardize_edges(edges: DataFrame, channels: DataFrame, lag: int) -> DataFrame:
    """Fill names from indices and indices from names; default weight and lag.

    ``channels`` is ``(channel, channel_index)``.
    """
    columns = edges.columns
    out = edges
    for role in ("source", "target"):
        name = F.coalesce(F.nullif(first_present([role], columns), F.lit("")), first_present([f"{role}_key"], columns))
        index = first_present([f"{role}_id", f"{role}_index"], columns).cast("int")
        by_index = channels.select(F.col("channel_index").alias(f"_{role}_i"), F.col("channel").alias(f"_{role}_name"))
        by_name = channels.select(F.col("channel").alias(f"_{role}_c"), F.col("channel_index").alias(f"_{role}_index"))
        out = (
            out.withColumns({f"_{role}_given": F.nullif(name, F.lit("")), f"_{role}_at": index})
            .join(by_index, F.col(f"_{role}_at") == F.col(f"_{role}_i"), "left")
            .withColumn(f"_{role}", F.coalesce(
                F.col(f"_{role}_given"), F.col(f"_{role}_name"),
                F.concat(F.lit("c:"), F.col(f"_{role}_at").cast("string")), F.lit(""),
            ))
            .join(by_name, F.col(f"_{role}") == F.col(f"_{role}_c"), "left")
        )
    weight = F.coalesce(first_present(["weight", "raw_weight"], columns).cast("double"), F.lit(0.0))
    return out.select(
        F.col("_source").alias("source"), F.col("_target").alias("target"),
        F.coalesce("_source_at", "_source_index").alias("source_index"),
        F.coalesce("_target_at", "_target_index").alias("target_index"),
        weight.alias("weight"),
        F.coalesce(first_present(["lag"], columns).cast("int"), F.lit(lag)).alias("lag"),
    )


def with_names(edges: DataFrame, names: DataFrame = None) -> DataFrame:
    """Add ``source_name`` and ``target_name`` from a ``(device, name)`` table keyed ``d:<id>``."""
    if names is None:
        return edges.withColumns({f"{r}_name": device_name(r) for r in ("source", "target")})
    for role in ("source", "target"):
        labels = names.select(F.col("device").alias(role), F.col("name").alias("_label"))
        edges = edges.join(labels, role, "left").withColumn(f"{role}_name", device_name(role, "_label")).drop("_label")
    return edges


def top_edges(matrix: DataFrame, k=None, min_weight=None, include_self=False, weight="weight") -> DataFrame:
    """The ``k`` heaviest positive edges, ties by ``(source, target)``; all of them if ``k`` is None or 0."""
    kept = matrix.where(F.col(weight) > 0)
    if not include_self:
        kept = kept.where(F.col("source") != F.col("target"))
    if min_weight is not None:
        kept = kept.where(F.col(weight) >= min_weight)
    kept = kept.orderBy(F.desc(weight), "source", "target")
    return kept.limit(k) if k and k > 0 else kept


def edge_statistics(edges: DataFrame, threshold=0.0, strength=None) -> DataFrame:
    """One row of counts and distribution figures over edge strengths."""
    strength = edge_strength(edges.columns) if strength is None else F.col(strength)
    values = edges.select(strength.alias("w"))
    live = F.when(F.abs("w") > threshold, F.col("w"))

    def zero(column):
        return F.coalesce(column.cast("double"), F.lit(0.0))

    cuts = F.percentile(live, F.array(F.lit(0.5), F.lit(0.9)))
    return values.agg(
        F.count(F.lit(1)).alias("num_edges"),
        F.count(live).alias("num_nonzero_edges"),
        zero(F.try_divide(F.count(live), F.count(F.lit(1)))).alias("nonzero_ratio"),
        zero(F.sum(live)).alias("sum_strength"),
        zero(F.avg(live)).alias("mean_strength"),
        zero(F.stddev_pop(live)).alias("std_strength"),
        zero(F.min(live)).alias("min_strength"),
        zero(F.get(cuts, F.lit(0))).alias("median_strength"),
        zero(F.get(cuts, F.lit(1))).alias("p90_strength"),
        zero(F.max(live)).alias("max_strength"),
        F.lit(float(threshold)).alias("threshold"),
    )


def edge_statistics_delta(before: DataFrame, after: DataFrame, threshold=0.0) -> DataFrame:
    """Statistics of both tables, rows ``before`` and ``after``, plus the four changes as row ``delta``."""
    changed = ("num_nonzero_edges", "sum_strength", "mean_strength", "max_strength")
    both = (
        edge_statistics(before, threshold).withColumn("side", F.lit("before"))
        .unionByName(edge_statistics(after, threshold).withColumn("side", F.lit("after")))
    )
    measures = [c for c in both.columns if c != "side"]

    def change(column):
        sign = F.when(F.col("side") == "after", 1.0).otherwise(-1.0)
        return F.sum(F.col(column).cast("double") * sign)

    delta = both.agg(*[(change(c) if c in changed else F.max(F.lit(None).cast("double"))).alias(c) for c in measures])
    return both.select("side", *[F.col(c).cast("double").alias(c) for c in measures]).unionByName(
        delta.select(F.lit("delta").alias("side"), *measures)
    )


def sparsify(matrix: DataFrame, threshold=0.0) -> DataFrame:
    """Keep the stronger direction of each pair.

    Off the diagonal ``max(m - transpose, 0)``, on it ``m``; then divide by the
    maximum, and only then drop what is below ``threshold``. The transpose is
    added as negated rows and summed, so no self join is needed.
    """
    on_diagonal = F.col("source") == F.col("target")
    signed = matrix.select("source", "target", "weight").unionByName(
        matrix.where(~on_diagonal).select(
            F.col("target").alias("source"), F.col("source").alias("target"), (-F.col("weight")).alias("weight"),
        )
    )
    kept = (
        signed.groupBy("source", "target").agg(F.sum("weight").alias("weight"))
        .where((F.col("weight") > 0) | (on_diagonal & (F.col("weight") != 0)))
    )
    top = F.max("weight").over(Window.partitionBy(F.lit(0)))
    scaled = kept.withColumn("weight", F.when(top > 0, F.col("weight") / top).otherwise(F.col("weight")))
    return scaled.where(F.col("weight") >= threshold) if threshold > 0 else scaled


def normalized_distribution(distribution: DataFrame) -> DataFrame:
    """``(device, p)`` with canonical keys, clipped at 0 and scaled to sum 1."""
    clipped = distribution.select(
        canonical_device_key("device").alias("device"), F.greatest(F.col("p").cast("double"), F.lit(0.0)).alias("p"),
    )
    total = F.sum("p").over(Window.partitionBy(F.lit(0)))
    return clipped.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(F.col("p")))


def _look_up(edges, distribution, role, name):
    found = distribution.select(F.col("device").alias(f"{role}_device_key"), F.col("p").alias("_p"))
    return (
        edges.join(found, f"{role}_device_key", "left")
        .withColumn(name, F.coalesce("_p", F.lit(0.0))).drop("_p")
    )


def target_weighted(edges: DataFrame, target: DataFrame) -> DataFrame:
    """Scale each edge by the target probability of both its ends."""
    target = materialize(normalized_distribution(target), "distribution")
    rows = with_endpoints(edges).withColumn("raw_weight", edge_strength(edges.columns))
    rows = _look_up(rows, target, "source", "source_target_probability")
    rows = _look_up(rows, target, "target", "target_target_probability")
    support = F.col("source_target_probability") * F.col("target_target_probability")
    adapted = F.col("raw_weight") * F.col("source_target_probability") * F.col("target_target_probability")
    return rows.withColumns({
        "target_endpoint_weight": support, "target_adapted_weight": adapted, "weight": adapted,
    })


def target_weighted_matrix(matrix: DataFrame, target: DataFrame) -> DataFrame:
    """The same on every cell of a sparse ``(source, target, weight)`` matrix."""
    return target_weighted(matrix, target).select("source", "target", "weight")


def overuse_guard(
    edges: DataFrame, observed: DataFrame, target: DataFrame, *, max_overuse_ratio=1.25,
    min_target_freq=0.001, eps=1e-8, mode="suppress", downweight_factor=0.25, endpoint_policy="target",
) -> DataFrame:
    """Suppress or weaken edges whose ends are used more than the target allows."""
    if mode not in GUARD_MODES:
        raise ValueError(f"mode must be one of {GUARD_MODES}")
    if endpoint_policy not in ENDPOINT_POLICIES:
        raise ValueError(f"endpoint_policy must be one of {ENDPOINT_POLICIES}")
    if max_overuse_ratio <= 0:
        raise ValueError("max_overuse_ratio must be positive")
    if not 0 <= downweight_factor <= 1:
        raise ValueError("downweight_factor must be between 0 and 1")

    observed = materialize(normalized_distribution(observed), "distribution")
    target = materialize(normalized_distribution(target), "distribution")
    rows = with_endpoints(edges).withColumn("raw_weight", edge_strength(edges.columns))
    for role in ("source", "target"):
        rows = _look_up(rows, observed, role, f"{role}_observed_freq")
        rows = _look_up(rows, target, role, f"{role}_target_freq")
        allowed = F.greatest(F.col(f"{role}_target_freq"), F.lit(min_target_freq), F.lit(eps))
        rows = rows.withColumn(f"{role}_overuse_ratio", F.col(f"{role}_observed_freq") / allowed)
        rows = rows.withColumn(f"{role}_overused", F.col(f"{role}_overuse_ratio") > max_overuse_ratio)

    source, hit = F.col("source_overused"), F.col("target_overused")
    guarded = {"target": hit, "source_or_target": source | hit, "both": source & hit}[endpoint_policy]

    def explain(role):
        text = F.format_string(
            "%s overused: observed_freq=%.6f, target_freq=%.6f, ratio=%.3f",
            *[F.col(f"{role}_{part}") for part in ("device_key", "observed_freq", "target_freq", "overuse_ratio")],
        )
        return F.when(F.col(f"{role}_overused"), text)

    roles = ("target",) if endpoint_policy == "target" else ("source", "target")
    left = F.lit(0.0) if mode == "suppress" else F.col("raw_weight") * downweight_factor
    return (
        rows.withColumn("guarded_weight", F.when(guarded, left).otherwise(F.col("raw_weight")))
        .withColumns({
            "weight": F.col("guarded_weight"),
            "guard_action": F.when(guarded, F.lit(mode)).otherwise(F.lit("keep")),
            "guard_reason": F.when(guarded, F.concat_ws("; ", *[explain(r) for r in roles])).otherwise(F.lit("")),
        })
    )


def overused_devices(guarded: DataFrame) -> DataFrame:
    """Distinct over-used endpoints of a guarded edge table, worst first."""
    ends = [
        guarded.where(F.col(f"{role}_overused")).select(
            F.col(f"{role}_device_key").alias("device"), F.col(f"{role}_observed_freq").alias("observed_freq"),
            F.col(f"{role}_target_freq").alias("target_freq"), F.col(f"{role}_overuse_ratio").alias("ratio"),
        )
        for role in ("source", "target")
    ]
    return (
        ends[0].unionByName(ends[1]).dropDuplicates(["device"])
        .withColumn("device_name", device_name("device")).orderBy(F.desc("ratio"), "device")
    )


def guard_counts(guarded: DataFrame) -> DataFrame:
    return guarded.agg(
        F.count(F.lit(1)).alias("num_edges"),
        F.count_if(F.col("guard_action") == "suppress").alias("num_suppressed_edges"),
        F.count_if(F.col("guard_action") == "downweight").alias("num_downweighted_edges"),
    )


def _strongest_per_pair(causal):
    columns = causal.columns
    keys = {f"_{role}": endpoint_key(role, columns) for role in ("source", "target")}
    weight = F.coalesce(first_present(["weight", "raw_weight"], columns).cast("double"), F.lit(0.0))
    raw = F.coalesce(first_present(["raw_weight", "raw_causal_strength", "weight"], columns).cast("double"), F.lit(0.0))
    lag = first_present(["lag"], columns).cast("int")
    return (
        causal.withColumns(keys).where((F.col("_source") != "unknown") & (F.col("_target") != "unknown"))
        .groupBy(F.col("_source").alias("source"), F.col("_target").alias("target"))
        .agg(F.max(F.struct(weight.alias("causal_strength"), raw.alias("raw_causal_strength"), lag.alias("lag"))).alias("_best"))
        .select("source", "target", "_best.*")
    )


def fuse_edges(
    transitions: DataFrame, causal: DataFrame, *, lambda_causal=1.0, mode="multiplicative",
    add_causal_edges=False, top_k=None,
) -> DataFrame:
    """Score transition edges together with influence edges.

    Both sides are divided by their maximum. Additive: ``t + lambda * c``.
    Multiplicative: ``t * (1 + lambda * c)``, and ``lambda * c`` for an
    influence edge without a transition. All edges come back unless ``top_k``
    is given.
    """
    if mode not in FUSION_MODES:
        raise ValueError(f"mode must be one of {FUSION_MODES}")
    best = _strongest_per_pair(causal)
    steps = transitions.select(
        F.col("source_device_key").alias("source"), F.col("target_device_key").alias("target"),
        F.col("count").alias("_count"), F.col("transition_score").alias("_score"),
    )
    everything = Window.partitionBy(F.lit(0))
    best = best.withColumn("_max_causal", F.max("causal_strength").over(everything))
    steps = steps.withColumn("_max_score", F.max("_score").over(everything))
    rows = steps.join(best, ["source", "target"], "full_outer" if add_causal_edges else "left")

    def scaled(value, top):
        return F.when(F.col(top) > 0, F.col(value) / F.col(top)).otherwise(F.lit(0.0))

    known = F.col("_score").isNotNull()
    t, c = F.col("normalized_transition_score"), F.col("normalized_causal_strength")
    if mode == "additive":
        final = t + lambda_causal * c
    else:
        final = F.when(known, t * (1.0 + lambda_causal * c)).otherwise(lambda_causal * c)
    fused = (
        rows.withColumns({
            "normalized_transition_score": scaled("_score", "_max_score"),
            "normalized_causal_strength": scaled("causal_strength", "_max_causal"),
        })
        .select(
            F.col("source").alias("source_device_key"), F.col("target").alias("target_device_key"),
            device_name("source").alias("source_name"), device_name("target").alias("target_name"),
            F.coalesce("_count", F.lit(0)).alias("count"),
            F.coalesce("_score", F.lit(0.0)).alias("transition_score"),
            "normalized_transition_score",
            F.coalesce("raw_causal_strength", F.lit(0.0)).alias("raw_causal_strength"),
            F.coalesce("causal_strength", F.lit(0.0)).alias("causal_strength"),
            "normalized_causal_strength",
            final.alias("final_score"),
            F.when(known, "transition_existing").otherwise("causal_relation_augmented").alias("edge_origin"),
            "lag",
        )
        .orderBy(F.desc("final_score"), "source_device_key", "target_device_key")
    )
    return fused.limit(top_k) if top_k and top_k > 0 else fused


def fusion_summary(fused: DataFrame, transitions: DataFrame, causal: DataFrame) -> DataFrame:
    one = F.count(F.lit(1))
    return fused.agg(
        one.alias("output_edges"),
        F.count_if(F.col("edge_origin") == "causal_relation_augmented").alias("num_causal_relation_augmented_edges"),
        F.coalesce(F.avg("causal_strength"), F.lit(0.0)).alias("avg_causal_strength"),
    ).select(
        transitions.agg(one).scalar().alias("input_transition_edges"),
        causal.agg(one).scalar().alias("input_causal_edges"),
        "output_edges", "num_causal_relation_augmented_edges", "avg_causal_strength",
    )
