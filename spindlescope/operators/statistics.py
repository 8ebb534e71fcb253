"""Two-sample tests, feature ranking and divergence between models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlescope.functions.names import log_ratio, normalized_twin
from spindlescope.functions.pvalues import normal_pvalue, t_pvalue
from spindlescope.operators.ordering import long_form, running_totals, value_counts
from spindlescope.operators.reports import pearson, top_features
from spindlescope.session import cut_lineage, lookup_rows


def _class_moments(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Count, mean and sample variance of both classes per feature: one pass, one row per feature."""
    rows = long_form(df, [label], features)
    aggs = []
    for k in (0, 1):
        v = F.when(F.col(label) == k, F.col("value"))
        aggs += [F.count(v).alias(f"n{k}"), F.avg(v).alias(f"mean{k}"), F.var_samp(v).alias(f"var{k}")]
    return rows.groupBy("feature").agg(*aggs)


def pooled_t(n0, m0, v0, n1, m1, v1) -> tuple[Column, Column]:
    dof = n0 + n1 - 2
    pooled = F.try_divide((n0 - 1) * v0 + (n1 - 1) * v1, dof)
    return F.try_divide(m0 - m1, F.sqrt(pooled * (F.try_divide(F.lit(1), n0) + F.try_divide(F.lit(1), n1)))), dof.cast("double")


def welch_t(n0, m0, v0, n1, m1, v1) -> tuple[Column, Column]:
    a, b = F.try_divide(v0, n0), F.try_divide(v1, n1)
    dof = F.try_divide(F.pow(a + b, 2), F.try_divide(a * a, n0 - 1) + F.try_divide(b * b, n1 - 1))
    return F.try_divide(m0 - m1, F.sqrt(a + b)), dof


def _stats_columns(suffix0="0", suffix1="1"):
    return [F.col(f"{name}{s}") for s in (suffix0, suffix1) for name in ("n", "mean", "var")]


def t_test(df: DataFrame, features: list[str], label: str = "predict_val", equal_var: bool = True) -> DataFrame:
    """Two-sample t per feature with nulls left out: (feature, t, dof, p_value)."""
    t, dof = (pooled_t if equal_var else welch_t)(*_stats_columns())
    stats = _class_moments(df, features, label).select("feature", t.alias("t"), dof.alias("dof"))
    return stats.withColumn("p_value", t_pvalue("t", "dof"))


def welch_test(df: DataFrame, features: list[str], label: str = "predict_val") -> DataFrame:
    return t_test(df, features, label, equal_var=False)


def mann_whitney(df: DataFrame, features: list[str], label: str = "predict_val") -> DataFrame:
    """Two-sided Mann–Whitney U per feature: normal form with tie and continuity correction.

    Equal values are counted before ranking, so ties cost one row whatever their number; average
    ranks follow from running totals. ``u`` is the statistic of class 0.
    """
    is0 = (F.col(label) == 0, [label])
    is1 = (F.col(label) == 1, [label])
    classed = df.filter(F.col(label).isin(0, 1))
    counts = value_counts(classed, [], features, {"n0": is0, "n1": is1})
    ranked = running_totals(counts, ["feature"], "value", ["n"])
    mean_rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0
    ties = F.pow(F.col("n").cast("double"), 3) - F.col("n")
    sums = ranked.groupBy("feature").agg(
        F.sum("n0").cast("double").alias("n0"), F.sum("n1").cast("double").alias("n1"),
        F.sum(mean_rank * F.col("n0")).alias("r0"), F.sum(ties).alias("ties"))
    n0, n1 = F.col("n0"), F.col("n1")
    n = n0 + n1
    u = F.col("r0") - n0 * (n0 + 1) / 2.0
    sigma = F.sqrt(n0 * n1 / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    gap = F.greatest(u, n0 * n1 - u) - n0 * n1 / 2.0 - 0.5
    out = sums.select("feature", u.alias("u"), F.when(sigma > 0, gap / sigma).alias("z"))
    return out.withColumn("p_value", normal_pvalue("z"))


def raw_normalized_corr(df: DataFrame) -> DataFrame:
    """Pearson correlation of every raw attribute with its normalized twin."""
    raws = [c for c in df.columns if "raw" in c and normalized_twin(c) in df.columns]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), pearson(F.col(c), F.col(normalized_twin(c))).alias("r")) for c in raws])
    return df.agg(cells.alias("m")).select(F.inline("m"))


def rank_features(df: DataFrame, k: int = 18, test: str = "t-test", label: str = "predict_val") -> tuple[DataFrame, list[str]]:
    """The k raw columns that differ most between the classes, and the frame cut to them.

    Columns that are not SMART attributes are kept after the chosen ones.
    """
    raws = [c for c in df.columns if "raw" in c]
    tests = {"t-test": t_test, "mannwhitneyu": mann_whitney}
    if test not in tests:
        raise ValueError(f"unknown test: {test}")
    chosen = [r["feature"] for r in lookup_rows(top_features(tests[test](df, raws, label), k))]
    others = [c for c in df.columns if "smart" not in c]
    return df.select(*chosen, *others), chosen


def feature_weights(pvals: DataFrame) -> dict[str, float]:
    """Weights -log10(p) scaled to mean 1, from a test report."""
    rows = [(r["feature"], -math.log10(max(r["p_value"], 1e-300))) for r in lookup_rows(pvals) if r["p_value"] is not None]
    mean = sum(w for _, w in rows) / len(rows) if rows else 0.0
    return {f: (w / mean if mean else 1.0) for f, w in rows}


def kl_divergence(p: DataFrame, q: DataFrame, keys: list[str], features: list[str], eps: float = 1e-10) -> DataFrame:
    """Sum of p * ln(p / q) per feature over rows aligned on ``keys``, both sides shifted by ``eps``."""
    left = p.select(*keys, *[F.col(c).alias(f"p_{c}") for c in features])
    right = q.select(*keys, *[F.col(c).alias(f"q_{c}") for c in features])
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.sum(log_ratio(F.col(f"p_{c}"), F.col(f"q_{c}"), eps)).alias("kl")) for c in features
    ])
    return left.join(right, keys).agg(cells.alias("m")).select(F.inline("m"))


def model_pairs(per_model: DataFrame, on: list[str] = ("feature",)) -> DataFrame:
    """Every ordered pair of distinct models per feature, joined on the feature.

    Input is one summary row per model and feature, so the result is sized by the model
    catalogue and not by the drive-day table.
    """
    on = list(on)
    rest = [c for c in per_model.columns if c not in on]
    left = per_model.select(*on, *[F.col(c).alias(f"{c}_a") for c in rest])
    right = per_model.select(*on, *[F.col(c).alias(f"{c}_b") for c in rest])
    return left.join(right, on).filter("model_a <> model_b")


def model_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """Count, mean and sample variance per model and feature; nulls count as 0."""
    filled = df.select("model", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    return long_form(filled, ["model"], features).groupBy("model", "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def model_histograms(df: DataFrame, features: list[str], bins: int = 20) -> DataFrame:
    """Share of rows per shared-edge bin: one array of ``bins`` shares per model and feature."""
    edges = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in features for f in (F.min, F.max)]).first()
    filled = df.select("model", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    binned = []
    for c in features:
        low, high = min(edges[f"min_{c}"] or 0.0, 0.0), max(edges[f"max_{c}"] or 0.0, 0.0)
        width = (high - low) / bins or 1.0
        spot = F.greatest(F.lit(0), F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)))
        binned.append(F.struct(F.lit(c).alias("feature"), spot.cast("int").alias("bin")))
    rows = filled.select("model", F.inline(F.array(*binned)))
    counts = rows.groupBy("model", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    per_model = counts.groupBy("model", "feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("rows"))
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("m")[b], F.lit(0)) / F.col("rows"))
    return per_model.select("model", "feature", shares.alias("shares"))


def model_divergence(df: DataFrame, features: list[str], bins: int = 20, eps: float = 1e-10) -> DataFrame:
    """Per ordered model pair and feature: KL divergence on shared bins, Welch t, dof and p."""
    summary = model_histograms(df, features, bins).join(model_moments(df, features), ["model", "feature"])
    pairs = model_pairs(summary)
    terms = F.zip_with("shares_a", "shares_b", lambda p, q: (p + eps) * F.ln((p + eps) / (q + eps)))
    kl = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    t, dof = welch_t(*[F.col(c) for c in ("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b")])
    scored = pairs.select("model_a", "model_b", "feature", kl.alias("kl"), t.alias("t"), dof.alias("dof"))
    return scored.withColumn("p_value", t_pvalue("t", "dof"))


def partition_models_by_divergence(df: DataFrame, features: list[str], bins: int = 20) -> DataFrame:
    """Weighted mean divergence per model and whether it is relevant (at most the mean over models)."""
    weight = 1.0 / (F.col("p_value") + 1e-10)
    averages = model_divergence(df, features, bins).groupBy(F.col("model_a").alias("model")).agg(F.avg(F.col("kl") * weight).alias("w"))
    # a model without partners diverges from nothing
    per_model = cut_lineage(df.select("model").distinct().join(averages, "model", "left").select(
        "model", F.coalesce("w", F.lit(0.0)).alias("weighted_kl")))
    threshold = per_model.agg(F.avg("weighted_kl").alias("t")).first()["t"]
    return per_model.withColumn("relevant", F.col("weighted_kl") <= F.lit(threshold))
