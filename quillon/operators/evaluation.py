"""Evaluation of retrieval: match metrics of cases, aggregates, comparison with a baseline, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import path_words


def p95(column: str) -> Column:
    """Nearest rank: the value at place ceil(.95 n). Groups of up to 100,000 values are exact; of larger ones a bounded summary is
    kept instead of all their values, which is off by at most n / 100,000 ranks."""
    return F.percentile_approx(column, 0.95, 100_000)


def match_metrics(cases: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Of each case (case_id, expected array) and its candidates (case_id, rank, path, module) up to rank ``k``: recall_hit,
    precision, noise, hit_at_1, reciprocal_rank. A candidate is relevant if it shares a token with an expected key. Cases
    without candidates have precision 0."""
    wanted = cases.select("case_id", F.array_distinct(F.flatten(F.transform("expected", path_words))).alias("_e"))
    tokens = path_words(F.concat_ws(" ", "path", "module"))
    rows = wanted.join(candidates.where(F.col("rank") <= k).select("case_id", "rank", tokens.alias("_t")), "case_id", "left")
    hit = F.coalesce(F.arrays_overlap("_t", "_e"), F.lit(False))
    g = rows.groupBy("case_id").agg(F.count("rank").alias("n"), F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    precision = F.col("hits") / F.greatest(F.lit(1), F.when(F.col("n") > 0, F.least(F.lit(k), F.col("n"))).otherwise(F.lit(k)))
    return g.select(
        "case_id",
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("recall_hit"),
        F.round(precision, 6).alias("precision"),
        F.round(F.greatest(F.lit(0.0), F.lit(1.0) - precision), 6).alias("noise"),
        F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("hit_at_1"),
        F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def aggregate(rows: DataFrame, means: list[str] = (), medians: list[str] = (), p95s: list[str] = (), by: list[str] = ()) -> DataFrame:
    """Means, medians and nearest-rank 95th percentiles of columns, and the number of cases."""
    aggs = [F.count("*").alias("cases")]
    aggs += [F.round(F.avg(c), 6).alias(f"{c}_mean") for c in means] + [F.round(F.median(c), 6).alias(f"{c}_median") for c in medians] + [p95(c).alias(f"{c}_p95") for c in p95s]
    return rows.groupBy(*by).agg(*aggs)


def stage_latency(rows: DataFrame, stage: str, ms: str) -> DataFrame:
    """stage, n, mean, p95."""
    return rows.groupBy(stage).agg(F.count("*").alias("n"), F.round(F.avg(ms), 4).alias("mean"), p95(ms).alias("p95"))


def unpivot(row: DataFrame) -> DataFrame:
    """One row of metrics as metric, value."""
    names = [c for c, t in row.dtypes if t in ("double", "bigint", "int", "float")]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")
    return row.select(pairs).select("x.*")


def compare(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, current, baseline, delta; a missing side counts as 0."""
    both = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "full").fillna(0.0)
    return both.withColumn("delta", F.round(F.col("current") - F.col("baseline"), 6))


# What each profile tolerates before a change counts as a regression.
PROFILES = {"default": (0.0, 0.0, 1.2), "strict": (0.0, 0.0, 1.1), "relaxed": (0.05, 0.05, 1.35)}


def regressions(comparison: DataFrame, profile: str = "default", higher: list[str] = (), lower: list[str] = (), growth: list[str] = ()) -> DataFrame:
    """metric, check of each metric that got worse: ``higher`` ones fell by more than the tolerance, ``lower`` ones rose by
    more, ``growth`` ones grew beyond the factor (only from a baseline above 0). Comparisons are strict."""
    fall, rise, factor = PROFILES[profile]
    check = (
        F.when(F.col("metric").isin(list(higher)) & (F.col("delta") < -fall), "fell")
        .when(F.col("metric").isin(list(lower)) & (F.col("delta") > rise), "rose")
        .when(F.col("metric").isin(list(growth)) & (F.col("baseline") > 0) & (F.col("current") > F.col("baseline") * factor), "grew")
    )
    return comparison.withColumn("check", check).where(F.col("check").isNotNull()).select("metric", "current", "baseline", "check")


def lanes(rows: DataFrame, lane: str, means: list[str]) -> DataFrame:
    """Means by non-empty lane."""
    return aggregate(rows.where(F.coalesce(F.trim(lane), F.lit("")) != ""), means, by=[lane])


def arm_pairs(rows: DataFrame, executed: str, shadow: str, ms: str) -> DataFrame:
    """By pair of arms, both given: cases, mean and p95 latency, whether they differ."""
    both = rows.where((F.coalesce(executed, F.lit("")) != "") & (F.coalesce(shadow, F.lit("")) != ""))
    g = both.groupBy(executed, shadow).agg(F.count("*").alias("cases"), F.round(F.avg(ms), 4).alias("mean"), p95(ms).alias("p95"))
    return g.withColumn("differs", F.col(executed) != F.col(shadow))


def risk(recall: Column, chunk_hit: Column, noise: Column, insufficient: Column, exhausted: Column) -> tuple[Column, Column]:
    """Risk of missing context from 0 to 1, and its level: high from .75, elevated from .40."""
    score = (
        F.when(recall <= 0, 0.35).otherwise(0.0)
        + F.when((recall > 0) & (chunk_hit <= 0), 0.25).otherwise(0.0)
        + F.when(noise > 0, F.least(F.lit(0.2), noise * 0.2)).otherwise(0.0)
        + F.when(insufficient > 0, 0.25).otherwise(0.0)
        + F.when(exhausted > 0, 0.15).otherwise(0.0)
    )
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)
    return score, F.when(score >= 0.75, "high").when(score >= 0.40, "elevated").otherwise("low")


def rates(rows: DataFrame, flags: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Count and share of rows for which each flag holds."""
    n = F.greatest(F.count("*"), F.lit(1))
    out = [F.count("*").alias("cases")]
    for name, flag in flags.items():
        out += [F.count_if(flag).alias(f"{name}_count"), F.round(F.count_if(flag) / n, 6).alias(f"{name}_rate")]
    return rows.groupBy(*by).agg(*out)


def dominant(rows: DataFrame, column: str) -> DataFrame:
    """value, n, rate and whether it is the most frequent (ties: the smallest value)."""
    g = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.orderBy(F.desc("n"), "value"))
    return g.withColumns({"rate": F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6), "dominant": place == 1})


def gate(metrics: DataFrame, bounds: dict[str, tuple[str, float]]) -> DataFrame:
    """metric, value, bound, passed of each bounded metric ((">=" or "<=", limit)); a missing metric fails."""
    spec = metrics.sparkSession.createDataFrame([(m, op, float(x)) for m, (op, x) in bounds.items()], "metric string, op string, bound double")
    joined = spec.join(metrics.select("metric", "value"), "metric", "left")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return joined.select("metric", "value", "bound", F.coalesce(ok, F.lit(False)).alias("passed"))


# The gates of the retrieval frontier and the control plane.
FRONTIER = {"deep_symbol_case_recall": (">=", 0.9), "native_scip_loaded_rate": (">=", 0.7), "precision_at_k": (">=", 0.64), "noise_rate": ("<=", 0.36)}
CONTROL_PLANE = {"adaptive_router_shadow_coverage": (">=", 0.8), "risk_upgrade_precision_gain": (">=", 0.0)}


def routing_metrics(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """Hit rate, mean reciprocal rank and mean latency of routed cases: cases (case_id, expected array, ms) against ranked
    (case_id, rank, repo)."""
    first = cases.join(ranked, "case_id", "left").groupBy("case_id").agg(F.min(F.when(F.array_contains("expected", F.col("repo")), F.col("rank"))).alias("first"), F.max("ms").alias("ms"))
    return first.agg(F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_at_k"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("ms"), 4).alias("latency"))


def tuning(metrics: dict[str, float]) -> dict[str, object]:
    """Settings to try, by rules over aggregate metrics."""
    out: dict[str, object] = {}
    if metrics.get("recall_hit_mean", 1.0) < 0.9:
        out["top_k_files"] = "+2"
    if metrics.get("noise_mean", 0.0) > 0.36:
        out["candidate_relative_threshold"] = 0.25
    if metrics.get("precision_mean", 1.0) < 0.64:
        out["candidate_ranker"] = "rrf_hybrid"
    return out


def router_arms(rows: DataFrame, arm: str, trace: str | None = None) -> DataFrame:
    """By non-empty arm: cases, mean success and reciprocal rank, p95 latency, and cases with a fallback or downgrade event in
    the trace (an array of structs with ``action``)."""
    some = rows.where(F.coalesce(F.trim(arm), F.lit("")) != "")
    aggs = [F.count("*").alias("cases"), F.round(F.avg("success"), 6).alias("success"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), p95("latency_ms").alias("p95")]
    if trace:
        has = lambda a: F.coalesce(F.exists(trace, lambda e: e["action"] == a), F.lit(False))
        aggs += [F.count_if(has("fallback")).alias("fallback_cases"), F.count_if(has("downgrade")).alias("downgrade_cases")]
    return some.groupBy(arm).agg(*aggs)


def insufficiency(rows: DataFrame) -> DataFrame:
    """Of the failed cases that aren't negative controls: how many lack evidence, by reason ('' for all of them)."""
    applicable = rows.where((F.coalesce(F.lower(F.trim("mode")), F.lit("positive")) != "negative_control") & (F.coalesce("success", F.lit(0.0)) <= 0))
    lacking = F.coalesce("insufficient", F.lit(0.0)) > 0
    total = applicable.agg(F.count("*").alias("applicable"), F.count_if(lacking).alias("n")).select(F.lit("").alias("reason"), "applicable", "n")
    by = applicable.where(lacking & (F.coalesce(F.trim("reason"), F.lit("")) != "")).groupBy("reason").agg(F.count("*").alias("applicable"), F.count("*").alias("n"))
    return total.unionByName(by).withColumn("rate", F.round(F.col("n") / F.greatest(F.lit(1), F.col("applicable")), 6))


def trace_events(rows: DataFrame, trace: str) -> DataFrame:
    """Decision events by action, target and reason: action, target, reason, n."""
    e = rows.select(F.explode(trace).alias("e")).select("e.*")
    return e.groupBy(*[F.coalesce(c, F.lit("(unknown)")).alias(c) for c in ("action", "target", "reason")]).agg(F.count("*").alias("n"))


def aggregate_all(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """All numeric columns by their names: times (``_ms``) get mean, median and p95, ids nothing, the rest a mean; booleans a
    rate. The catalogue of aggregate metrics follows from the columns a case row has."""
    aggs = [F.count("*").alias("cases")]
    for c, t in rows.dtypes:
        if c in by or c.endswith("_id"):
            continue
        if t == "boolean":
            aggs.append(F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate"))
        elif t in ("double", "float", "int", "bigint"):
            aggs.append(F.round(F.avg(c), 6).alias(f"{c}_mean"))
            if c.endswith("_ms"):
                aggs += [F.round(F.median(c), 6).alias(f"{c}_median"), p95(c).alias(f"{c}_p95")]
    return rows.groupBy(*by).agg(*aggs)


def micro_gate(current: dict[str, float], baseline: dict[str, float], speedup: float = 1.0, memory_growth: float = 1.1) -> dict[str, bool]:
    """Checks of a micro-benchmark: time and memory against a baseline."""
    out = {}
    if baseline.get("avg_ms", 0) > 0:
        out["time"] = baseline["avg_ms"] / max(current["avg_ms"], 1e-9) >= speedup
    if baseline.get("memory_mb", 0) > 0:
        out["memory"] = current["memory_mb"] <= baseline["memory_mb"] * memory_growth
    return out


def conditional(rows: DataFrame, metrics: dict[str, tuple[str, Column | None, Column]], by: list[str] = ()) -> DataFrame:
    """A summary by a table of metrics, each with its own denominator: name to (kind, value, where). Kinds: ``count`` (of the rows
    of ``where`` for which the flag ``value`` holds), ``rate`` (that count over the rows of ``where``), ``mean``, ``sum``, ``most``,
    ``p95`` (of ``value`` over the rows of ``where``). A NULL flag doesn't hold, NULL values don't count; a rate or sum over no
    rows is 0, a mean, ``most`` or ``p95`` NULL. One pass, whatever the number of metrics."""
    out = [F.count("*").alias("cases")]
    for name, (kind, value, where) in metrics.items():
        inside = F.coalesce(where, F.lit(False))
        if kind in ("count", "rate"):
            n = F.count_if(inside & F.coalesce(value, F.lit(False)))
            out.append((n if kind == "count" else F.round(n / F.greatest(F.lit(1), F.count_if(inside)), 6)).alias(name))
            continue
        x = F.when(inside, value)
        total = {"mean": lambda x: F.round(F.avg(x), 6), "sum": lambda x: F.round(F.coalesce(F.sum(x), F.lit(0.0)), 6), "most": F.max, "p95": lambda x: F.percentile_approx(x, 0.95, 100_000)}[kind]
        out.append(total(x).alias(name))
    return rows.groupBy(*by).agg(*out)


def shares_of_events(rows: DataFrame, events: Column, fields: list[str]) -> DataFrame:
    """Events listed in the rows' arrays, by the values of their fields ('(unknown)' for none): the fields, n, share, and in how
    many rows they stand."""
    named = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.explode(events).alias("_e"))
    keyed = named.select("_row", *[F.coalesce(F.col("_e")[f].cast("string"), F.lit("(unknown)")).alias(f) for f in fields])
    once = keyed.groupBy("_row", *fields).agg(F.count("*").alias("n"))
    g = once.groupBy(*fields).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))
