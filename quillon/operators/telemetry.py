"""Feedback, telemetry and event aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import days_between, half_life, text

SCOPES = ["session", "all_time", "repo", "profile", "repo_profile"]


def last_recorded(facts: DataFrame) -> DataFrame:
    """Of facts recorded again under one invocation_id the one last finished, ties by the other columns; combined before the
    shuffle. Facts without an id stand for themselves."""
    keep = [c for c in facts.columns if c not in ("invocation_id", "finished_at")]
    known = facts.where(F.col("invocation_id").isNotNull())
    last = known.groupBy("invocation_id").agg(F.max(F.struct("finished_at", *keep)).alias("_r")).select("invocation_id", "_r.*")
    return last.select(*facts.columns).unionByName(facts.where(F.col("invocation_id").isNull()))


def scoped(facts: DataFrame, measures: list[Column]) -> DataFrame:
    """Aggregates of each of five scopes: session, all time, repository, profile, repository and profile. Facts whose key is
    '' or NULL belong to the scopes without it: scope, scope_key and the measures. One pass through grouping sets."""
    f = facts.withColumns({"_s": text("session_id"), "_r": text("repo_key"), "_p": text("profile_key")})
    sets = f.groupingSets([["_s"], [], ["_r"], ["_p"], ["_r", "_p"]], "_s", "_r", "_p").agg(F.grouping_id().alias("_g"), *measures)
    # bits of the grouping id: a set bit means the column is not part of the group
    scope = F.when(F.col("_g") == 3, "session").when(F.col("_g") == 7, "all_time").when(F.col("_g") == 5, "repo").when(F.col("_g") == 6, "profile").otherwise("repo_profile")
    named = sets.withColumns({"scope": scope, "scope_key": F.concat_ws("|", "_s", "_r", "_p")})
    blank = (F.col("_s") == "") | (F.col("_r") == "") | (F.col("_p") == "")
    return named.where(~F.coalesce(blank, F.lit(False)) & ~((F.col("_g") == 4) & (F.col("_r").isNull() | F.col("_p").isNull()))).drop("_s", "_r", "_p", "_g")


def rollup(facts: DataFrame) -> DataFrame:
    """Counters and latencies of each scope."""
    ms = F.col("total_latency_ms")
    return scoped(
        facts,
        [
            F.count("*").alias("invocations"),
            F.count_if(F.col("status") == "ok").alias("ok"),
            F.count_if(F.col("plan_replay_hit")).alias("replay_hits"),
            F.round(F.sum(ms), 3).alias("latency_sum"),
            F.min(ms).alias("latency_min"),
            F.max(ms).alias("latency_max"),
            F.max("finished_at").alias("last_at"),
        ],
    )


def reasons(facts: DataFrame) -> DataFrame:
    """How often each degraded reason occurs in each scope, and when last."""
    rows = facts.withColumn("reason", F.explode("degraded_reason_codes")).where(F.col("reason") != "")
    names = rows.select("session_id", "repo_key", "profile_key", "reason", "finished_at")
    parts = []
    for scope, keys in (("session", ["session_id"]), ("all_time", []), ("repo", ["repo_key"]), ("profile", ["profile_key"]), ("repo_profile", ["repo_key", "profile_key"])):
        some = reduce(lambda a, b: a & b, [text(k) != "" for k in keys], F.lit(True))
        parts.append(F.when(some, F.struct(F.lit(scope).alias("scope"), F.concat_ws("|", *keys).alias("scope_key")) if keys else F.struct(F.lit(scope).alias("scope"), F.lit("").alias("scope_key"))))
    exploded = names.select("reason", "finished_at", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("s"))
    return exploded.groupBy("s.scope", "s.scope_key", "reason").agg(F.count("*").alias("events"), F.max("finished_at").alias("last_at"))


def feedback_boosts(events: DataFrame, query: list[str], now: str, boost: float, half_life_days: float, cap: float) -> DataFrame:
    """path, boost: of events (terms, path, ts) that share a term with the query, decayed by half-life, summed up to ``cap``."""
    on = events.where(F.arrays_overlap("terms", F.array(*[F.lit(q) for q in query])))
    add = half_life(days_between(now, F.col("ts")), half_life_days) * boost
    return on.groupBy("path").agg(F.round(F.least(F.lit(cap), F.sum(add)), 6).alias("boost"))


def feedback_stats(events: DataFrame, now: str, half_life_days: float) -> DataFrame:
    """path, selections, weight (decayed), last_at."""
    w = half_life(days_between(now, F.col("ts")), half_life_days)
    return events.groupBy("path").agg(F.count("*").alias("selections"), F.round(F.sum(w), 6).alias("weight"), F.max("ts").alias("last_at"))


def decision_metrics(events: DataFrame) -> DataFrame:
    """Of selections (path, position, candidates, in_candidates): the share that was among the candidates, 1 / max(1, mean
    position), the share of paths chosen again."""
    shown = F.col("candidates") > 0
    paths = events.where(text("path") != "").groupBy("path").agg(F.count("*").alias("n")).agg((F.count_if(F.col("n") > 1) / F.count("*")).alias("x")).scalar()
    at = F.avg(F.when(shown & (F.col("position") > 0), F.col("position")))
    return events.agg(
        F.round(F.count_if(shown & F.col("in_candidates")) / F.count_if(shown), 6).alias("attach_rate"), F.round(F.lit(1.0) / F.greatest(F.lit(1.0), at), 6).alias("precision")
    ).withColumn("reuse_lift", F.round(paths, 6))


def keep_latest(rows: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows."""
    return rows.orderBy(F.desc_nulls_last(ts), F.desc(key)).limit(n)


def listing(rows: DataFrame, ts: str, key: str, limit: int | None = None, **equal: str | None) -> DataFrame:
    """Rows that have the given values (None: any), newest first."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rows = rows.orderBy(F.desc_nulls_last(ts), F.desc(key))
    return rows.limit(limit) if limit is not None else rows


def summary(rows: DataFrame, weight: str, ts: str, path: str) -> DataFrame:
    return rows.agg(F.count("*").alias("events"), F.count_distinct(path).alias("paths"), F.round(F.sum(weight), 4).alias("weight"), F.max(ts).alias("last_at"))


def histogram(rows: DataFrame, column: str, default: str = "(unknown)") -> DataFrame:
    """value, n, share."""
    value = F.when(F.trim(text(column)) == "", F.lit(default)).otherwise(F.lower(F.trim(text(column))))
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def by_status_and_category(rows: DataFrame, status: str, category: str, ts: str) -> DataFrame:
    """Two histograms in one pass: kind (status or category), value, n, last_at."""
    sets = rows.groupingSets([[status], [category]], status, category).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.max(ts).alias("last_at"))
    kind = F.when(F.col("_g") == 1, "status").otherwise("category")
    return sets.select(kind.alias("kind"), F.when(F.col("_g") == 1, F.col(status)).otherwise(F.col(category)).alias("value"), "n", "last_at")


def issues_and_fixes(issues: DataFrame, fixes: DataFrame) -> DataFrame:
    """By reason: issues, open ones, fixes, mean hours to the first fix."""
    first = fixes.groupBy("issue_id").agg(F.min("created_at").alias("_fixed"))
    hours = (F.unix_micros("_fixed") - F.unix_micros("created_at")) / F.lit(3_600e6)
    a = issues.join(first, "issue_id", "left").groupBy("reason").agg(
        F.count("*").alias("issues"), F.count_if(F.col("_fixed").isNull()).alias("open"), F.round(F.avg(F.when(hours >= 0, hours)), 4).alias("hours_to_fix")
    )
    b = fixes.groupBy("reason").agg(F.count("*").alias("fixes"))
    return a.join(b, "reason", "full").fillna(0, ["issues", "open", "fixes"])


def resolve(issues: DataFrame, fixes: DataFrame) -> DataFrame:
    """Issues with the status and time of their first fix."""
    first = fixes.groupBy("issue_id").agg(F.min("created_at").alias("_fixed"))
    out = issues.join(first, "issue_id", "left")
    return out.withColumns({"status": F.when(F.col("_fixed").isNotNull(), F.lit("resolved")).otherwise(F.col("status")), "resolved_at": F.coalesce("_fixed", "resolved_at")}).drop("_fixed")


def reward_summary(events: DataFrame, by: str) -> DataFrame:
    """value, n, share, mean_reward, queries."""
    g = events.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward"), F.count_distinct("query_id").alias("queries"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def costs(events: DataFrame, cost: str) -> DataFrame:
    """events, total, mean and the 95th percentile (nearest rank, exact up to 100,000 events, else within n / 100,000 ranks) of a cost."""
    return events.agg(F.count("*").alias("events"), F.round(F.sum(cost), 4).alias("total"), F.round(F.avg(cost), 4).alias("mean"), F.percentile_approx(cost, 0.95, 100_000).alias("p95"))


def expired(entries: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """Cache entries past their time, and files without an entry: kind, path."""
    old = entries.where(F.col("expires_at") < F.lit(now).cast("timestamp")).select(F.lit("expired").alias("kind"), "path")
    return old.unionByName(files.join(entries.select("path"), "path", "left_anti").select(F.lit("orphan").alias("kind"), "path"))


def bounded_gc(entries: DataFrame, files: DataFrame, now: str, most: int = 16) -> DataFrame:
    """What one bounded clean-up removes: expired entries first, then orphans, ``most`` in all."""
    return expired(entries, files, now).orderBy("kind", "path").limit(most)


def cache_faults(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries without a file and files without an entry: kind, path."""
    a = entries.join(files.select("path"), "path", "left_anti").select(F.lit("missing").alias("kind"), "path")
    return a.unionByName(files.join(entries.select("path"), "path", "left_anti").select(F.lit("orphan").alias("kind"), "path"))
