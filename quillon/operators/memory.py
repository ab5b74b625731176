"""Memories: search, decay, pruning, timelines, temporal filters, upserts."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import ascii_lower, days_between, overlap, text, word_set


def search_notes(notes: DataFrame, query: str, limit: int, key: str = "handle") -> DataFrame:
    """Notes (key, text, query, keywords, ts) by 1.0 of the overlap with their text, 1.2 with keywords, .8 with the query they
    were taken for, .5 for the whole phrase, at most 2; newest first among equals."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(re.findall("[a-z0-9_]+", query.lower()))])
    keywords = F.concat_ws(" ", F.col("keywords"))
    base = overlap(q, word_set(F.col("text"))) + overlap(q, word_set(keywords)) * 1.2 + overlap(q, word_set(F.col("query"))) * 0.8
    blob = ascii_lower(F.concat_ws(" ", text("text"), text("query"), keywords))
    phrase = F.when(F.contains(blob, F.lit(query.lower())), 0.5).otherwise(0.0)
    found = notes.select(key, "ts", base.alias("_b"), phrase.alias("_p")).where(F.col("_b") > 0)
    return found.select(key, "ts", F.round(F.least(F.lit(2.0), F.col("_b") + F.col("_p")), 6).alias("score")).orderBy(F.desc("score"), F.desc_nulls_last("ts"), key).limit(limit)


def length_factor(length: Column, anchor: int) -> Column:
    """1 / (1 + log2(length / anchor)) for texts longer than ``anchor``, else 1."""
    return F.when(length > anchor, F.lit(1.0) / (F.lit(1.0) + F.log2(length / F.lit(float(anchor))))).otherwise(F.lit(1.0))


def decay_factor(ts: Column, now: str, scale_days: float) -> Column:
    """.5 + .5 * exp(-age / scale); 1 without a time."""
    age = F.greatest(F.lit(0.0), days_between(now, ts))
    return F.when(ts.isNull() | F.lit(scale_days <= 0), F.lit(1.0)).otherwise(F.lit(0.5) + F.lit(0.5) * F.exp(-age / F.lit(scale_days)))


def recency_boost(ts: Column, low: Column, high: Column, most: float) -> Column:
    """A boost rising from 0 at ``low`` to ``most`` at ``high``, clamped; 0 without a time or span."""
    part = (F.unix_micros(ts) - F.unix_micros(low)) / (F.unix_micros(high) - F.unix_micros(low))
    return F.coalesce(F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * most), F.lit(0.0))


def not_noise(c: Column, patterns: list[str]) -> Column:
    """Non-blank texts that fit none of the patterns."""
    ok = F.trim(text(c)) != ""
    for p in patterns:
        ok = ok & ~ascii_lower(text(c)).rlike(p)
    return ok


def in_window(ts: Column, start: str | None, end: str | None) -> Column:
    """Times within [start, end]; missing times pass."""
    ok = F.lit(True)
    if start:
        ok = ok & (ts >= F.lit(start).cast("timestamp"))
    if end:
        ok = ok & (ts <= F.lit(end).cast("timestamp"))
    return ts.isNull() | ok


def valid_at(as_of: Column, valid_to: Column, moment: Column) -> Column:
    """Known by the moment and not over before it; a missing end is open. All in the same unit."""
    return (as_of <= moment) & (valid_to.isNull() | (valid_to >= moment))


def prune(rows: DataFrame, seen: Column, created: Column, now: str, ttl_days: float, age_days: float) -> DataFrame:
    """Rows seen within the TTL and not older than the age limit; unknown times are kept."""
    keep = F.coalesce(days_between(now, seen) <= ttl_days, F.lit(True)) & F.coalesce(days_between(now, created) <= age_days, F.lit(True))
    return rows.where(keep)


def timeline(rows: DataFrame, ts: str, handle: str) -> DataFrame:
    """day, handles, hits by UTC day, newest first; rows without a time are counted under a NULL day."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))
    return rows.groupBy(day.alias("day")).agg(F.count_distinct(handle).alias("handles"), F.count("*").alias("hits")).orderBy(F.desc_nulls_last("day"))


def first_by(rows: DataFrame, key: str, place: list[Column]) -> DataFrame:
    """The first row of each key in the given order, combined before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*place)).alias("_r")).select(key, "_r.*")


def latest_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order; NULLs come first."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows replaced by new ones of the same key, others added."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def fetch(rows: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted keys with their place in the request."""
    asked = rows.sparkSession.createDataFrame(list(enumerate(wanted)), f"place int, {key} string")
    return rows.join(F.broadcast(asked), key)


_UNITS = {"h": "hours", "hour": "hours", "hours": "hours", "d": "days", "day": "days", "days": "days", "w": "weeks", "week": "weeks", "weeks": "weeks"}


def resolve_window(time_range: str | None, start: str | None, end: str | None, now: datetime) -> tuple[datetime | None, datetime | None, str]:
    """Bounds in UTC and the reason: from ISO dates (an end date means its last microsecond), else from a range such as
    ``7d`` or ``last 3 weeks``; none of both gives no bounds."""

    def read(value: str, last: bool) -> datetime:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            day = datetime.fromisoformat(value).replace(tzinfo=timezone.utc)
            return day + timedelta(days=1) - timedelta(microseconds=1) if last else day
        at = datetime.fromisoformat(value)
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)

    if start or end:
        low, high = read(start, False) if start else None, read(end, True) if end else None
        return (None, None, "inverted") if low and high and low > high else (low, high, "dates")
    if time_range:
        m = re.fullmatch(r"(?:last\s+)?(\d+)\s*([a-z]+)", time_range.strip().lower())
        if not m or m[2] not in _UNITS:
            return None, None, "unreadable"
        return now - timedelta(**{_UNITS[m[2]]: int(m[1])}), now, "range"
    return None, None, "none"


def gate(query: Column, rules: list[tuple[str, str]], least: int = 3) -> Column:
    """The reason of the first pattern that fits a query, ``short`` for fewer than ``least`` characters, else ``retrieve``."""
    q = ascii_lower(F.trim(text(query)))
    out = F.lit("retrieve")
    for reason, pattern in reversed(rules):
        out = F.when(q.rlike(pattern), F.lit(reason)).otherwise(out)
    return F.when(F.length(q) < least, F.lit("short")).otherwise(out)


def scope(df: DataFrame, repo: str, namespace: str) -> DataFrame:
    """Marks rows as within the namespace, within the repository alone, or outside."""
    where = F.when(F.col("namespace") == namespace, "namespace").when(F.col("repo") == repo, "repo").otherwise("outside")
    return df.withColumn("scope", where)


def ranked_facts(facts: DataFrame, n: int, budget: int) -> DataFrame:
    """Facts (text, confidence, importance, uses, last_used, tokens) by .60 confidence, .30 importance, .07 recency (min-max)
    and .03 use, taken in that order while they fit: one that doesn't fit is skipped. No
    more than the ``n`` best of each number of tokens up to the budget can be taken, so only those are gathered: text, score."""
    span = facts.agg(F.struct(F.min("last_used").alias("a"), F.max("last_used").alias("b")).alias("s")).scalar()
    f = facts.withColumn("_s", span)
    recency = F.when(F.col("_s.b") > F.col("_s.a"), (F.unix_micros("last_used") - F.unix_micros("_s.a")) / (F.unix_micros("_s.b") - F.unix_micros("_s.a"))).otherwise(F.lit(1.0))
    used = F.least(F.lit(1.0), F.log1p(F.col("uses").cast("double")) / F.log1p(F.lit(10.0)))
    f = f.select("text", "tokens", F.round(F.col("confidence") * 0.6 + F.col("importance") * 0.3 + F.coalesce(recency, F.lit(0.0)) * 0.07 + used * 0.03, 9).alias("score"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        out, left = [], budget
        for r in rows.sort_values(["score", "text"], ascending=[False, True]).itertuples():
            if len(out) == n:
                break
            if r.tokens <= left:
                left -= r.tokens
                out.append((r.text, r.score))
        return pd.DataFrame(out, columns=["text", "score"])

    place = F.row_number().over(W.partitionBy("tokens").orderBy(F.desc("score"), "text"))
    best = f.where(F.col("tokens") <= budget).withColumn("_n", place).where(F.col("_n") <= n).drop("_n")
    return best.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(choose, "text string, score double")


def explain(hits: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """Key, score and a struct of what made it up."""
    return hits.select(key, "score", F.struct(*[c.alias(n) for n, c in parts.items()]).alias("attribution"))


