"""Queries over telemetry, feedback, memories and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import evaluation as E
from quillon.operators import memory as M
from quillon.operators import telemetry as O
from quillon.plans.adapters import low, words_sql
from quillon.plans.registry import Registry
from quillon.session import shared_path
from quillon.sources.tables import load
from quillon.streaming import rollup

registry = Registry()
NOW = "2024-02-01T00:00:00Z"
NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"

FACTS = ["invocation_id", "session_id", "repo_key", "profile_key", "event_class", "status", "degraded_reason_codes", "plan_replay_hit", "total_latency_ms", "finished_at"]


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return O.last_recorded(load(spark, folder, "runtime_invocations").select(*FACTS))


_FACTS_SQL = f"""facts AS (SELECT {', '.join(FACTS)} FROM runtime_invocations
  QUALIFY row_number() OVER (PARTITION BY invocation_id ORDER BY finished_at DESC NULLS LAST, session_id DESC NULLS LAST, repo_key DESC NULLS LAST, profile_key DESC NULLS LAST, event_class DESC NULLS LAST, status DESC NULLS LAST, degraded_reason_codes DESC NULLS LAST, plan_replay_hit DESC NULLS LAST, total_latency_ms DESC NULLS LAST) = 1),
  keyed AS (SELECT *, coalesce(session_id, '') AS s, coalesce(repo_key, '') AS r, coalesce(profile_key, '') AS p FROM facts),
  scoped AS (SELECT 'session' AS scope, s AS scope_key, * FROM keyed WHERE s <> '' UNION ALL SELECT 'all_time', '', * FROM keyed UNION ALL SELECT 'repo', r, * FROM keyed WHERE r <> ''
    UNION ALL SELECT 'profile', p, * FROM keyed WHERE p <> '' UNION ALL SELECT 'repo_profile', r || '|' || p, * FROM keyed WHERE r <> '' AND p <> '')"""


@registry.query(f"""WITH {_FACTS_SQL} SELECT scope, scope_key, count(*) AS invocations, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE plan_replay_hit) AS replay_hits, round(sum(total_latency_ms), 3) AS latency_sum,
  min(total_latency_ms) AS latency_min, max(total_latency_ms) AS latency_max, max(finished_at) AS last_at FROM scoped GROUP BY 1, 2""")
def telemetry_scopes(spark: SparkSession, folder: str) -> DataFrame:
    return O.rollup(_facts(spark, folder))


@registry.query(f"WITH {_FACTS_SQL} SELECT scope, scope_key, reason, count(*) AS events, max(finished_at) AS last_at FROM (SELECT scope, scope_key, finished_at, unnest(degraded_reason_codes) AS reason FROM scoped) WHERE reason <> '' GROUP BY 1, 2, 3")
def degraded_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return O.reasons(_facts(spark, folder))


@registry.query(f"WITH {_FACTS_SQL} SELECT invocation_id, status, finished_at FROM facts")
def invocation_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).select("invocation_id", "status", "finished_at")


@registry.query(f"WITH {_FACTS_SQL} SELECT invocation_id, repo_key, finished_at FROM facts WHERE status = 'ok' ORDER BY finished_at DESC NULLS LAST, invocation_id DESC LIMIT 25")
def invocation_listing(spark: SparkSession, folder: str) -> DataFrame:
    return O.listing(_facts(spark, folder), "finished_at", "invocation_id", 25, status="ok").select("invocation_id", "repo_key", "finished_at")


@registry.query(f"WITH {_FACTS_SQL} SELECT invocation_id, finished_at FROM facts WHERE repo_key = (SELECT min(repo_key) FROM repositories) ORDER BY finished_at DESC NULLS LAST, invocation_id DESC LIMIT 1")
def latest_match(spark: SparkSession, folder: str) -> DataFrame:
    repo = load(spark, folder, "repositories").agg(F.min("repo_key").alias("k")).first().k
    return O.listing(_facts(spark, folder), "finished_at", "invocation_id", 1, repo_key=repo).select("invocation_id", "finished_at")


# events as selections: path is type and user bucket, terms the kind of user


def _selections(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events")
    path = F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string"))
    return e.select("event_id", path.alias("path"), F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))).alias("terms"), "ts", "value", "user_id", "event_type")


_SEL_SQL = "sel AS (SELECT event_id, event_type || '/' || CAST(user_id % 10 AS VARCHAR) AS path, [event_type, 'u' || CAST(user_id % 3 AS VARCHAR)] AS terms, ts, value, user_id, event_type FROM events)"
_AGE = f"((epoch_us({NOW_SQL}) - epoch_us(ts)) / 86400e6)"


@registry.query(f"WITH {_SEL_SQL} SELECT path, round(least(0.75, sum(0.01 * CASE WHEN {_AGE} <= 0 THEN 1 ELSE pow(0.5, {_AGE} / 30.0) END)), 6) AS boost FROM sel WHERE list_has_any(terms, ['click', 'u1']) GROUP BY 1")
def feedback_boost(spark: SparkSession, folder: str) -> DataFrame:
    return O.feedback_boosts(_selections(spark, folder), ["click", "u1"], NOW, 0.01, 30.0, 0.75)


@registry.query(f"WITH {_SEL_SQL} SELECT path, count(*) AS selections, round(sum(CASE WHEN {_AGE} <= 0 THEN 1 ELSE pow(0.5, {_AGE} / 30.0) END), 6) AS weight, max(ts) AS last_at FROM sel GROUP BY 1")
def feedback_stats(spark: SparkSession, folder: str) -> DataFrame:
    return O.feedback_stats(_selections(spark, folder), NOW, 30.0)


@registry.query(f"""WITH {_SEL_SQL}, x AS (SELECT path, user_id % 5 AS candidates, event_id % 4 AS position, event_type = 'click' AS hit FROM sel)
  SELECT round(count(*) FILTER (WHERE candidates > 0 AND hit) / count(*) FILTER (WHERE candidates > 0), 6) AS attach_rate, round(1 / greatest(1, avg(position) FILTER (WHERE candidates > 0 AND position > 0)), 6) AS precision,
  (SELECT round(count(*) FILTER (WHERE n > 1) / count(*), 6) FROM (SELECT path, count(*) AS n FROM x GROUP BY 1)) AS reuse_lift FROM x""")
def feedback_decisions(spark: SparkSession, folder: str) -> DataFrame:
    s = _selections(spark, folder).select("path", (F.col("user_id") % 5).alias("candidates"), (F.col("event_id") % 4).alias("position"), (F.col("event_type") == "click").alias("in_candidates"))
    return O.decision_metrics(s)


@registry.query(f"WITH {_SEL_SQL} SELECT count(*) AS events, count(DISTINCT path) AS paths, round(sum(value), 4) AS weight, max(ts) AS last_at FROM sel")
def event_summary(spark: SparkSession, folder: str) -> DataFrame:
    return O.summary(_selections(spark, folder), "value", "ts", "path")


@registry.query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def keep_latest(spark: SparkSession, folder: str) -> DataFrame:
    return O.keep_latest(load(spark, folder, "events").select("event_id", "ts"), "ts", "event_id", 500)


@registry.query("SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def event_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return O.histogram(load(spark, folder, "events"), "event_type")


@registry.query("SELECT 'status' AS kind, status AS value, count(*) AS n, max(finished_at) AS last_at FROM runtime_invocations GROUP BY 2 UNION ALL SELECT 'category', event_class, count(*), max(finished_at) FROM runtime_invocations GROUP BY 2")
def issue_summary(spark: SparkSession, folder: str) -> DataFrame:
    return O.by_status_and_category(load(spark, folder, "runtime_invocations"), "status", "event_class", "finished_at")


_FIX_SQL = """issues AS (SELECT event_id AS issue_id, 'r' || CAST(user_id % 4 AS VARCHAR) AS reason, ts AS created_at FROM events WHERE event_type = 'error'),
  fixes AS (SELECT event_id - 1 AS issue_id, 'r' || CAST(user_id % 4 AS VARCHAR) AS reason, ts AS created_at FROM events WHERE event_type = 'purchase')"""


def _issues(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, folder, "events")
    reason = F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("reason")
    i = e.where(F.col("event_type") == "error").select(F.col("event_id").alias("issue_id"), reason, F.col("ts").alias("created_at"))
    return i, e.where(F.col("event_type") == "purchase").select((F.col("event_id") - 1).alias("issue_id"), reason, F.col("ts").alias("created_at"))


@registry.query(f"""WITH {_FIX_SQL}, j AS (SELECT i.reason, f.fixed_at, (epoch_us(f.fixed_at) - epoch_us(i.created_at)) / 3600e6 AS h FROM issues i LEFT JOIN (SELECT issue_id, min(created_at) AS fixed_at FROM fixes GROUP BY 1) f USING (issue_id)),
  a AS (SELECT reason, count(*) AS issues, count(*) FILTER (WHERE fixed_at IS NULL) AS open, round(avg(h) FILTER (WHERE h >= 0), 4) AS hours_to_fix FROM j GROUP BY 1), b AS (SELECT reason, count(*) AS fixes FROM fixes GROUP BY 1)
  SELECT reason, coalesce(issues, 0) AS issues, coalesce(open, 0) AS open, hours_to_fix, coalesce(fixes, 0) AS fixes FROM a FULL JOIN b USING (reason)""")
def dev_feedback_summary(spark: SparkSession, folder: str) -> DataFrame:
    return O.issues_and_fixes(*_issues(spark, folder))


@registry.query(f"WITH {_FIX_SQL}, f AS (SELECT issue_id, min(created_at) AS fixed_at FROM fixes GROUP BY 1) SELECT issue_id, CASE WHEN fixed_at IS NULL THEN 'open' ELSE 'resolved' END AS status, fixed_at AS resolved_at FROM issues LEFT JOIN f USING (issue_id)")
def issue_resolution(spark: SparkSession, folder: str) -> DataFrame:
    i, f = _issues(spark, folder)
    i = i.withColumns({"status": F.lit("open"), "resolved_at": F.lit(None).cast("timestamp")})
    return O.resolve(i, f).select("issue_id", "status", "resolved_at")


@registry.query("SELECT event_type AS value, count(*) AS n, round(avg(value), 6) AS mean_reward, count(DISTINCT user_id) AS queries, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def reward_replay(spark: SparkSession, folder: str) -> DataFrame:
    return O.reward_summary(load(spark, folder, "events").select("event_type", F.col("value").alias("reward"), F.col("user_id").alias("query_id")), "event_type")


@registry.query("SELECT count(*) AS events, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, quantile_disc(value, 0.95) AS p95 FROM events")
def friction_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return O.costs(load(spark, folder, "events"), "value")


_CACHE_SQL = "entries AS (SELECT DISTINCT path, min(captured_at) OVER (PARTITION BY path) AS expires_at FROM documents WHERE path IS NOT NULL AND captured_at IS NOT NULL), fs AS (SELECT DISTINCT path FROM embedding_vectors WHERE path IS NOT NULL UNION SELECT path FROM documents WHERE lang = 'en' AND path IS NOT NULL)"


def _cache(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = load(spark, folder, "documents").where(F.col("path").isNotNull())
    entries = d.where(F.col("captured_at").isNotNull()).groupBy("path").agg(F.min("captured_at").alias("expires_at"))
    v = load(spark, folder, "embedding_vectors").where(F.col("path").isNotNull()).select("path")
    return entries, v.unionByName(d.where(F.col("lang") == "en").select("path")).distinct()


@registry.query(f"WITH {_CACHE_SQL} SELECT 'missing' AS kind, path FROM entries ANTI JOIN fs USING (path) UNION ALL SELECT 'orphan', path FROM fs ANTI JOIN entries USING (path)")
def cache_verify(spark: SparkSession, folder: str) -> DataFrame:
    return O.cache_faults(*_cache(spark, folder))


@registry.query(f"WITH {_CACHE_SQL}, x AS (SELECT 'expired' AS kind, path FROM entries WHERE expires_at < TIMESTAMP '2025-06-01' UNION ALL SELECT 'orphan', path FROM fs ANTI JOIN entries USING (path)) SELECT * FROM x ORDER BY kind, path LIMIT 16")
def cache_gc(spark: SparkSession, folder: str) -> DataFrame:
    return O.bounded_gc(*_cache(spark, folder), "2025-06-01T00:00:00Z")


# --- memories


@registry.query(f"""WITH n AS (SELECT doc_id AS handle, captured_at AS ts, len(list_intersect(['ranker', 'budget'], {words_sql('text')})) / 2.0 + 1.2 * len(list_intersect(['ranker', 'budget'], list_distinct(regexp_extract_all(translate(coalesce(source, '') || ' ' || coalesce(lang, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')))) / 2.0
   + 0.8 * len(list_intersect(['ranker', 'budget'], {words_sql('path')})) / 2.0 AS b FROM documents)
  SELECT handle, ts, round(least(2.0, b), 6) AS score FROM n WHERE b > 0 ORDER BY score DESC, ts DESC NULLS LAST, handle LIMIT 100""")
def notes_search(spark: SparkSession, folder: str) -> DataFrame:
    d = load(spark, folder, "documents")
    notes = d.select(F.col("doc_id").alias("handle"), "text", F.col("path").alias("query"), F.array_compact(F.array("source", "lang")).alias("keywords"), F.col("captured_at").alias("ts"))
    return M.search_notes(notes, "ranker  budget", 100)


@registry.query(f"""SELECT event_id, round(value * (0.5 + 0.5 * exp(-greatest(0, {_AGE}) / 10.0)), 6) AS decayed, round(value * CASE WHEN length(props) > 6 THEN 1 / (1 + log2(length(props) / 6.0)) ELSE 1 END, 6) AS normalised,
  round(0.3 * greatest(0, least(1, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10')) / (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(TIMESTAMP '2024-01-10')))), 6) AS boost FROM events""")
def memory_decay(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts")
    day = lambda d: F.lit(f"2024-01-{d}T00:00:00Z").cast("timestamp")
    return load(spark, folder, "events").select(
        "event_id",
        F.round(F.col("value") * M.decay_factor(ts, NOW, 10.0), 6).alias("decayed"),
        F.round(F.col("value") * M.length_factor(F.length("props"), 6), 6).alias("normalised"),
        F.round(M.recency_boost(ts, day(10), day(20), 0.3), 6).alias("boost"),
    )


@registry.query(f"SELECT doc_id FROM documents WHERE coalesce((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(captured_at)) / 86400e6 <= 200, true)")
def ttl_prune(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("captured_at")
    return M.prune(load(spark, folder, "documents"), t, t, "2026-01-01T00:00:00Z", 200, 400).select("doc_id")


@registry.query("SELECT CAST(captured_at AS DATE) AS day, count(DISTINCT doc_id) AS handles, count(*) AS hits FROM documents GROUP BY 1")
def timeline(spark: SparkSession, folder: str) -> DataFrame:
    return M.timeline(load(spark, folder, "documents"), "captured_at", "doc_id")


@registry.query("SELECT repo, doc_id, captured_at FROM documents QUALIFY row_number() OVER (PARTITION BY repo ORDER BY captured_at NULLS FIRST, doc_id) = 1")
def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    d = load(spark, folder, "documents").select("repo", "doc_id", "captured_at")
    return M.first_by(d, "repo", [F.col("captured_at"), F.col("doc_id")])


@registry.query("SELECT provider, path, max(written_at) AS written_at, arg_max(vec_id, (written_at, vec_id)) AS vec_id FROM embedding_vectors GROUP BY 1, 2")
def latest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return M.latest_by(load(spark, folder, "embedding_vectors").select("provider", "path", "vec_id", "written_at"), ["provider", "path"], ["written_at", "vec_id"])


@registry.query("SELECT doc_id FROM documents WHERE captured_at IS NULL OR captured_at BETWEEN TIMESTAMP '2025-06-01' AND TIMESTAMP '2025-12-31'")
def temporal_window(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").where(M.in_window(F.col("captured_at"), "2025-06-01T00:00:00Z", "2025-12-31T00:00:00Z")).select("doc_id")


@registry.query("SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND NOT regexp_matches(lower(text), '^(feat|fix)\\(')")
def noise_filter(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").where(M.not_noise(F.col("text"), [r"^(feat|fix)\("])).select("doc_id")


@registry.query("SELECT plan_id, CASE WHEN length(trim(coalesce(query, ''))) < 3 THEN 'short' WHEN starts_with(lower(trim(query)), 'explain') THEN 'explain' WHEN regexp_matches(lower(trim(query)), 'repair|fix') THEN 'repair' ELSE 'retrieve' END AS reason FROM evidence_plans")
def query_gate(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "evidence_plans").select("plan_id", M.gate(F.col("query"), [("explain", "^explain"), ("repair", "repair|fix")]).alias("reason"))


@registry.query("SELECT fact_handle, CASE WHEN namespace = 'repo' THEN 'namespace' WHEN repo = 'griba' THEN 'repo' ELSE 'outside' END AS scope FROM memory_triples")
def memory_scope(spark: SparkSession, folder: str) -> DataFrame:
    return M.scope(load(spark, folder, "memory_triples"), "griba", "repo").select("fact_handle", "scope")


@registry.query()
def profile_facts(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "memory_triples")
    facts = t.select(F.concat_ws(" ", "subject", "predicate", "object_value").alias("text"), "confidence", (F.col("confidence") / 2).alias("importance"), F.length("subject").alias("uses"), F.lit(NOW).cast("timestamp").alias("last_used"), F.length("object_value").alias("tokens")).distinct()
    return M.ranked_facts(facts, 12, 60)


# --- evaluation: plans as cases, their candidate files as candidates


def _cases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    p = load(spark, folder, "evidence_plans").dropDuplicates(["plan_id"])
    cases = p.select(F.col("plan_id").alias("case_id"), F.array(F.element_at(F.split(T.text("query"), " "), -1)).alias("expected"))
    c = p.select(F.col("plan_id").alias("case_id"), F.posexplode("candidate_chunks").alias("pos", "e")).where(F.col("e.path").isNotNull())
    return cases, c.select("case_id", (F.col("pos") + 1).alias("rank"), "e.path", F.col("e.qualified_name").alias("module"))


_PATH_WORDS = lambda x: f"list_distinct(list_filter(regexp_split_to_array(translate({low(x)}, '/.', '  '), '\\s+'), lambda w: w <> ''))"
_CASES_SQL = f"""plans AS (SELECT DISTINCT ON (plan_id) * FROM evidence_plans), wanted AS (SELECT plan_id, {_PATH_WORDS("string_split(coalesce(query, ''), ' ')[-1]")} AS e FROM plans),
  cand AS (SELECT plan_id, rank, {_PATH_WORDS("concat_ws(' ', c.path, c.qualified_name)")} AS t FROM (SELECT plan_id, unnest(candidate_chunks) AS c, generate_subscripts(candidate_chunks, 1) AS rank FROM plans) WHERE c.path IS NOT NULL AND rank <= 5),
  g AS (SELECT w.plan_id AS case_id, count(rank) AS n, count(*) FILTER (WHERE coalesce(list_has_any(t, e), false)) AS hits, min(rank) FILTER (WHERE list_has_any(t, e)) AS first FROM wanted w LEFT JOIN cand USING (plan_id) GROUP BY 1),
  cases AS (SELECT case_id, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS recall_hit, round(p, 6) AS precision, round(greatest(0.0, 1.0 - p), 6) AS noise, CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_at_1, round(coalesce(1.0::DOUBLE / first, 0.0), 6) AS reciprocal_rank
    FROM (SELECT *, hits::DOUBLE / greatest(1, CASE WHEN n > 0 THEN least(5, n) ELSE 5 END) AS p FROM g))"""


@registry.query(f"WITH {_CASES_SQL} SELECT * FROM cases")
def case_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return E.match_metrics(*_cases(spark, folder), 5)


_AGGREGATE_SQL = _CASES_SQL + """, agg AS (SELECT count(*) AS cases, round(avg(recall_hit), 6) AS recall_hit_mean, round(avg(precision), 6) AS precision_mean, round(avg(noise), 6) AS noise_mean, round(avg(hit_at_1), 6) AS hit_at_1_mean,
  round(avg(reciprocal_rank), 6) AS reciprocal_rank_mean, round(median(precision), 6) AS precision_median, quantile_disc(noise, 0.95) AS noise_p95 FROM cases)"""


@registry.query(f"WITH {_AGGREGATE_SQL} SELECT * FROM agg")
def aggregate_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return E.aggregate(case_metrics(spark, folder), ["recall_hit", "precision", "noise", "hit_at_1", "reciprocal_rank"], ["precision"], ["noise"])


@registry.query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 4) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def stage_latency(spark: SparkSession, folder: str) -> DataFrame:
    return E.stage_latency(load(spark, folder, "events").withColumnRenamed("event_type", "stage"), "stage", "value")


@registry.query("SELECT count(*) AS cases, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median, quantile_disc(value, 0.95) AS value_p95, event_type AS lane FROM events WHERE trim(event_type) <> '' GROUP BY event_type")
def comparison_lanes(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events").withColumnRenamed("event_type", "lane")
    return E.aggregate(e.where(F.trim("lane") != ""), ["value"], ["value"], ["value"], by=["lane"])


@registry.query("SELECT status AS executed, event_class AS shadow, count(*) AS cases, round(avg(total_latency_ms), 4) AS mean, quantile_disc(total_latency_ms, 0.95) AS p95, status <> event_class AS differs FROM runtime_invocations WHERE coalesce(status, '') <> '' AND coalesce(event_class, '') <> '' GROUP BY 1, 2")
def arm_pairs(spark: SparkSession, folder: str) -> DataFrame:
    r = load(spark, folder, "runtime_invocations").select(F.col("status").alias("executed"), F.col("event_class").alias("shadow"), "total_latency_ms")
    return E.arm_pairs(r, "executed", "shadow", "total_latency_ms")


@registry.query("SELECT event_class, count(*) AS cases, count(*) FILTER (WHERE plan_replay_hit) AS replay_count, round(count(*) FILTER (WHERE plan_replay_hit) / count(*), 6) AS replay_rate, count(*) FILTER (WHERE len(degraded_reason_codes) > 0) AS degraded_count, round(count(*) FILTER (WHERE len(degraded_reason_codes) > 0) / count(*), 6) AS degraded_rate FROM runtime_invocations GROUP BY 1")
def slo_rates(spark: SparkSession, folder: str) -> DataFrame:
    r = load(spark, folder, "runtime_invocations")
    return E.rates(r, {"replay": F.col("plan_replay_hit"), "degraded": F.size("degraded_reason_codes") > 0}, ["event_class"])


@registry.query("SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate, row_number() OVER (ORDER BY count(*) DESC, event_type) = 1 AS dominant FROM events GROUP BY 1")
def taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    return E.dominant(load(spark, folder, "events"), "event_type")


_MONTH = "SELECT event_type AS metric, sum(value) AS value FROM events WHERE ts {op} TIMESTAMP '2024-01-16' GROUP BY 1"
_DIFF_SQL = f"d AS (SELECT metric, coalesce(c.value, 0) AS current, coalesce(b.value, 0) AS baseline, round(coalesce(c.value, 0) - coalesce(b.value, 0), 6) AS delta FROM ({_MONTH.format(op='>=')}) c FULL JOIN ({_MONTH.format(op='<')}) b USING (metric))"


def _diff(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events")
    half = F.lit("2024-01-16T00:00:00Z").cast("timestamp")
    of = lambda rows: rows.groupBy(F.col("event_type").alias("metric")).agg(F.sum("value").alias("value"))
    return E.compare(of(e.where(F.col("ts") >= half)), of(e.where(F.col("ts") < half)))


@registry.query(f"WITH {_DIFF_SQL} SELECT metric, round(current, 4) AS current, round(baseline, 4) AS baseline, round(delta, 4) AS delta FROM d")
def compare_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder).select("metric", *[F.round(c, 4).alias(c) for c in ("current", "baseline", "delta")])


@registry.query(f"WITH {_DIFF_SQL} SELECT metric, round(current, 4) AS current, round(baseline, 4) AS baseline, CASE WHEN metric IN ('purchase', 'signup') AND delta < 0 THEN 'fell' WHEN metric = 'error' AND delta > 0 THEN 'rose' WHEN metric IN ('view', 'click') AND baseline > 0 AND current > 1.1 * baseline THEN 'grew' END AS \"check\" FROM d WHERE \"check\" IS NOT NULL")
def regressions(spark: SparkSession, folder: str) -> DataFrame:
    found = E.regressions(_diff(spark, folder), "strict", ["purchase", "signup"], ["error"], ["view", "click"])
    return found.withColumns({c: F.round(c, 4) for c in ("current", "baseline")})


@registry.query(f"""WITH {_CASES_SQL}, r AS (SELECT case_id, round(least(1.0, CASE WHEN recall_hit <= 0 THEN 0.35 WHEN hit_at_1 <= 0 THEN 0.25 ELSE 0 END + CASE WHEN noise > 0 THEN least(0.2, noise * 0.2) ELSE 0 END), 6) AS risk FROM cases)
  SELECT case_id, risk, CASE WHEN risk >= 0.75 THEN 'high' WHEN risk >= 0.4 THEN 'elevated' ELSE 'low' END AS level FROM r""")
def missing_context_risk(spark: SparkSession, folder: str) -> DataFrame:
    c = case_metrics(spark, folder)
    score, level = E.risk(F.col("recall_hit"), F.col("hit_at_1"), F.col("noise"), F.lit(0.0), F.lit(0.0))
    return c.select("case_id", score.alias("risk"), level.alias("level"))


@registry.query(f"""WITH {_AGGREGATE_SQL} SELECT 'precision_mean' AS metric, precision_mean AS value, 0.64::DOUBLE AS bound, precision_mean >= 0.64 AS passed FROM agg
  UNION ALL SELECT 'noise_mean', noise_mean, 0.36, noise_mean <= 0.36 FROM agg UNION ALL SELECT 'absent', NULL, 0.9, false""")
def frontier_gate(spark: SparkSession, folder: str) -> DataFrame:
    m = E.unpivot(aggregate_metrics(spark, folder))
    return E.gate(m, {"precision_mean": (">=", 0.64), "noise_mean": ("<=", 0.36), "absent": (">=", 0.9)})


@registry.query("""WITH p AS (SELECT DISTINCT ON (plan_id) plan_id, repo FROM evidence_plans), f AS (SELECT p.plan_id, min(e.plan_id % 3 + 1) FILTER (WHERE e.repo = p.repo) AS first FROM p JOIN evidence_plans e USING (plan_id) GROUP BY 1)
  SELECT round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS hit_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, 200.0::DOUBLE AS latency FROM f""")
def workspace_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "evidence_plans").dropDuplicates(["plan_id"])
    cases = p.select(F.col("plan_id").alias("case_id"), F.array("repo").alias("expected"), F.lit(200.0).alias("ms"))
    ranked = load(spark, folder, "evidence_plans").select(F.col("plan_id").alias("case_id"), (F.col("plan_id") % 3 + 1).alias("rank"), "repo").distinct()
    return E.routing_metrics(cases, ranked)


@registry.query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1) GROUP BY 1, 2")
def streaming_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The daily roll-up made by a stream over the events' files that processes what is there."""
    base = shared_path(spark, "stream")
    events = rollup.read_events(spark, f"{folder}/events.parque[t]")  # a pattern, as the table may be one file
    rollup.run_once(rollup.event_rollup(events), f"{base}/out", f"{base}/state")
    out = spark.read.parquet(f"{base}/out")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("w.start") / F.lit(86_400_000_000)).cast("int"))
    return out.select(day.alias("day"), "event_type", "n", F.round("total", 4).alias("total"), "least", "most")


@registry.query("SELECT status, count(*) AS cases, round(avg(CASE WHEN plan_replay_hit THEN 1.0 ELSE 0 END), 6) AS success, round(avg(1.0 / (1 + len(degraded_reason_codes))), 6) AS mrr, quantile_disc(total_latency_ms, 0.95) AS p95 FROM runtime_invocations WHERE trim(status) <> '' GROUP BY 1")
def router_arms(spark: SparkSession, folder: str) -> DataFrame:
    r = load(spark, folder, "runtime_invocations")
    rows = r.select("status", F.when(F.col("plan_replay_hit"), 1.0).otherwise(0.0).alias("success"), (F.lit(1.0) / (F.lit(1) + F.size("degraded_reason_codes"))).alias("reciprocal_rank"), F.col("total_latency_ms").alias("latency_ms"))
    return E.router_arms(rows, "status")


@registry.query("""WITH a AS (SELECT coalesce(contract_error_code, '') AS reason, len(degraded_reason_codes) > 0 AS lacking FROM runtime_invocations WHERE event_class <> 'negative_control' AND status <> 'ok')
  SELECT '' AS reason, count(*) AS applicable, count(*) FILTER (WHERE lacking) AS n, round(count(*) FILTER (WHERE lacking) / greatest(1, count(*)), 6) AS rate FROM a
  UNION ALL SELECT reason, count(*), count(*), 1.0 FROM a WHERE lacking AND reason <> '' GROUP BY 1""")
def evidence_insufficiency(spark: SparkSession, folder: str) -> DataFrame:
    r = load(spark, folder, "runtime_invocations").where(F.col("event_class").isNotNull() & F.col("status").isNotNull())
    rows = r.select(F.col("event_class").alias("mode"), F.when(F.col("status") == "ok", 1.0).otherwise(0.0).alias("success"), F.when(F.size("degraded_reason_codes") > 0, 1.0).otherwise(0.0).alias("insufficient"), F.col("contract_error_code").alias("reason"))
    return E.insufficiency(rows)


@registry.query("SELECT event_class, count(*) AS cases, round(avg(CAST(plan_replay_hit AS INT)), 6) AS plan_replay_hit_rate, round(avg(CAST(trace_exported AS INT)), 6) AS trace_exported_rate, round(avg(total_latency_ms), 6) AS total_latency_ms_mean, round(median(total_latency_ms), 6) AS total_latency_ms_median, quantile_disc(total_latency_ms, 0.95) AS total_latency_ms_p95 FROM runtime_invocations GROUP BY 1")
def aggregate_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    r = load(spark, folder, "runtime_invocations").select("event_class", "invocation_id", "plan_replay_hit", "trace_exported", "total_latency_ms")
    return E.aggregate_all(r, ["event_class"])
