"""Summaries of cases by tables of metrics, each metric with its own denominator. Runtime invocations and the chunks of evidence
plans stand for the cases; the SQL beside a metric is written by itself, not derived from its column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import evaluation as E
from quillon.plans.adapters import CHUNKS_SQL, chunks
from quillon.plans.registry import Registry
from quillon.sources.tables import load

registry = Registry()


def _c(name: str) -> Column:
    return F.col(name)


def _sql(kind: str, value: str, where: str) -> str:
    if kind == "count":
        return f"count(*) FILTER (WHERE ({where}) AND ({value}))"
    if kind == "rate":
        return f"round(count(*) FILTER (WHERE ({where}) AND ({value})) / greatest(1, count(*) FILTER (WHERE {where})), 6)"
    x = f"CASE WHEN {where} THEN {value} END"
    return {"mean": f"round(avg({x}), 6)", "sum": f"round(coalesce(sum({x}), 0.0), 6)", "most": f"max({x})", "p95": f"quantile_disc({x}, 0.95)"}[kind]


def _add(name: str, source: str, rows, by: list[str], metrics: dict[str, tuple], doc: str) -> None:
    """Registers a query: metrics are name to (kind, value, its SQL, where, its SQL)."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        table = {k: (kind, value(), where()) for k, (kind, value, _, where, _) in metrics.items()}
        return E.conditional(rows(spark, folder), table, by)

    run.__name__, run.__doc__ = name, doc
    columns = [*by, "count(*) AS cases", *[f"{_sql(kind, value, where)} AS {k}" for k, (kind, _, value, _, where) in metrics.items()]]
    registry.query(f"{source[0]} SELECT {', '.join(columns)} FROM {source[1]}{' GROUP BY ' + ', '.join(by) if by else ''}")(run)


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "runtime_invocations")


_RUNS = ("", "runtime_invocations")
_any = lambda: F.lit(True)
_ok, _OK = (lambda: _c("status") == "ok"), "status = 'ok'"
_degraded, _DEGRADED = (lambda: F.size("degraded_reason_codes") > 0), "len(degraded_reason_codes) > 0"
_replay, _REPLAY = (lambda: _c("plan_replay_hit")), "plan_replay_hit"
_traced, _TRACED = (lambda: _c("trace_exported")), "trace_exported"
_ms, _MS = (lambda: _c("total_latency_ms")), "total_latency_ms"
_failed, _FAILED = (lambda: _c("status") != "ok"), "status <> 'ok'"
_code, _CODE = (lambda: _c("contract_error_code") != ""), "contract_error_code <> ''"

_add("slo_budget", _RUNS, _runs, [], {
    "downgraded": ("count", _degraded, _DEGRADED, _any, "true"),
    "downgrade_rate": ("rate", _degraded, _DEGRADED, _any, "true"),
    "over_budget_rate": ("rate", lambda: _c("total_latency_ms") > 1000, "total_latency_ms > 1000", lambda: _c("total_latency_ms").isNotNull(), "total_latency_ms IS NOT NULL"),
    "latency_p95": ("p95", _ms, _MS, _any, "true"),
}, "Signals of a downgrade, and latencies over budget among those that are known.")

_add("router_observability", _RUNS, _runs, ["event_class"], {
    "traced_rate": ("rate", _traced, _TRACED, _any, "true"),
    "replay_rate": ("rate", _replay, _REPLAY, _any, "true"),
    "replay_success_rate": ("rate", _ok, _OK, _replay, _REPLAY),
    "replay_latency_mean": ("mean", _ms, _MS, _replay, _REPLAY),
    "other_latency_mean": ("mean", _ms, _MS, lambda: ~_c("plan_replay_hit"), "NOT plan_replay_hit"),
}, "By class: what was traced and replayed, and of the replayed ones the success and latency.")

_add("failure_observability", _RUNS, _runs, ["profile_key"], {
    "failed": ("count", _failed, _FAILED, _any, "true"),
    "failure_rate": ("rate", _failed, _FAILED, _any, "true"),
    "coded_rate": ("rate", _code, _CODE, _failed, _FAILED),
    "degraded_failure_rate": ("rate", _degraded, _DEGRADED, _failed, _FAILED),
}, "By profile: failures, and of the failed ones those with a code and with a reason.")

_add("feedback_observability", _RUNS, _runs, ["repo_key"], {
    "observed": ("count", _traced, _TRACED, _any, "true"),
    "conversion_rate": ("rate", _ok, _OK, _traced, _TRACED),
    "seconds_mean": ("mean", lambda: F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6, 6), "round((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 6)", _ok, _OK),
    "reasons": ("sum", lambda: F.size("degraded_reason_codes").cast("double"), "CAST(len(degraded_reason_codes) AS DOUBLE)", _failed, _FAILED),
}, "By repository: what was observed, how much of it ended well and after what time, and the reasons of what didn't.")

_CHUNKS = (f"WITH {CHUNKS_SQL}", "chunks")
_role, _ROLE = (lambda: F.lower(F.trim("evidence.role"))), "lower(trim(evidence.role))"
_has, _HAS = (lambda: _c("evidence").isNotNull()), "evidence IS NOT NULL"
_sources, _SOURCES = (lambda: F.size("evidence.sources") > 0), "len(evidence.sources) > 0"
_lines, _LINES = (lambda: (_c("end_lineno") - _c("lineno") + 1).cast("double")), "CAST(end_lineno - lineno + 1 AS DOUBLE)"
_hint, _HINT = (lambda: _c("evidence.hint_support")), "evidence.hint_support"
_direct, _DIRECT = (lambda: _c("evidence.direct_retrieval")), "evidence.direct_retrieval"

_add("retrieval_context", _CHUNKS, chunks, ["plan_id"], {
    "with_evidence_rate": ("rate", _has, _HAS, _any, "true"),
    "sourced_rate": ("rate", _sources, _SOURCES, _has, _HAS),
    "direct_rate": ("rate", lambda: _role() == "direct", f"{_ROLE} = 'direct'", _has, _HAS),
    "lines": ("sum", _lines, _LINES, _any, "true"),
}, "By plan: coverage of the chunks by evidence, and of the evidence by sources and directness.")

_add("context_governance", _CHUNKS, chunks, [], {
    "contract_rate": ("rate", lambda: _c("kind").isNotNull() & (_c("qualified_name") != ""), "kind IS NOT NULL AND qualified_name <> ''", _any, "true"),
    "scored_rate": ("rate", lambda: _c("score").isNotNull(), "score IS NOT NULL", _any, "true"),
    "supported_rate": ("rate", _hint, _HINT, lambda: _role() == "hint_only", f"{_ROLE} = 'hint_only'"),
    "longest": ("most", _lines, _LINES, _any, "true"),
}, "Which chunks keep the contract of names, kinds and scores, and which hints are supported.")

_add("context_refine", _CHUNKS, chunks, ["kind"], {
    "kept_mean": ("mean", lambda: _c("score"), "score", lambda: _c("score") >= 2.5, "score >= 2.5"),
    "kept": ("count", _any, "true", lambda: _c("score") >= 2.5, "score >= 2.5"),
    "dropped_lines_mean": ("mean", _lines, _LINES, lambda: _c("score") < 2.5, "score < 2.5"),
    "direct_rate": ("rate", _direct, _DIRECT, lambda: _c("score") >= 2.5, "score >= 2.5"),
}, "By kind: the scores of what is kept, and the lines of what isn't.")

_add("chunk_cache_contract", _CHUNKS, chunks, [], {
    "present_rate": ("rate", lambda: _c("evidence.granularity").isNotNull(), "evidence.granularity IS NOT NULL", _any, "true"),
    "match_rate": ("rate", lambda: F.array_contains("evidence.granularity", "symbol"), "list_contains(evidence.granularity, 'symbol')", lambda: _c("evidence.granularity").isNotNull(), "evidence.granularity IS NOT NULL"),
    "present": ("count", lambda: _c("evidence.granularity").isNotNull(), "evidence.granularity IS NOT NULL", _any, "true"),
}, "In how many chunks a field is there, and in how many of those it matches.")


@registry.query("""WITH e AS (SELECT row_number() OVER () AS row, degraded_reason_codes AS codes, event_class, status FROM runtime_invocations), x AS (SELECT row, unnest(codes) AS reason, event_class FROM e)
  SELECT reason, event_class, n, rows, round(n / sum(n) OVER (), 6) AS share FROM (SELECT coalesce(reason, '(unknown)') AS reason, coalesce(event_class, '(unknown)') AS event_class, count(*) AS n, count(DISTINCT row) AS rows FROM x GROUP BY 1, 2)""")
def decision_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events by reason and class: how many, in how many cases, and their share."""
    r = _runs(spark, folder)
    return E.shares_of_events(r, F.transform("degraded_reason_codes", lambda c: F.struct(c.alias("reason"), F.col("event_class").alias("event_class"))), ["reason", "event_class"])


@registry.query(f"""WITH {CHUNKS_SQL}, x AS (SELECT plan_id, unnest(evidence.sources) AS source FROM chunks)
  SELECT coalesce(source, '(unknown)') AS source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM x GROUP BY 1""")
def source_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source stands in the evidence."""
    return E.shares_of_events(chunks(spark, folder), F.transform("evidence.sources", lambda s: F.struct(s.alias("source"))), ["source"]).select("source", "n", "share")


@registry.query("""SELECT coalesce(nullif(lower(trim(profile_key)), ''), '(unknown)') AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate, row_number() OVER (ORDER BY count(*) DESC, coalesce(nullif(lower(trim(profile_key)), ''), '(unknown)')) = 1 AS dominant FROM runtime_invocations GROUP BY 1""")
def default_strategy(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles in use, and which is used most."""
    value = F.coalesce(F.nullif(F.lower(F.trim("profile_key")), F.lit("")), F.lit("(unknown)"))
    return E.dominant(_runs(spark, folder).select(value.alias("profile")), "profile")


@registry.query("""SELECT CASE WHEN contract_error_code <> '' THEN 'coded' WHEN len(degraded_reason_codes) > 0 THEN 'degraded' WHEN status <> 'ok' THEN 'failed' ELSE 'none' END AS miss, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM runtime_invocations GROUP BY 1""")
def stage_misses(spark: SparkSession, folder: str) -> DataFrame:
    """What went wrong first: a histogram of classes."""
    from quillon.operators import telemetry as O

    kind = F.when(_code(), "coded").when(_degraded(), "degraded").when(_failed(), "failed").otherwise("none")
    return O.histogram(_runs(spark, folder).select(kind.alias("miss")), "miss").withColumnRenamed("value", "miss")


@registry.query("""WITH s AS (SELECT session_id, count(*) AS turns, count(*) FILTER (WHERE status = 'ok') AS ok FROM runtime_invocations WHERE session_id IS NOT NULL GROUP BY 1)
  SELECT least(turns, 10) AS turns, count(*) AS sessions, round(avg(ok / turns), 6) AS success FROM s GROUP BY 1""")
def loop_iterations(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by how often they called, ten standing for ten or more, with the mean share that went well."""
    s = _runs(spark, folder).where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count("*").alias("turns"), F.count_if(F.col("status") == "ok").alias("ok"))
    return s.groupBy(F.least("turns", F.lit(10)).alias("turns")).agg(F.count("*").alias("sessions"), F.round(F.avg(F.col("ok") / F.col("turns")), 6).alias("success"))


@registry.query("""WITH last AS (SELECT * FROM plan_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT')
  SELECT plan_id, source_file, json_extract_string(payload, '$.query') AS query, coalesce(json_extract_string(payload, '$._plan_timeout_fallback') = 'true', false) AS timed_out,
  CASE WHEN json_type(payload, '$.source_plan.candidate_files') = 'ARRAY' THEN json_array_length(payload, '$.source_plan.candidate_files') ELSE 0 END AS candidates FROM last""")
def case_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The row of a case, projected from its plan: query, whether it timed out, how many candidates it has."""
    from quillon.operators.nested import parsed

    p = parsed(load(spark, folder, "plan_records").select("plan_id", "source_file", "payload"), "payload")
    p = p.where(F.startswith(F.schema_of_variant("_doc"), F.lit("OBJECT")))
    get = lambda path, kind: F.try_variant_get("_doc", path, kind)
    files = get("$.source_plan.candidate_files", "array<variant>")
    return p.select("plan_id", "source_file", get("$.query", "string").alias("query"), F.coalesce(get("$._plan_timeout_fallback", "string") == "true", F.lit(False)).alias("timed_out"), F.coalesce(F.when(files.isNotNull(), F.size(files)), F.lit(0)).cast("bigint").alias("candidates"))
