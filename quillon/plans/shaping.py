"""Queries over nested records, drifting schemas and changing attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import drift, history, nested
from quillon.plans.adapters import micros_sql as _micros
from quillon.plans.registry import Registry
from quillon.sources.tables import load

registry = Registry()

P1_SQL = """
WITH docs AS (
  SELECT plan_id, CAST(payload AS JSON) AS d FROM plan_records
  WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'
), steps AS (
  SELECT plan_id, unnest(CASE json_type(d, '$.source_plan.steps')
           WHEN 'ARRAY' THEN CAST(json_extract(d, '$.source_plan.steps') AS JSON[])
           WHEN 'OBJECT' THEN [json_extract(d, '$.source_plan.steps')] ELSE CAST([] AS JSON[]) END) AS e,
         generate_subscripts(CASE json_type(d, '$.source_plan.steps')
           WHEN 'ARRAY' THEN CAST(json_extract(d, '$.source_plan.steps') AS JSON[])
           WHEN 'OBJECT' THEN [json_extract(d, '$.source_plan.steps')] ELSE CAST([] AS JSON[]) END, 1) - 1 AS pos
  FROM docs
), files AS (
  SELECT plan_id, unnest(CAST(json_extract(d, '$.source_plan.candidate_files') AS JSON[])) AS e,
         generate_subscripts(CAST(json_extract(d, '$.source_plan.candidate_files') AS JSON[]), 1) - 1 AS pos
  FROM docs WHERE json_type(d, '$.source_plan.candidate_files') = 'ARRAY'
), chunks AS (
  SELECT plan_id, unnest(candidate_chunks) AS e, generate_subscripts(candidate_chunks, 1) - 1 AS pos FROM evidence_plans
), found AS (
  SELECT plan_id, 'step' AS child_kind, pos, 0 AS sub_pos, json_extract_string(e, '$.file') AS child_value
  FROM steps WHERE json_type(e, '$.file') = 'VARCHAR'
  UNION ALL
  SELECT plan_id, 'candidate_file', pos, 0, CASE WHEN json_type(e) = 'VARCHAR' THEN e ->> '$' ELSE json_extract_string(e, '$.path') END
  FROM files WHERE json_type(e) = 'VARCHAR' OR json_type(e, '$.path') = 'VARCHAR'
  UNION ALL
  SELECT plan_id, 'candidate_file', pos, 0, e.path
  FROM (SELECT plan_id, unnest(candidate_files) AS e, generate_subscripts(candidate_files, 1) - 1 AS pos FROM evidence_plans)
  UNION ALL
  SELECT plan_id, 'source', pos, sub_pos, s
  FROM (SELECT plan_id, pos, unnest(e.evidence.sources) AS s, generate_subscripts(e.evidence.sources, 1) - 1 AS sub_pos FROM chunks)
)
SELECT DISTINCT plan_id, child_kind, CAST(pos AS INT) AS pos, CAST(sub_pos AS INT) AS sub_pos, child_value
FROM found WHERE child_value <> ''
"""


@registry.query(P1_SQL)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Children of plans with their places, through the flattened tables."""
    return nested.plan_children(load(spark, folder, "plan_records"), load(spark, folder, "evidence_plans"))


@registry.query()
def p1_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The child table of candidate_chunks with its link columns."""
    tables = nested.flatten_columns(load(spark, folder, "evidence_plans"), ["candidate_chunks"], ["plan_id"])
    return tables.table("candidate_chunks[]").select("_root.plan_id", "_parent", "_key", "_pos", "value.*")


@registry.query("""
WITH c AS (SELECT DISTINCT plan_id, candidate_chunks, candidate_files FROM evidence_plans), chunk AS (
  SELECT rid, pos, e FROM (SELECT row_number() OVER () AS rid, unnest(candidate_chunks) AS e, generate_subscripts(candidate_chunks, 1) - 1 AS pos FROM c)
  WHERE e IS NOT NULL
), source AS (SELECT rid, pos, unnest(e.evidence.sources) AS s FROM chunk)
SELECT 'candidate_chunks[]' AS child, count(*) AS rows, (SELECT count(*) FROM c WHERE len(list_filter(candidate_chunks, lambda x: x IS NOT NULL)) > 0) AS parents, 0 AS orphans FROM chunk
UNION ALL SELECT 'candidate_chunks[].evidence.sources[]', count(*) FILTER (WHERE s IS NOT NULL), (SELECT count(*) FROM chunk WHERE len(list_filter(e.evidence.sources, lambda x: x IS NOT NULL)) > 0), 0 FROM source
UNION ALL SELECT 'candidate_files[]', coalesce(sum(len(list_filter(candidate_files, lambda x: x IS NOT NULL))), 0)::BIGINT, count(*) FILTER (WHERE len(list_filter(candidate_files, lambda x: x IS NOT NULL)) > 0), 0 FROM c
""")
def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """Of each child table of evidence_plans the rows, the distinct parents, and the rows whose parent isn't there."""
    tables = nested.flatten_columns(load(spark, folder, "evidence_plans"), ["candidate_chunks", "candidate_files"], ["plan_id"])
    out = None
    for child, above in (("candidate_chunks[]", ""), ("candidate_chunks[].evidence.sources[]", "candidate_chunks[]"), ("candidate_files[]", "")):
        keys = tables.table(above).select(F.col("_key").alias("_parent"), F.lit(1).alias("known"))
        rows = tables.table(child).join(keys, "_parent", "left")
        one = rows.agg(F.lit(child).alias("child"), F.count("*").alias("rows"), F.count_distinct("_parent").alias("parents"), F.count_if(F.col("known").isNull()).cast("int").alias("orphans"))
        out = one if out is None else out.unionByName(one)
    return out


@registry.query("SELECT plan_id, source_file, CASE WHEN payload IS NULL THEN 'null' WHEN NOT json_valid(payload) THEN 'unreadable' ELSE 'not an object' END AS reason FROM plan_records WHERE payload IS NULL OR NOT json_valid(payload) OR json_type(payload) <> 'OBJECT'")
def p1_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads that give no rows, with the reason."""
    return nested.rejected(load(spark, folder, "plan_records"), "payload", ["plan_id", "source_file"])


@registry.query()
def p1_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The child table of source_plan.steps with its link columns and typed branches."""
    tables = nested.flatten_json(load(spark, folder, "plan_records"), "payload", ["plan_id", "source_file"])
    return tables.table("source_plan.steps[]").select("_root.plan_id", "_root.source_file", "_parent", "_key", "_pos", "value.*")


@registry.query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of layout between a producer's successive files."""
    return drift.file_changes(load(spark, folder, "plan_records"))


@registry.query()
def p2_table(spark: SparkSession, folder: str) -> DataFrame:
    """All payloads as one table of constant columns with typed branches."""
    return drift.union_table(load(spark, folder, "plan_records"), "payload", ["plan_id", "source_file"])


@registry.query()
def p2_alternatives(spark: SparkSession, folder: str) -> DataFrame:
    """The types each path takes with a producer, and since which file."""
    return drift.alternatives(load(spark, folder, "plan_records"))


P5_SQL = f"""
WITH read AS (
  SELECT subject, predicate, coalesce({_micros("valid_from")}, {_micros("as_of")}) AS start,
         coalesce({_micros("observed_at")}, -1) AS observed, coalesce({_micros("valid_to")}, -1) AS stop, object_value
  FROM memory_triples
), won AS (
  SELECT * FROM read WHERE start IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY subject, predicate, start ORDER BY observed DESC, stop DESC, object_value DESC) = 1
), held AS (
  SELECT *, least(coalesce(lead(start) OVER w, 9000000000000000000), CASE WHEN stop > start THEN stop ELSE 9000000000000000000 END) AS until
  FROM won WINDOW w AS (PARTITION BY subject, predicate ORDER BY start)
), cut AS (
  SELECT *, CASE WHEN lag(until) OVER w = start AND lag(object_value) OVER w = object_value THEN 0 ELSE 1 END AS fresh
  FROM held WINDOW w AS (PARTITION BY subject, predicate ORDER BY start)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY subject, predicate ORDER BY start ROWS UNBOUNDED PRECEDING) AS version FROM cut
), merged AS (
  SELECT subject, predicate, version, min(start) AS start, max(until) AS until, min(object_value) AS object_value
  FROM numbered GROUP BY subject, predicate, version
)
SELECT subject, predicate, strftime(make_timestamp(start), '%Y-%m-%dT%H:%M:%SZ') AS valid_from,
       CASE WHEN until = 9000000000000000000 THEN '' ELSE strftime(make_timestamp(until), '%Y-%m-%dT%H:%M:%SZ') END AS valid_to, object_value
FROM merged
"""


@registry.query(P5_SQL)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of each subject and predicate with their periods."""
    return history.statement_history(load(spark, folder, "memory_triples"))


P5_LOG_SQL = f"""
WITH read AS (
  SELECT subject, predicate, coalesce({_micros("valid_from")}, {_micros("as_of")}) AS start,
         coalesce({_micros("observed_at")}, -1) AS observed, coalesce({_micros("valid_to")}, -1) AS stop, object_value
  FROM memory_triples
), cut AS (SELECT max(observed) // 86400000000 * 86400000000 AS day FROM read
), before AS (
  SELECT read.* FROM read, cut WHERE start IS NOT NULL AND observed < cut.day
  QUALIFY row_number() OVER (PARTITION BY subject, predicate, start ORDER BY observed DESC, stop DESC, object_value DESC) = 1
), after AS (
  SELECT * FROM read WHERE start IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY subject, predicate, start ORDER BY observed DESC, stop DESC, object_value DESC) = 1
)
SELECT subject, predicate, start, 1 AS snapshot, object_value FROM before
UNION ALL SELECT a.subject, a.predicate, a.start, 2, a.object_value FROM after a ANTI JOIN before b ON a.subject IS NOT DISTINCT FROM b.subject
  AND a.predicate IS NOT DISTINCT FROM b.predicate AND a.start = b.start AND a.observed = b.observed AND a.stop = b.stop AND a.object_value IS NOT DISTINCT FROM b.object_value
"""


@registry.query(P5_LOG_SQL)
def p5_log(spark: SparkSession, folder: str) -> DataFrame:
    """The statements that each snapshot appended, found by comparing Merkle trees."""
    log = history.statement_log(load(spark, folder, "memory_triples"))
    return log.select("subject", "predicate", "start", "snapshot", F.col("state.object_value").alias("object_value"))
