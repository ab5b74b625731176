"""Queries over the sources and sinks: tables are written in a format from outside, read back by its source, and compared with SQL
over the tables themselves; and over operators that other queries only use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunks as C
from quillon.operators import graph as G
from quillon.operators import memory as M
from quillon.operators import planning as P
from quillon.operators import ranking as R
from quillon.operators import vector as V
from quillon.plans.adapters import CHUNKS_SQL, FILES_SQL, PARTS_SQL, TRADE_SQL, chunks, files, low, parts, trade, words_sql
from quillon.plans.registry import Registry
from quillon.session import shared_path
from quillon.sources import reports, sinks
from quillon.sources.tables import load

registry = Registry()


def _written(df: DataFrame, name: str, form: str = "json") -> str:
    path = shared_path(df.sparkSession, name)
    df.write.format(form).save(path)
    return path


# --- symbol indexes


def _index_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A symbol index in lines: one for each file of a plan, in which classes define and the rest refers."""
    roles = F.when(F.col("kind") == "class", 1).otherwise(8)
    rows = chunks(spark, folder).where(F.col("qualified_name") != "").groupBy("plan_id", "path").agg(F.collect_list(F.struct(F.col("qualified_name").alias("symbol"), roles.alias("symbol_roles"))).alias("occurrences"))
    return rows.select(F.array(F.struct(F.col("path").alias("relative_path"), "occurrences")).alias("documents"))


_SCIP_SQL = f"""WITH {CHUNKS_SQL}, occ AS (SELECT path, qualified_name AS s, coalesce(kind, '') = 'class' AS d FROM chunks WHERE qualified_name <> ''), defs AS (SELECT DISTINCT path, s FROM occ WHERE d)
  SELECT o.path AS src, f.path AS dst, CAST(count(*) AS DOUBLE) AS weight FROM occ o JOIN defs f USING (s) WHERE NOT o.d AND o.path <> f.path GROUP BY 1, 2"""


@registry.query(_SCIP_SQL)
def symbol_index_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of a symbol index that was written as JSON; its form is found by its fields."""
    return reports.load_symbol_index(spark, _written(_index_lines(spark, folder), "index"), lines=True)


@registry.query(f"WITH {TRADE_SQL} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, weight FROM edges")
def edge_list_index(spark: SparkSession, folder: str) -> DataFrame:
    """An edge list in JSON whose lines use either names of the ends."""
    _, edges = trade(spark, folder)
    s, d, w = F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight")
    a = edges.where("src % 2 = 0").select(F.array(F.struct(s.alias("source"), d.alias("target"), w.alias("weight"))).alias("edges"))
    b = edges.where("src % 2 = 1").select(F.array(F.struct(s.alias("from"), d.alias("to"), w.alias("weight"))).alias("edges"))
    path = _written(a, "edges")
    b.write.mode("append").json(path)
    return reports.load_symbol_index(spark, path, lines=True)


# --- test reports


def _suites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a partition, which becomes a file, inside a root element."""
    one = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], ["value"])
    yield one("<testsuites>")
    yield from batches
    yield one("</testsuites>")


@registry.query(f"""WITH {CHUNKS_SQL}, x AS (SELECT DISTINCT plan_id, path, qualified_name, lineno, kind = 'method' AS failed FROM chunks WHERE qualified_name <> '')
  SELECT path, CAST(lineno AS INT) AS line, count(*) AS n FROM x WHERE failed GROUP BY 1, 2""")
def junit_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Stack frames of failures in JUnit XML that was written from the chunks: one case for each, methods fail."""
    c = chunks(spark, folder).where(F.col("qualified_name") != "").select("plan_id", "path", "qualified_name", "lineno", F.coalesce(F.col("kind") == "method", F.lit(False)).alias("failed")).distinct()
    attr = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    trace = F.concat(F.lit('<failure message="'), attr(F.concat(F.lit('File "'), "path", F.lit('", line '), F.col("lineno").cast("string"))), F.lit('">boom</failure>'))
    line = F.concat(F.lit('<testcase classname="'), attr(F.col("qualified_name")), F.lit('" name="'), F.col("plan_id").cast("string"), F.lit('" file="'), attr(F.col("path")), F.lit('" line="'), F.col("lineno").cast("string"), F.lit('">'), F.when(F.col("failed"), trace).otherwise(F.lit("")), F.lit("</testcase>"))
    path = _written(c.select(line.alias("value")).mapInArrow(_suites, "value string"), "junit", "text")
    return reports.stack_frames(reports.junit(spark, path)).groupBy("path", "line").agg(F.count("*").alias("n"))


@registry.query(f"WITH {CHUNKS_SQL} SELECT qualified_name AS name, path, CAST(lineno AS INT) AS line FROM chunks WHERE kind = 'method'")
def failed_test_list(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).where(F.col("kind") == "method").groupBy("plan_id").agg(F.collect_list(F.struct(F.col("qualified_name").alias("name"), "path", F.col("lineno").alias("line"))).alias("failures"))
    return reports.failed_tests(spark, _written(c.select("failures"), "failed"), lines=True)


@registry.query(f"WITH {CHUNKS_SQL} SELECT DISTINCT path, CAST(lineno AS INT) AS line FROM chunks")
def coverage_lines(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).groupBy("plan_id", "path").agg(F.struct(F.collect_set("lineno").alias("executed_lines")).alias("f"))
    return reports.coverage(spark, _written(c.select(F.create_map("path", "f").alias("files")), "coverage"), lines=True)


@registry.query("""WITH s AS (SELECT event_type || '.py' AS path, CAST(user_id % 50 AS INT) AS line, CAST(count(*) FILTER (WHERE value > 60) AS DOUBLE) AS ef, CAST(count(*) FILTER (WHERE value <= 60) AS DOUBLE) AS ep, CAST(count(*) FILTER (WHERE value IS NULL) AS DOUBLE) + 3 AS nf FROM events GROUP BY 1, 2)
  SELECT path, line, round(CASE WHEN (ef + nf) * (ef + ep) > 0 THEN ef / sqrt((ef + nf) * (ef + ep)) ELSE 0 END, 6) AS score FROM s""")
def fault_score_report(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events")
    n = lambda c: F.count_if(c).cast("double")
    s = e.groupBy(F.concat("event_type", F.lit(".py")).alias("path"), (F.col("user_id") % 50).cast("int").alias("line")).agg(n(F.col("value") > 60).alias("ef"), n(F.col("value") <= 60).alias("ep"), (n(F.col("value").isNull()) + 3).alias("nf"))
    return reports.fault_scores(spark, _written(s, "faults"), lines=True)


@registry.query("SELECT event_type AS metric, sum(value) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1 HAVING sum(value) IS NOT NULL")
def baseline_report(spark: SparkSession, folder: str) -> DataFrame:
    m = load(spark, folder, "events").where(F.col("event_type").isNotNull()).groupBy("event_type").agg(F.sum("value").alias("v"))
    return reports.baseline_metrics(spark, _written(m.select(F.create_map("event_type", "v").alias("metrics")), "metrics"), lines=True)


# --- logs and mirrors


@registry.query("SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS query_id, event_type AS chosen_arm_id, value AS reward, ts AS observed_at FROM events")
def reward_log(spark: SparkSession, folder: str) -> DataFrame:
    """Rewards appended in two parts as JSON lines and read back."""
    e = load(spark, folder, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("query_id"), F.col("event_type").alias("chosen_arm_id"), F.col("value").alias("reward"), F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC").alias("observed_at"))
    path = shared_path(spark, "rewards")
    late = F.coalesce(F.pmod(F.xxhash64("event_id"), F.lit(2)) == 1, F.lit(False))
    sinks.append_log(e.where(~late), path)
    sinks.append_log(e.where(late), path)
    return reports.json_log(spark, path, reports.REWARDS).select("event_id", "query_id", "chosen_arm_id", "reward", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


@registry.query("SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS time_cost FROM events GROUP BY 1")
def friction_log(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("stage"), F.col("value").alias("time_cost_min"))
    path = shared_path(spark, "friction")
    sinks.append_log(e, path)
    return reports.json_log(spark, path, reports.FRICTION).groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("time_cost_min"), 4).alias("time_cost"))


@registry.query("SELECT CAST(doc_id AS VARCHAR) AS handle, text, [lang, source] AS keywords, repo FROM documents")
def note_log(spark: SparkSession, folder: str) -> DataFrame:
    d = load(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("handle"), "text", F.array("lang", "source").alias("keywords"), "repo")
    path = shared_path(spark, "notes")
    sinks.append_log(d, path)
    return reports.json_log(spark, path, reports.NOTES).select("handle", "text", "keywords", "repo")


@registry.query(f"WITH {FILES_SQL} SELECT path, module, tier, symbols, imports FROM files")
def index_table(spark: SparkSession, folder: str) -> DataFrame:
    """The index of files written whole, twice over the same path, and read back."""
    path = shared_path(spark, "files")
    f = files(spark, folder)
    sinks.write_table(f.limit(0), path)
    return spark.read.schema(f.schema).parquet(sinks.write_table(f, path))


@registry.query("SELECT doc_id, text, repo, true AS first, false AS again FROM documents")
def docs_mirror(spark: SparkSession, folder: str) -> DataFrame:
    """A mirror of the documents, written once: with the same mark it isn't written again."""
    d = load(spark, folder, "documents").select("doc_id", "text", "repo")
    path = shared_path(spark, "mirror")
    first, again = sinks.refresh_mirror(d, path, "mark", None), sinks.refresh_mirror(d.limit(0), path, "mark", "mark")
    return spark.read.parquet(path).select("doc_id", "text", "repo", F.lit(first).alias("first"), F.lit(again).alias("again"))


@registry.query("""WITH b AS (SELECT * FROM embedding_vectors WHERE batch_id = (SELECT max(batch_id) FROM embedding_vectors)),
  s AS (SELECT * FROM embedding_vectors WHERE batch_id <> (SELECT max(batch_id) FROM embedding_vectors))
  SELECT provider, model, dimension, count(*) AS n, count(DISTINCT path) AS paths, min(batch_id) AS first_batch FROM (
    SELECT provider, model, dimension, path, batch_id FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.provider = s.provider AND b.model = s.model AND b.dimension = s.dimension)
    UNION ALL SELECT DISTINCT provider, model, dimension, path, 'merged' FROM b) GROUP BY 1, 2, 3""")
def vector_mirror(spark: SparkSession, folder: str) -> DataFrame:
    """The last batch of vectors merged into the older ones; stale rows of its spaces go."""
    v = load(spark, folder, "embedding_vectors").select("provider", "model", "dimension", "path", "vector_json", "batch_id")
    last = v.agg(F.max("batch_id")).scalar()
    out = sinks.merge_vectors(v.where(F.col("batch_id") != last), v.where(F.col("batch_id") == last), "merged")
    return out.groupBy("provider", "model", "dimension").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.min("batch_id").alias("first_batch"))


@registry.query("SELECT fact_handle, max(observed_at) AS observed_at FROM memory_triples WHERE fact_handle IS NOT NULL AND observed_at IS NOT NULL GROUP BY 1")
def fact_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Two sides' facts merged: the newer one of each handle."""
    t = load(spark, folder, "memory_triples").where(F.col("fact_handle").isNotNull() & F.col("observed_at").isNotNull()).select("fact_handle", "subject", "object_value", "observed_at")
    mine = F.coalesce(F.pmod(F.xxhash64("subject", "object_value"), F.lit(2)) == 0, F.lit(False))
    return sinks.merge_facts(t.where(mine), t.where(~mine), "fact_handle", "observed_at").select("fact_handle", "observed_at")


@registry.query("""WITH s AS (SELECT user_id AS trace_id, event_type AS stage, event_id AS place, value AS ms FROM events WHERE value IS NOT NULL),
  x AS (SELECT *, coalesce(sum(ms) OVER (PARTITION BY trace_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
  SELECT CAST(trace_id AS VARCHAR) AS trace_id, substr(sha256(CAST(trace_id AS VARCHAR) || ':' || stage || ':' || CAST(place AS VARCHAR)), 1, 16) AS span_id, stage AS name, round(before, 2) AS start_ms FROM x""")
def trace_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of the stages of each trace, written as JSON lines and read back."""
    e = load(spark, folder, "events").where(F.col("value").isNotNull()).select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("place"), F.col("value").alias("elapsed_ms"), F.lit("1970-01-01T00:00:00Z").cast("timestamp").alias("started_at"))
    path = shared_path(spark, "spans")
    sinks.append_log(sinks.spans(e), path)
    out = spark.read.schema("trace_id string, span_id string, name string, start_us bigint, end_us bigint").json(path)
    return out.select("trace_id", "span_id", "name", F.round(F.col("start_us") / 1000, 2).alias("start_ms"))


@registry.query("SELECT event_type AS case_id, count(*) AS n, true AS written FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics and case rows of an evaluation written as JSON and read back."""
    cases = load(spark, folder, "events").where(F.col("event_type").isNotNull()).groupBy(F.col("event_type").alias("case_id")).agg(F.count("*").alias("n"))
    paths = sinks.write_results(cases.agg(F.sum("n").alias("total")), cases, shared_path(spark, "results"))
    total = spark.read.schema("total bigint").json(paths["metrics"]).agg(F.max("total")).scalar()
    back = spark.read.schema("case_id string, n bigint").json(paths["cases"])
    return back.select("case_id", "n", (F.coalesce(total, F.lit(0)) == cases.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()).alias("written"))


@registry.query("""SELECT o_orderkey AS commit_id, list_sort(list(DISTINCT l_partkey)) AS files FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50) JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def commit_log(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 50 commits (orders) with their files (parts); the limit is the feature."""
    li = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("commit_id")).agg(F.collect_list("l_partkey").alias("files"))
    o = load(spark, folder, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"))
    return reports.commits(li.join(o, "commit_id"), 50).select("commit_id", "files")


@registry.query("SELECT count(*) AS files, sum(l_linenumber) AS additions, CAST(sum(l_quantity) AS BIGINT) AS deletions, count(*) FILTER (WHERE l_returnflag = 'N') AS untracked FROM lineitem")
def worktree_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "lineitem").select(F.when(F.col("l_returnflag") == "N", "??").otherwise(F.col("l_returnflag")).alias("status"), F.col("l_linenumber").cast("bigint").alias("adds"), F.col("l_quantity").cast("bigint").alias("dels"))
    return reports.worktree(rows)


@registry.query("SELECT repo_key AS name, repo_key AS root, coalesce(main_language, '') AS description, [coalesce(tier, '')] AS tags, CAST(file_count AS DOUBLE) AS weight FROM repositories WHERE repo_key IS NOT NULL AND file_count > 0")
def workspace_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The repositories, of which there are as many at every scale, as a workspace's manifest."""
    rows = load(spark, folder, "repositories").where(F.col("repo_key").isNotNull() & (F.col("file_count") > 0)).collect()
    repos = [{"name": r.repo_key, "root": r.repo_key, "description": r.main_language, "tags": [r.tier or ""], "weight": r.file_count} for r in rows]
    return reports.workspace(spark, {"repos": repos})


@registry.query("SELECT repo_key AS name, [coalesce(nullif(tier, ''), 'none'), 'any'] AS intents, 'about ' || repo_key AS description, CAST(coalesce(file_count, 0) AS INT) AS priority FROM repositories WHERE repo_key <> ''")
def skill_files(spark: SparkSession, folder: str) -> DataFrame:
    """Skill files with front matter, one for each repository, of which there are as many at every scale."""
    r = load(spark, folder, "repositories").where(F.col("repo_key") != "")
    body = F.concat(F.lit("---\nname: "), "repo_key", F.lit("\nintents: ["), F.coalesce(F.nullif("tier", F.lit("")), F.lit("none")), F.lit(", any]\ndescription: about "), "repo_key", F.lit("\npriority: "), F.coalesce("file_count", F.lit(0)).cast("string"), F.lit("\n---\nText of the skill.\n"))
    path = shared_path(spark, "skills")
    r.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return reports.front_matter(spark, path).select("name", "intents", "description", "priority")


# --- operators that other queries only use


@registry.query(f"WITH {FILES_SQL}, s AS (SELECT path, unnest(symbols) AS x FROM files) SELECT path, max(CASE WHEN {low('x')} = 'table' THEN 2.0 WHEN contains({low('x')}, 'table') THEN 1.0 ELSE 0.0 END) AS symbol FROM s GROUP BY 1")
def symbol_match(spark: SparkSession, folder: str) -> DataFrame:
    """The best of a file's symbols for a term."""
    return R.symbol_score(files(spark, folder), ["table"])


@registry.query("SELECT p_partkey, round(CASE WHEN p_size - 25 <= 0 THEN abs(p_size - 25) + 1.0 ELSE 1.0 / (1.0 + p_size - 25) END, 6) AS score FROM part")
def text_rank_scores(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "part").select("p_partkey", F.round(P.text_score((F.col("p_size") - 25).cast("double")), 6).alias("score"))


@registry.query(f"WITH {TRADE_SQL}, near AS (SELECT DISTINCT src AS node FROM edges WHERE dst IN (1, 2) AND src NOT IN (1, 2)) SELECT node, 1.0 AS prior FROM nodes WHERE node IN (1, 2) UNION ALL SELECT node, 0.5 FROM near")
def worktree_priors(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = trade(spark, folder)
    return P.worktree_prior(nodes.where(F.col("node").isin(1, 2)), edges, 1000)


@registry.query("""WITH t AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL), m AS (SELECT path, regexp_matches(path, '(^|[^a-zA-Z])([pP]arser|PARSER)([^a-zA-Z]|$)') AS ok FROM t)
  SELECT path FROM m WHERE ok OR (NOT (SELECT max(ok) FROM m) AND path = (SELECT min(path) FROM m))""")
def worktree_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Changed paths that share a token with the query; as no path is in camel case, a token is a run of letters."""
    t = load(spark, folder, "documents").where(F.col("path").isNotNull()).select("path").distinct()
    return P.query_guard(t, "path", ["parser"])


@registry.query(f"WITH {CHUNKS_SQL} SELECT DISTINCT qualified_name, string_split(qualified_name, '.')[-1] AS family, greatest(12, len(list_filter(regexp_split_to_array(trim(path || ' ' || qualified_name || ' ' || coalesce(kind, '') || ' '), '\\s+'), lambda x: x <> '')) + 8) AS tokens FROM chunks")
def chunk_families(spark: SparkSession, folder: str) -> DataFrame:
    """The family of a chunk's name and the tokens it takes."""
    c = chunks(spark, folder)
    return c.select("qualified_name", C.family(F.col("qualified_name")).alias("family"), C.chunk_tokens(F.col("path"), F.col("qualified_name"), F.col("kind"), F.lit("")).alias("tokens")).distinct()


@registry.query(f"WITH {CHUNKS_SQL} SELECT CASE WHEN kind <> '' THEN 'signature' ELSE 'refs' END AS shown, CASE WHEN kind <> '' THEN 'not_available' ELSE 'not_available' END AS reason, count(*) AS n, sum(end_lineno - lineno + 1) AS lines FROM chunks GROUP BY 1, 2")
def chunk_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    """What is shown of chunks that have no snippet, and the lines of their skeletons."""
    c = chunks(spark, folder)
    shown, why = P.disclosure("snippet", F.lit(False), F.coalesce(F.col("kind") != "", F.lit(False)))
    rows = P.skeletons(c.withColumn("path", F.concat_ws("\t", shown, why))).select(F.split("path", "\t")[0].alias("shown"), F.split("path", "\t")[1].alias("reason"), "skeleton.lines")
    return rows.groupBy("shown", "reason").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))


@registry.query(f"WITH {CHUNKS_SQL} SELECT plan_id, path, qualified_name, lineno, round(coalesce(score, 0) - CASE WHEN coalesce(evidence.hint_support, false) THEN 0.5 * coalesce(score, 0) ELSE 0 END, 6) AS penalty FROM chunks")
def shielded_penalties(spark: SparkSession, folder: str) -> DataFrame:
    """The penalty of chunks that are linked counts by half where the shield is enforced."""
    c = chunks(spark, folder)
    penalty, _ = P.shielded(F.coalesce("score", F.lit(0.0)), F.coalesce("evidence.hint_support", F.lit(False)), enforce=True)
    return c.select("plan_id", "path", "qualified_name", "lineno", F.round(penalty, 6).alias("penalty"))


@registry.query(f"""WITH {TRADE_SQL}, near AS (SELECT dst AS node, sum(weight) AS w FROM edges WHERE src IN (1, 2) AND dst NOT IN (1, 2) GROUP BY 1 ORDER BY w DESC, node LIMIT 5),
  r AS (SELECT node, 2 AS r, CAST(node AS DOUBLE) AS w FROM nodes WHERE node NOT IN (1, 2) AND node NOT IN (SELECT node FROM near)),
  u AS (SELECT node, 0 AS r, 0.0 AS w FROM nodes WHERE node IN (1, 2) UNION ALL SELECT node, 1, w FROM near UNION ALL SELECT * FROM r)
  SELECT node, ['seed', 'neighbour', 'ranked'][r + 1] AS reason, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (ORDER BY r, w DESC, node) AS place FROM u) WHERE place <= 12""")
def stage_repo_map(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds, their best connected neighbours, then ranked nodes: twelve in all, which is the feature."""
    nodes, edges = trade(spark, folder)
    return P.stage_map(nodes.withColumn("score", F.col("node").cast("double")), nodes.where(F.col("node").isin(1, 2)), edges, "node", 12, 5)


@registry.query(f"WITH {TRADE_SQL}, d AS (SELECT dst AS node, count(*) AS d FROM edges GROUP BY 1) SELECT n.node, round(n.node + CASE WHEN n.node IN (1, 2) THEN 0.12 ELSE 0 END + least(0.08, coalesce(d, 0) * 0.01), 6) AS score FROM nodes n LEFT JOIN d USING (node)")
def seeded_ranks(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = trade(spark, folder)
    return P.seeded_rank(nodes.withColumn("score", F.col("node").cast("double")), nodes.where(F.col("node").isin(1, 2)), edges, "node")


@registry.query(f"""WITH {PARTS_SQL}, a AS (SELECT p_partkey, row_number() OVER (ORDER BY price DESC, p_partkey) AS rank FROM parts), b AS (SELECT p_partkey, row_number() OVER (ORDER BY qty DESC, p_partkey) AS rank FROM parts),
  f AS (SELECT p_partkey, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a WHERE rank <= 30 UNION ALL SELECT * FROM b WHERE rank <= 30) GROUP BY 1) SELECT p_partkey, score FROM f ORDER BY score DESC, p_partkey LIMIT 30""")
def fused_searches(spark: SparkSession, folder: str) -> DataFrame:
    """Two searches fused by rank, the first 30; the second is asked only if the first fails or is empty."""
    p = parts(spark, folder)
    semantic, _ = P.with_fallback(lambda: p.select("p_partkey", F.col("price").alias("score")), lambda: p.limit(0).select("p_partkey", F.col("price").alias("score")))
    return P.fused_memories(semantic, p.select("p_partkey", F.col("qty").cast("double").alias("score")), "p_partkey", 30)


_DAYS = "(epoch_us(TIMESTAMP '2026-01-01') - epoch_us(captured_at)) / 86400e6"


@registry.query(f"SELECT count(*) FILTER (WHERE NOT coalesce({_DAYS} > 200, false) AND NOT coalesce({_DAYS} > 400, false)) AS kept, count(*) FILTER (WHERE coalesce({_DAYS} > 200, false)) AS unseen, count(*) FILTER (WHERE NOT coalesce({_DAYS} > 200, false) AND coalesce({_DAYS} > 400, false)) AS aged FROM documents")
def profile_vacuum(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("captured_at")
    return P.vacuum(load(spark, folder, "documents"), t, t, "2026-01-01T00:00:00Z", 200, 400)


@registry.query("SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, lang AS language, n_chars > 500 AS is_long FROM documents WHERE n_chars IS NOT NULL")
def hit_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """What a hit's score is made of."""
    d = load(spark, folder, "documents").where(F.col("n_chars").isNotNull()).withColumn("score", F.col("n_chars").cast("double"))
    return M.explain(d, "doc_id", {"language": F.col("lang"), "is_long": F.col("n_chars") > 500}).select("doc_id", "score", "attribution.*")


@registry.query("""WITH keyed AS (SELECT fact_handle, min(fact_handle) OVER () AS first, max(fact_handle) OVER () AS last FROM memory_triples)
  SELECT fact_handle, CAST(CASE WHEN fact_handle = last THEN 0 ELSE 1 END AS INT) AS place, count(*) AS n FROM keyed WHERE fact_handle IN (first, last) AND first <> last GROUP BY 1, 2""")
def fetched_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts of two handles, with their places in the request."""
    t = load(spark, folder, "memory_triples")
    ends = t.agg(F.min("fact_handle").alias("a"), F.max("fact_handle").alias("b")).first()
    return M.fetch(t, "fact_handle", [h for h in (ends.b, ends.a) if h is not None]).groupBy("fact_handle", "place").agg(F.count("*").alias("n"))


@registry.query("SELECT count(*) AS imported, 0 AS known, count(*) FILTER (WHERE false) AS invalid FROM (SELECT DISTINCT event_id FROM events WHERE event_type = 'click' AND event_id IS NOT NULL)")
def replayed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks recorded again into a log of all other events."""
    e = load(spark, folder, "events").select("event_id", "event_type", "value")
    _, counts = P.replay(e.where(F.col("event_type") != "click"), e.where((F.col("event_type") == "click") & F.col("event_id").isNotNull()), "event_id", F.lit(True))
    return counts.select("imported", F.col("known").cast("int").alias("known"), "invalid")


@registry.query("SELECT (SELECT count(*) FROM events) AS events_n, (SELECT max(value) FROM events) AS events_top, (SELECT count(*) FROM documents) AS documents_n")
def observation_overview(spark: SparkSession, folder: str) -> DataFrame:
    e, d = load(spark, folder, "events"), load(spark, folder, "documents")
    return P.overview(events=e.agg(F.count("*").alias("n"), F.max("value").alias("top")), documents=d.agg(F.count("*").alias("n")))


@registry.query("SELECT 'issue-' || CAST(doc_id AS VARCHAR) AS case_id, text AS query, [path] AS expected, CAST(8 AS INT) AS top_k, 'issue_report' AS lane FROM documents WHERE trim(coalesce(text, '')) <> '' AND trim(coalesce(path, '')) <> ''")
def cases_of_issues(spark: SparkSession, folder: str) -> DataFrame:
    d = load(spark, folder, "documents")
    return P.issue_cases(d.select(F.col("doc_id").cast("string").alias("issue_id"), F.col("text").alias("query"), F.col("path").alias("selected_path")))


@registry.query("SELECT invocation_id, started_at, finished_at, round(coalesce(greatest(0, (epoch_us(finished_at) - epoch_us(started_at)) / 3600e6), 0) * 3600, 6) AS seconds FROM runtime_invocations")
def invocation_hours(spark: SparkSession, folder: str) -> DataFrame:
    r = load(spark, folder, "runtime_invocations")
    return r.select("invocation_id", "started_at", "finished_at", F.round(T.hours_between(F.col("started_at"), F.col("finished_at")) * 3600, 6).alias("seconds"))


@registry.query("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '') || '::' || '{}') AS handle FROM documents")
def text_handles(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", T.stable_handle(F.col("text"), F.lit(None).cast("string")).alias("handle"))


@registry.query(f"""SELECT doc_id, CASE WHEN length(trim({low('text')})) >= 4 THEN list_filter(['cache', 'index', 'token'], lambda k: contains({low('text')}, k)) ELSE [] END AS keywords,
  regexp_matches({low('text')}, '(^|[^a-z0-9_])cache([^a-z0-9_]|$)') AS marked FROM documents""")
def text_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords that a text contains, and whether one stands in it as a word."""
    t = F.col("text")
    return load(spark, folder, "documents").select("doc_id", T.found_keywords(t, ["cache", "index", "token"]).alias("keywords"), T.contains_marker(t, "cache").alias("marked"))


@registry.query("SELECT p_partkey, round(least(1, p_retailprice / (SELECT max(p_retailprice) FROM part)), 6) AS linear, round(ln(1 + p_size) / ln(1 + (SELECT max(p_size) FROM part)), 6) AS logarithmic FROM part")
def normalised_signals(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "part")
    p = p.withColumns({"_a": p.agg(F.max("p_retailprice")).scalar(), "_b": p.agg(F.max("p_size")).scalar()})
    d = lambda c: F.col(c).cast("double")
    return p.select("p_partkey", F.round(T.signal(d("p_retailprice"), d("_a")), 6).alias("linear"), F.round(T.signal(d("p_size"), d("_b"), True), 6).alias("logarithmic"))


@registry.query(f"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(translate({low('path')}, '/.', '  '), '\\s+'), lambda x: x <> ''))) AS parts, list_sort(list_distinct({words_sql('path')})) AS words FROM documents")
def path_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of evaluation and of memories."""
    p = F.col("path")
    return load(spark, folder, "documents").select("doc_id", F.array_sort(T.path_words(p)).alias("parts"), F.array_sort(T.word_set(p)).alias("words"))


@registry.query("""WITH s AS (SELECT p_partkey, p_retailprice AS score, CASE WHEN contains(p_name, 'a') THEN 1.0 ELSE 0.0 END AS sim FROM part), h AS (SELECT * FROM s ORDER BY score DESC, p_partkey LIMIT 40)
  SELECT p_partkey, round(0.7 * (score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0) + 0.3 * CASE WHEN max(sim) OVER () = min(sim) OVER () THEN CASE WHEN max(sim) OVER () > 0 THEN 1 ELSE 0 END ELSE (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) END, 6) AS score FROM h""")
def scorer_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The head of 40, which is the feature, reranked by a scorer of names."""
    p = load(spark, folder, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("score"), "p_name")
    out = V.rerank_with_scorer(p, "p_partkey", lambda c: F.when(F.contains(c, F.lit("a")), 1.0).otherwise(0.0), "p_name", 40)
    return out.where(F.col("in_pool") == 1).select("p_partkey", F.round("score", 6).alias("score"))


@registry.query("""WITH now AS (SELECT path, max(sha256) AS sha256 FROM embedding_vectors WHERE path IS NOT NULL AND sha256 IS NOT NULL GROUP BY 1), stored AS (SELECT path, min(sha256) AS sha256 FROM embedding_vectors WHERE path IS NOT NULL AND sha256 IS NOT NULL GROUP BY 1)
  SELECT path, sha256, sha256 IN (SELECT s.sha256 FROM stored s WHERE s.path = now.path) AS kept FROM now""")
def refreshed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors brought up to date: those of changed content are made anew."""
    v = load(spark, folder, "embedding_vectors").where(F.col("path").isNotNull() & F.col("sha256").isNotNull())
    now = v.groupBy("path").agg(F.max("sha256").alias("sha256")).withColumn("text", F.col("path"))
    stored = v.groupBy("path").agg(F.min("sha256").alias("sha256")).withColumn("vector", F.lit(True))
    return V.refresh_vectors(now, stored, lambda d: d.withColumn("vector", F.lit(False))).select("path", "sha256", F.col("vector").alias("kept"))


def _triples(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    from quillon.functions.times import parse_micros

    return load(spark, folder, "memory_triples"), parse_micros(F.lit("2024-06-01T00:00:00Z"))


@registry.query(f"""WITH tok AS (SELECT fact_handle, subject, list_distinct({words_sql("coalesce(subject, '') || ' ' || coalesce(predicate, '')")}) AS t FROM memory_triples WHERE namespace = 'repo')
  SELECT subject, count(*) AS n FROM tok WHERE len(list_intersect(t, ['ranker', 'cache', 'owner'])) > 0 GROUP BY 1""")
def fact_search(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of a scope that mention a term, by subject."""
    t, _ = _triples(spark, folder)
    words = T.word_set(F.concat_ws(" ", T.text("subject"), T.text("predicate")))
    hits = M.scope(t, "", "repo").where(F.col("scope") == "namespace").where(F.arrays_overlap(words, F.array(F.lit("ranker"), F.lit("cache"), F.lit("owner"))))
    return hits.groupBy("subject").agg(F.count("*").alias("n"))


@registry.query(f"WITH {TRADE_SQL} SELECT src, dst, round(weight, 4) AS weight FROM edges WHERE src IN (SELECT node FROM nodes WHERE node < 5)")
def graph_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The edges out of some seeds, through the adjacency with as many targets as there are."""
    nodes, edges = trade(spark, folder)
    return G.adjacency(edges.join(nodes.where(F.col("node") < 5).select(F.col("node").alias("src")), "src", "left_semi"), 1000).select("src", "dst", F.round("weight", 4).alias("weight"))
