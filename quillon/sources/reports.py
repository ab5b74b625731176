"""Reports and logs: symbol indexes, test reports, coverage, fault localisation, event logs, manifests, version history."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.chunks import sbfl

DEFINITION_BITS = 0x1 | 0x40

_SCIP = "documents array<struct<relative_path:string,symbols:array<struct<symbol:string>>,occurrences:array<struct<symbol:string,symbol_roles:int>>>>"


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """Files of one JSON document each, or with ``lines`` of one on each line, as shards of a report are best written."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def scip_edges(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """src, dst, weight of a symbol index in JSON: files that use a symbol to files that define it (role bits 0x1 and 0x40),
    counted; no loops."""
    docs = _json(spark, path, _SCIP, lines).select(F.explode("documents").alias("d"))
    uses = docs.select(F.col("d.relative_path").alias("path"), F.explode("d.occurrences").alias("o")).select("path", "o.symbol", (F.coalesce("o.symbol_roles", F.lit(0)).bitwiseAND(DEFINITION_BITS) != 0).alias("defines"))
    defs = uses.where("defines").select("symbol", F.col("path").alias("dst")).distinct()
    return uses.where(~F.col("defines")).join(defs, "symbol").where(F.col("path") != F.col("dst")).groupBy(F.col("path").alias("src"), "dst").agg(F.count("*").cast("double").alias("weight"))


def edge_list(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """src, dst, weight of the plain edge-list forms: ``edges`` of objects with source or from, target or to, and weight."""
    raw = _json(spark, path, "edges array<struct<source:string,from:string,target:string,to:string,weight:double>>", lines)
    e = raw.select(F.explode("edges").alias("e"))
    out = e.select(F.coalesce("e.source", "e.from").alias("src"), F.coalesce("e.target", "e.to").alias("dst"), F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
    return out.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))


def load_symbol_index(spark: SparkSession, path: str, provider: str = "auto", lines: bool = False) -> DataFrame:
    """Edges of a symbol index; ``auto`` looks which top-level field the file has."""
    if provider == "auto":
        fields = spark.read.option("multiLine", not lines).json(path).columns
        provider = "scip" if "documents" in fields else "edges"
    return scip_edges(spark, path, lines) if provider == "scip" else edge_list(spark, path, lines)


_CASE = "_classname string, _name string, _file string, _line int, failure struct<_message:string,_VALUE:string>, error struct<_message:string,_VALUE:string>"


def junit(spark: SparkSession, path: str) -> DataFrame:
    """classname, name, file, line, failed, message of each test case of JUnit XML."""
    raw = spark.read.format("xml").option("rowTag", "testcase").schema(_CASE).load(path)
    failed = F.col("failure").isNotNull() | F.col("error").isNotNull()
    text = F.concat_ws("\n", "failure._message", "failure._VALUE", "error._message", "error._VALUE")
    return raw.select(F.col("_classname").alias("classname"), F.col("_name").alias("name"), F.col("_file").alias("file"), F.col("_line").alias("line"), failed.alias("failed"), text.alias("message"))


def stack_frames(cases: DataFrame) -> DataFrame:
    """path, line of the frames in failure messages, as often as they occur."""
    found = F.regexp_extract_all(F.col("message"), F.lit(r'(?:File "[^"\n]+", line \d+|[\w./-]+\.\w+:\d+)'), F.lit(0))
    x = cases.where("failed").select(F.explode(found).alias("x"))
    return x.select(F.coalesce(F.nullif(F.regexp_extract("x", r'File "([^"]+)"', 1), F.lit("")), F.regexp_extract("x", r"^(.+):\d+$", 1)).alias("path"), F.regexp_extract("x", r"(\d+)$", 1).cast("int").alias("line"))


def failed_tests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """name, path, line of failed tests in JSON lists ``failures`` or ``failed_tests``."""
    entry = "array<struct<name:string,path:string,file:string,line:int>>"
    raw = _json(spark, path, f"failures {entry}, failed_tests {entry}", lines)
    return raw.select(F.explode(F.concat(F.coalesce("failures", F.array().cast(entry)), F.coalesce("failed_tests", F.array().cast(entry)))).alias("t")).select("t.name", F.coalesce("t.path", "t.file").alias("path"), "t.line")


def coverage(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """path, line of the executed lines of a coverage report in JSON, each once."""
    raw = _json(spark, path, "files map<string,struct<executed_lines:array<int>>>", lines)
    return raw.select(F.explode("files").alias("path", "f")).select("path", F.explode("f.executed_lines").alias("line")).distinct()


def fault_scores(spark: SparkSession, path: str, metric: str = "ochiai", lines: bool = False) -> DataFrame:
    """path, line, score of spectra in JSON: a list of rows with path, line, ef, ep, nf."""
    raw = _json(spark, path, "path string, line int, ef double, ep double, nf double", lines)
    return raw.select("path", "line", F.round(sbfl(F.col("ef"), F.col("ep"), F.col("nf"), metric), 6).alias("score"))


REWARDS = "event_id string, query_id string, chosen_arm_id string, shadow_arm_id string, router_mode string, reward_source string, is_exploration boolean, reward double, observed_at timestamp"
FRICTION = "event_id string, stage string, severity string, status string, root_cause string, time_cost_min double, created_at timestamp"
NOTES = "handle string, text string, query string, keywords array<string>, namespace string, repo string, captured_at timestamp, created_at timestamp, last_used_at timestamp"


def json_log(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """An append-only log of JSON lines; rows that can't be read are skipped."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).option("mode", "DROPMALFORMED").json(path)


def commits(rows: DataFrame, limit: int) -> DataFrame:
    """The newest commits (commit_id, ts, files) with sorted distinct files."""
    return rows.select("commit_id", "ts", F.array_sort(F.array_distinct("files")).alias("files")).orderBy(F.desc("ts"), F.desc("commit_id")).limit(limit)


def worktree(rows: DataFrame) -> DataFrame:
    """files, additions, deletions and counts by status of changed files (path, status, adds, dels)."""
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("adds"), F.lit(0)).alias("additions"), F.coalesce(F.sum("dels"), F.lit(0)).alias("deletions"), F.count_if(F.col("status") == "??").alias("untracked"))


def baseline_metrics(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """metric, value of the numbers under ``metrics`` in a results file."""
    raw = _json(spark, path, "metrics map<string,double>", lines)
    return raw.select(F.explode("metrics").alias("metric", "value")).where(F.col("value").isNotNull())


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """name, intents, modules, errors, topics, description, priority of skill files: the lines ``key: value`` or
    ``key: [a, b]`` between the first two ``---``."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1).alias("m"))
    one = lambda k: F.regexp_extract("m", rf"(?m)^{k}:\s*(.+?)\s*$", 1)
    many = lambda k: F.filter(F.split(F.regexp_replace(one(k), r"[\[\]\"']", ""), r"\s*,\s*"), lambda x: x != "")
    return text.where(F.col("m") != "").select(one("name").alias("name"), many("intents").alias("intents"), many("modules").alias("modules"), many("error_keywords").alias("errors"), many("topics").alias("topics"), one("description").alias("description"), F.coalesce(one("priority").try_cast("int"), F.lit(0)).alias("priority"))


def cases(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Benchmark cases given as parsed YAML or JSON: case_id, query, expected, top_k, lane."""
    out = [(str(r.get("case_id") or r.get("id") or i), str(r.get("query") or ""), [str(x) for x in r.get("expected_keys") or r.get("expected") or []], int(r.get("top_k") or 8), str(r.get("comparison_lane") or "")) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, "case_id string, query string, expected array<string>, top_k int, lane string")


def workspace(spark: SparkSession, manifest: str | dict) -> DataFrame:
    """name, root, description, tags, weight of the repositories of a manifest (JSON text or a parsed mapping)."""
    data = json.loads(manifest) if isinstance(manifest, str) else manifest
    rows = [(str(r["name"]), str(r.get("root") or ""), str(r.get("description") or ""), [str(t) for t in r.get("tags") or []], float(r.get("weight") or 1.0)) for r in data.get("repos", [])]
    return spark.createDataFrame(rows, "name string, root string, description string, tags array<string>, weight double")
