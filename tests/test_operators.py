"""Operators that SQL doesn't cover: text functions against plain Python, selections, sources, sinks, streams, stages."""

import json
import re
import uuid
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunks as C
from quillon.operators import evaluation as E
from quillon.operators import graph as G
from quillon.operators import memory as M
from quillon.operators import ranking as R
from quillon.operators import vector as V
from quillon.plans.pipeline import Channels, Pipeline, ResultCache, agent_loop, encode
from quillon.sources import files, markdown, reports, sinks
from quillon.streaming import rollup

FILES = "path string, module string, tier string, symbols array<string>, imports array<string>"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def plain_tokens(text, min_len=2, limit=64):
    out = []
    for part in filter(None, re.split("[^a-zA-Z0-9_]+", text or "")):
        for t in [part, *re.findall(T.CAMEL, part)]:
            t = t.lower()
            if len(t) >= min_len and t not in out:
                out.append(t)
    return out[:limit]


@pytest.mark.parametrize("text", [None, "", "getUserById", "get_user HTTPServer2x ABC_def", "a b", "x" * 5000, "naïve Ünïcode", "A1B2 " * 200])
def test_code_tokens(spark, text):
    assert one(spark, T.code_tokens(F.col("x")), text) == plain_tokens(text)


def test_text_rules(spark):
    assert one(spark, T.tail_symbol(F.col("x")), "a/b.c. ") == "c" and one(spark, T.tail_symbol(F.col("x")), None) == ""
    assert one(spark, T.normal_path(F.col("x")), " .\\./a\\b ") == "a/b"
    assert one(spark, T.snippet(F.col("x"), ["two"]), "\n one \n two\n") == "two" and one(spark, T.snippet(F.col("x"), ["z"]), "\n one") == "one"
    assert one(spark, T.contains_marker(F.col("x"), "fix"), "a FIX!") and not one(spark, T.contains_marker(F.col("x"), "fix"), "prefix")
    assert one(spark, T.found_keywords(F.col("x"), ["slow", "err"]), "so slow") == ["slow"]
    assert one(spark, T.first_rule(F.col("x"), [("a", ["x1"]), ("b", ["x"])], "c"), "has x1") == "a"
    assert one(spark, T.half_life(F.lit(30.0), 30.0), "") == 0.5 and one(spark, T.half_life(F.lit(-1.0), 30.0), "") == 1.0
    assert one(spark, T.jaccard(T.word_set(F.col("x")), F.array(F.lit("a"))), None) == 0.0


@pytest.mark.parametrize(("pattern", "path", "fits"), [("*.md", "a/b.md", True), ("/src/", "src/a.py", True), ("/src/", "lib/src/a.py", False), ("docs/**", "docs/a/b", True), ("docs/*", "docs/a/b", True), ("a?c", "x/abc", True), ("**/t.py", "t.py", True)])
def test_globs(pattern, path, fits):
    assert bool(re.search(T.glob_regex(pattern), path)) == fits


def test_ranking_falls_back_and_breaks_ties(spark):
    rows = [(f"src/f{i}.py", f"src.f{i}", "first_party", ["loadTable"], []) for i in range(6)] + [("pkg/f.py", None, "dependency", None, None)]
    f = spark.createDataFrame(rows, FILES)
    assert [r.path for r in R.top(R.heuristic(f, ["table"], 0.1), "path", 3).collect()] == ["src/f0.py", "src/f1.py", "src/f2.py"]
    for ranker in R.RANKERS:
        assert R.rank_files(f, ["table"], ranker, 3).count() > 0
    assert R.select_initial(f, ["nothing"], "bm25_lite", 2.0, 3).count() == 7
    assert R.select_initial(f.limit(0), ["x"], "bm25_lite", 2.0, 3).count() == 0
    assert R.bm25_two_stage(f, ["table", "table"], 2).count() == 6
    assert R.coverage(f, ["table", "zzz"]).where("coverage > 0.5").count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3.0), (2, [0.0, 1.0], 2.0), (3, [0.0, 0.0], 1.0), (4, None, 0.5)], "k int, vector array<double>, score double")
    got = V.rerank_with_vectors(df, "k", df, [0.0, 1.0], 3, lexical=0.0, semantic=1.0).orderBy(F.desc("in_pool"), F.desc("score"), "k").collect()
    assert [r.k for r in got] == [2, 1, 3, 4]
    stored = spark.createDataFrame([("a", "1", [1.0]), ("b", "1", [1.0]), ("c", "1", [1.0])], "path string, sha256 string, vector array<double>")
    rows = spark.createDataFrame([("a", "1", "t"), ("b", "2", "t"), ("d", "1", "t")], "path string, sha256 string, text string")
    fresh = V.refresh_vectors(rows, stored, lambda d: d.withColumn("vector", F.array(F.lit(9.0))))
    assert {r.path: r.vector for r in fresh.collect()} == {"a": [1.0], "b": [9.0], "d": [9.0]}
    assert V.unit_weights(3, 1) == (0.75, 0.25) and V.unit_weights(0, 0) == (1.0, 0.0)


def test_graphs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node int")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (0, 9, 1.0), (1, 2, 0.0)], "src int, dst int, weight double")
    ranks = {r.node: r.rank for r in G.pagerank(nodes, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[3] < ranks[0]
    assert [r.rank for r in G.pagerank(nodes.limit(1), edges).collect()] == [1.0] and G.pagerank(nodes.limit(0), edges).count() == 0
    near = {(r.start, r.node): r.depth for r in G.distances(nodes, edges, 5).collect()}
    assert near[0, 0] == 3 and near[0, 2] == 2 and (3, 0) not in near
    assert one(spark, G.locality(F.col("x"), F.lit("a/b/d")), "a/b/c") == 2


def test_selection(spark):
    rows = [("p", i, i + 2, f"m.f{i}", "function", 10.0 - i * 0.01, 20) for i in range(1, 9)] + [("q", 1, 2, "m.g", "class", 9.6, 20)]
    c = spark.createDataFrame(rows, "path string, lineno int, end_lineno int, qualified_name string, kind string, score double, tokens int")
    got = C.select_diverse(c, 4, 1000, limit=2).orderBy("place").collect()
    assert [r.path for r in got][:2] == ["p", "q"] and sum(r.path == "p" for r in got) == 2
    assert C.select_diverse(c, 9, 45).count() == 2 and C.select_diverse(c.limit(0), 9, 45).count() == 0
    assert [r.path for r in C.pack_greedy(c, ["q"], 2).orderBy("place").collect()] == ["q", "p"]
    t = spark.createDataFrame([(1, "g", 3.0, ["a", "b"]), (2, "g", 2.0, ["a", "b"]), (3, "g", 1.0, []), (4, "g", 1.0, None)], "k int, g string, score double, t array<string>")
    assert {r.k: r.kept for r in C.greedy_distinct(t.fillna(0), "k", "g", "t", 0.9).where("k < 4").collect()} == {1: True, 2: False, 3: True}


def test_memory(spark):
    now = datetime(2025, 3, 10, 12, tzinfo=timezone.utc)
    assert M.resolve_window("last 3 weeks", None, None, now)[0].day == 17
    assert M.resolve_window(None, "2025-01-01", "2025-01-02", now)[1].isoformat() == "2025-01-02T23:59:59.999999+00:00"
    assert M.resolve_window("soon", None, None, now)[2] == "unreadable" and M.resolve_window(None, "2025-02-01", "2025-01-01", now)[2] == "inverted"
    f = spark.createDataFrame([("a", 0.9, 0.9, 1, None, 5), ("b", 0.8, 0.8, 1, None, 9), ("c", 0.1, 0.1, 0, None, 5)], "text string, confidence double, importance double, uses int, last_used timestamp, tokens int")
    assert [r.text for r in M.ranked_facts(f, 5, 10).collect()] == ["a", "c"]
    a = spark.createDataFrame([("k", 1), ("l", 1)], "key string, v int")
    assert sorted(tuple(r) for r in M.upsert(a, spark.createDataFrame([("k", 2), ("m", 2)], "key string, v int"), ["key"]).collect()) == [("k", 2), ("l", 1), ("m", 2)]
    assert [(r.place, r.v) for r in M.fetch(a, "key", ["l", "k", "zz"]).orderBy("place").collect()] == [(0, 1), (1, 1)]


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", ["src/x.py"]), ("b", ["nothing"]), ("c", None)], "case_id string, expected array<string>")
    cand = spark.createDataFrame([("a", 1, "lib/y.go", None), ("a", 2, "lib/x.go", "m"), ("b", 1, "q", "r")], "case_id string, rank int, path string, module string")
    got = {r.case_id: r for r in E.match_metrics(cases, cand, 5).collect()}
    assert (got["a"].recall_hit, got["a"].precision, got["a"].reciprocal_rank) == (1.0, 0.5, 0.5)
    assert (got["b"].recall_hit, got["b"].noise) == (0.0, 1.0) and got["c"].recall_hit == 0.0
    gate = {r.metric: r.passed for r in E.gate(spark.createDataFrame([("a", 0.9)], "metric string, value double"), {"a": (">=", 0.9), "b": (">=", 0.0)}).collect()}
    assert gate == {"a": True, "b": False}
    assert E.tuning({"noise_mean": 0.5}) == {"candidate_relative_threshold": 0.25}


def test_index(spark, tmp_path):
    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("import os\nfrom b import c as d\n\nclass K:\n    def m(self):\n        return os.getcwd()\n")
    (root / "src/bad.py").write_text("def (:\n")
    (root / "b.go").write_text('package b\nimport "fmt"\nfunc (r *T) Do(x int) {}\n')
    (root / "docs.md").write_text("# One\ntext [l](x.md)\n```\n# no\n```\n## Two\n")
    (root / "skip.txt").write_text("x")
    scanned = files.scan(spark, str(root))
    rows = {r.path: r for r in files.parse(scanned).collect()}
    assert set(rows) == {"src/a.py", "src/bad.py", "b.go", "docs.md"}
    assert [s.qualified_name for s in rows["src/a.py"].symbols] == ["K", "K.m"] and rows["src/bad.py"].parse_error.startswith("SyntaxError")
    assert [s.name for s in rows["b.go"].symbols] == ["Do"] and [(s.qualified_name, s.end_lineno) for s in rows["docs.md"].symbols] == [("One", 7), ("One/Two", 7)]
    sinks.write_table(files.parse(scanned), str(tmp_path / "index"))
    old = spark.read.parquet(str(tmp_path / "index"))
    (root / "b.go").write_text("func New() {}\n")
    (root / "docs.md").unlink()
    again = {r.path: r for r in files.update_index(old, files.scan(spark, str(root))).collect()}
    assert set(again) == {"src/a.py", "src/bad.py", "b.go"} and again["b.go"].symbols[0].name == "New"
    assert files.scan(spark, str(root), patterns=["*.py", "!src/a.py"]).count() == 2
    files.index_stream(spark, str(root), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_reports(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    scip = put("i.scip.json", {"documents": [{"relative_path": "a", "occurrences": [{"symbol": "s", "symbol_roles": 1}]}, {"relative_path": "b", "occurrences": [{"symbol": "s", "symbol_roles": 0}, {"symbol": "s"}]}]})
    assert [tuple(r) for r in reports.load_symbol_index(spark, scip).collect()] == [("b", "a", 2.0)]
    plain = put("e.json", {"edges": [{"from": "a", "to": "b"}, {"source": "a", "target": "a"}]})
    assert [tuple(r) for r in reports.load_symbol_index(spark, plain).collect()] == [("a", "b", 1.0)]
    xml = put("j.xml", '<testsuite><testcase classname="c" name="t" file="f" line="3"><failure message="boom">File "a.py", line 7\nsrc/b.go:9</failure></testcase><testcase classname="c" name="u"/></testsuite>')
    cases = reports.junit(spark, xml)
    assert {r.name: r.failed for r in cases.collect()} == {"t": True, "u": False}
    assert sorted(tuple(r) for r in reports.stack_frames(cases).collect()) == [("a.py", 7), ("src/b.go", 9)]
    assert [tuple(r) for r in reports.coverage(spark, put("c.json", {"files": {"a": {"executed_lines": [1, 1, 2]}}})).orderBy("line").collect()] == [("a", 1), ("a", 2)]
    assert reports.fault_scores(spark, put("s.json", [{"path": "a", "line": 1, "ef": 2, "ep": 0, "nf": 0}])).first().score == 1.0
    assert reports.failed_tests(spark, put("f.json", {"failures": [{"name": "t", "file": "p"}]})).first().path == "p"
    log = put("r.jsonl", '{"event_id":"1","reward":1.5}\nbroken\n')
    assert [r.reward for r in reports.json_log(spark, log, reports.REWARDS).collect()] == [1.5]
    skill = put("s.md", "---\nname: one\nintents: [fix, test]\npriority: 3\n---\nbody")
    assert reports.front_matter(spark, skill).first().asDict() == {"name": "one", "intents": ["fix", "test"], "modules": [], "errors": [], "topics": [], "description": "", "priority": 3}
    assert reports.workspace(spark, '{"repos": [{"name": "a", "tags": ["x"]}]}').first().weight == 1.0
    assert reports.cases(spark, [{"id": "q", "expected_keys": ["k"]}]).first().expected == ["k"]
    assert reports.baseline_metrics(spark, put("m.json", {"metrics": {"a": 1.0}})).first().value == 1.0


def test_sinks(spark):
    v = "provider string, model string, dimension int, path string, batch_id string"
    stored = spark.createDataFrame([("p", "m", 2, "a", "1"), ("p", "m", 2, "b", "1"), ("p", "n", 2, "c", "1")], v)
    batch = spark.createDataFrame([("p", "m", 2, "a", "x")], v)
    assert sorted((r.path, r.batch_id) for r in sinks.merge_vectors(stored, batch, "2").collect()) == [("a", "2"), ("c", "1")]
    f = spark.createDataFrame([("h", 1, "old"), ("i", 1, "i")], "handle string, ts int, text string")
    assert sorted(r.text for r in sinks.merge_facts(f, spark.createDataFrame([("h", 1, "new")], f.schema), "handle", "ts").collect()) == ["i", "new"]
    assert len(sinks.table_fingerprint(f, "handle", "text")) == 64
    s = sinks.spans(spark.createDataFrame([("t", "a", 1, 5.0, datetime(2025, 1, 1)), ("t", "b", 2, 7.0, datetime(2025, 1, 1))], "trace_id string, stage string, place int, elapsed_ms double, started_at timestamp")).orderBy("start_us").collect()
    assert s[0].end_us == s[1].start_us and s[1].end_us - s[1].start_us == 7000


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n# A\ntext\n## B\n```\n# no\n```\n# C\n"), (2, None), (3, "")], "doc_id int, text string")
    rows = [(r.doc_id, r.level, r.heading, r.path) for r in markdown.heading_paths(markdown.sections(df, "doc_id", "text"), "doc_id").orderBy("doc_id", "section").collect()]
    assert rows == [(1, 0, "", ""), (1, 1, "A", "A"), (1, 2, "B", "A > B"), (1, 1, "C", "C"), (3, 0, "", "")]
    tf = markdown.section_tokens(markdown.heading_paths(markdown.sections(df, "doc_id", "text"), "doc_id"), ["doc_id", "section"])
    assert tf.where("token = 'b'").first().tf == 5.0


def test_schedules():
    at = datetime(2025, 3, 9, 12, 30)  # a Sunday
    for spec, fits in (("* * * * *", True), ("*/15 12 * * 0", True), ("30 10-14/2 9 3 7", True), ("31 * * * *", False), ("0,30 * * * 1-5", False)):
        assert rollup.cron_matches(spec, at) == fits
    tasks = [{"name": "a", "every": 60, "last": None}, {"name": "b", "cron": "30 12 * * *", "last": at}, {"name": "c", "cron": "30 12 * * *", "last": None}]
    assert rollup.due(tasks, at) == ["a", "c"]


def test_stream_counts_repeats_once(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 1), 1, "view", 2.0, ""), (1, datetime(2024, 1, 1, 1), 1, "view", 2.0, ""), (2, datetime(2024, 1, 1, 2), 1, "view", 3.0, "")]
    spark.createDataFrame(rows, rollup.EVENTS).write.parquet(str(tmp_path / "in"))
    rollup.run_once(rollup.event_rollup(rollup.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [(r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 5.0)]


def test_pipeline(spark):
    p = Pipeline()
    seen = []

    @p.stage("double", "x bigint")
    def double(df):
        return df.select((F.col("id") * 2).alias("x"))

    @p.stage("wrong", "y int")
    def wrong(df):
        return df

    with pytest.raises(ValueError):
        p.stage("double")(double)
    p.before.append(lambda name, df: seen.append(name) or df)
    p.after.append(lambda name, df: df.where("x > 2"))
    assert [r.x for r in p.run(spark.range(4), ["double"]).collect()] == [4, 6] and seen == ["double"]
    with pytest.raises(ValueError, match="column y"):
        p.run(spark.range(2))

    class Lengths:
        dimension = 1

        def encode(self, texts):
            return [[float(len(t))] for t in texts]

    assert [r.vector for r in encode(spark.createDataFrame([("abc",), (None,)], "t string"), "t", Lengths()).collect()] == [[3.0], [0.0]]
    c = Channels()
    c.register("empty", lambda s: s.range(0), aliases=("none",))
    c.register("full", lambda s: s.range(2))
    assert c.read(spark, "NONE", "full").count() == 2
    cache, made = ResultCache(spark, f"results-{uuid.uuid4().hex}"), []
    for _ in range(2):
        assert cache.get("k", lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
    assert agent_loop(lambda q: spark.createDataFrame([(q,)], "q string"), lambda df: df.first().q + "!" if len(df.first().q) < 3 else None, "a").first().q == "a!!"
