"""Plans around the rankings."""

from pyspark.sql import functions as F

from quillon.operators import evaluation as E
from quillon.operators import planning as P


def test_query_side():
    assert P.exact_tokens("Fix fix the parseTable a " + " ".join(f"t{i}" for i in range(20)))[:3] == ["Fix", "the", "parseTable"]
    assert len(P.exact_tokens(" ".join(f"t{i}" for i in range(20)))) == 12
    assert P.query_terms("ranking parsedRows", {"ranking": ["order"]}) == ["order", "ranking", "rank", "parsedrows", "parsed", "rows", "parsedrow"]
    assert P.query_terms("") == []
    assert P.choose_policy("please fix it")[0] == "bugfix_test" and P.choose_policy("x")[0] == "general"
    assert P.shadow_arm("a", {"a": {"b": 0.4, "c": 0.9}}, ["b"]) == ("b", 0.4) and P.shadow_arm("z", {}, ["b"]) == ("", 0.0)


def test_frames(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("c", "b", 1.0), ("b", "d", 1.0)], "src string, dst string, weight double")
    ranked = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", 0.5)], "path string, score double")
    seeds = spark.createDataFrame([("a",)], "path string")
    assert [(r.path, r.reason) for r in P.stage_map(ranked, seeds, edges, "path", 3, 1).orderBy("place").collect()] == [("a", "seed"), ("b", "neighbour"), ("c", "ranked")]
    assert {r.path: r.score for r in P.seeded_rank(ranked, seeds, edges, "path").collect()} == {"a": 3.12, "b": 2.02, "c": 1.0, "d": 0.51}
    assert {r.node: r.prior for r in P.worktree_prior(spark.createDataFrame([("b",)], "node string"), edges, 5).collect()} == {"b": 1.0, "a": 0.5, "c": 0.5}
    changed = spark.createDataFrame([("src/load_table.py",), ("src/other.py",)], "path string")
    assert [r.path for r in P.query_guard(changed, "path", ["table"]).collect()] == ["src/load_table.py"]
    assert [r.path for r in P.query_guard(changed, "path", ["zz"]).collect()] == ["src/load_table.py"]
    g = spark.createDataFrame([("a", 3.0, ["x", "y"], "s1"), ("b", 2.0, ["x", "y"], "s2"), ("c", 1.5, ["x", "y"], "s1"), ("d", 0.1, None, "s1")], "key string, score double, t array<string>, shape string")
    assert {r.key: r.kept for r in P.chunk_guard(g, "key", "t", "shape", 2.0, 1.0).collect()} == {"a": True, "b": False, "c": True, "d": True}
    both = P.fused_memories(ranked, ranked.limit(1), "path", 3)
    assert both.first().path == "a" and both.count() == 3
    assert P.with_fallback(lambda: ranked.limit(0), lambda: seeds)[1] == "empty" and P.with_fallback(lambda: 1 / 0, lambda: seeds)[1].startswith("failed")
    log, counts = P.replay(seeds, spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "path string"), "path", F.col("path").isNotNull())
    assert log.count() == 2 and counts.first().asDict() == {"invalid": 1, "imported": 1, "known": 1}
    v = P.vacuum(spark.createDataFrame([("2025-01-01", None), (None, "2020-01-01"), ("2020-01-01", "2020-01-01")], "s string, c string"), F.col("s").cast("timestamp"), F.col("c").cast("timestamp"), "2025-01-02T00:00:00Z", 30, 365)
    assert v.first().asDict() == {"kept": 1, "unseen": 1, "aged": 1}
    assert P.overview(a=ranked.agg(F.count("*").alias("n")), b=seeds.agg(F.count("*").alias("n"))).first().asDict() == {"a_n": 4, "b_n": 1}
    cases = P.issue_cases(spark.createDataFrame([("1", "q", "p"), ("2", "", "p"), ("3", "q", None)], "issue_id string, query string, selected_path string"))
    assert [r.case_id for r in cases.collect()] == ["issue-1"]
    c = spark.createDataFrame([("p", "m.f", 1, 3)], "path string, qualified_name string, lineno int, end_lineno int")
    assert P.skeletons(c).first().skeleton.lines == 3
    shown, why = P.disclosure("snippet", F.lit(False), F.lit(True))
    assert tuple(c.select(shown, why).first()) == ("signature", "not_available")
    count, shield = P.shielded(F.lit(0.4), F.lit(True), enforce=True)
    assert tuple(c.select(count, shield).first()) == (0.2, 0.2)
    assert [tuple(r) for r in c.select(P.text_score(F.lit(-2.0)), P.text_score(F.lit(1.0))).collect()] == [(3.0, 0.5)]


def test_summaries(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.5, 10.0, [("fallback", "t", "r")]), ("a", 0.0, 1.0, 20.0, None), ("", 1.0, 1.0, 1.0, [])], "arm string, success double, reciprocal_rank double, latency_ms double, trace array<struct<action:string,target:string,reason:string>>")
    assert [tuple(r) for r in E.router_arms(rows, "arm", "trace").collect()] == [("a", 2, 0.5, 0.75, 20.0, 1, 0)]
    assert [tuple(r) for r in E.trace_events(rows, "trace").collect()] == [("fallback", "t", "r", 1)]
    assert E.micro_gate({"avg_ms": 10, "memory_mb": 5}, {"avg_ms": 12, "memory_mb": 4}) == {"time": True, "memory": False}
