"""Nested records, drift and histories on small cases with known results."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions.times import format_seconds, parse_micros
from quillon.operators import drift, history, nested

PLANS = "plan_id bigint, producer string, file_seq int, source_file string, ingested_at timestamp, payload string"
EVIDENCE = (
    "plan_id bigint, repo string, candidate_chunks array<struct<path:string,evidence:struct<role:string,sources:array<string>>>>, "
    "candidate_files array<struct<path:string,score:double>>"
)


def plans(spark, payloads, producer="p", seq=1):
    rows = [(i, producer, seq, f"{producer}/{seq}", None, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, PLANS)


def children(spark, payloads, evidence=()):
    e = spark.createDataFrame(list(evidence), EVIDENCE)
    return sorted(tuple(r) for r in nested.plan_children(plans(spark, payloads), e).collect())


def test_children_places_and_dirt(spark):
    got = children(
        spark,
        [
            {"source_plan": {"steps": [None, {"file": "a"}, {"file": ""}, {}, "x", {"file": 3}], "candidate_files": ["f", {"path": "g"}, None, {"path": None}, ""]}},
            {"source_plan": {"steps": {"file": "solo"}}},
            {"source_plan": None},
            None,
            "",
            "not json",
            "[1]",
            "null",
            '{"source_plan": {"steps": [{"file": "cut"',
            '{"source_plan": {"steps": [{"file": "tail"}]}} x',
        ],
        [
            (100, "r", [None, ("p", ("direct", ["s", None, "", "t"])), ("q", None)], [None, ("c", 1.0), (None, 2.0)]),
            (100, "r", [None, ("p", ("direct", ["s", None, "", "t"])), ("q", None)], [None, ("c", 1.0), (None, 2.0)]),
            (101, None, None, []),
        ],
    )
    assert got == [
        (0, "candidate_file", 0, 0, "f"),
        (0, "candidate_file", 1, 0, "g"),
        (0, "step", 1, 0, "a"),
        (1, "step", 0, 0, "solo"),
        (100, "candidate_file", 1, 0, "c"),
        (100, "source", 1, 0, "s"),
        (100, "source", 1, 3, "t"),
    ]


def test_children_of_empty_tables(spark):
    assert children(spark, []) == []


def test_flatten_links_and_branches(spark):
    docs = plans(spark, [{"a": 1, "kids": [{"n": "x", "toys": [1, "two"]}, {"n": 5}]}, {"a": "one", "kids": {"n": "y"}}]).withColumn("value", F.lit("clash")).withColumn("_pos", F.lit(7))
    t = nested.flatten_json(docs, "payload", ["plan_id"])
    assert t.paths == ["", "kids[]", "kids[].toys[]"]
    root, kids, toys = t.table(""), t.table("kids[]"), t.table("kids[].toys[]")
    assert set(root.select("value.*").columns) == {"a:string", "a:integer"}
    assert kids.join(root.select("_key"), kids._parent == root._key).count() == 3
    rows = toys.join(kids.select(F.col("_key").alias("k"), F.col("_pos").alias("p")), F.col("_parent") == F.col("k")).select("_pos", "p", "value.*").orderBy("_pos").collect()
    assert [(r._pos, r.p, r["item:integer"], r["item:string"]) for r in rows] == [(0, 0, 1, None), (1, 0, None, "two")]


def test_too_many_paths_is_an_error(spark):
    with pytest.raises(ValueError):
        nested.infer_shape(plans(spark, [{str(i): 1 for i in range(20)}]), "payload", max_paths=10)


def found(spark, *files):
    df = None
    for seq, payloads in files:
        part = plans(spark, payloads, seq=seq)
        df = part if df is None else df.unionByName(part)
    return sorted(tuple(r) for r in drift.file_changes(df).collect())


def test_drift_kinds(spark):
    old = [{"repo": f"r{i % 3}", "n": i, "flag": True, "gone": f"{i:08x}"} for i in range(12)]
    new = [{"request": {"repo": f"r{i % 3}"}, "n": str(i), "flag": True, "fresh": [1]} for i in range(12)]
    assert found(spark, (1, old), (2, new)) == [
        ("p/2", "added", "", "fresh"),
        ("p/2", "removed", "gone", ""),
        ("p/2", "renamed", "repo", "request.repo"),
        ("p/2", "retyped", "n", "n"),
    ]


def test_drift_needs_the_file_before_and_a_fifth(spark):
    a, b = [{"x": 1}] * 10, [{"x": 1}] * 8 + [{"x": 1, "rare": 1}] + [{"x": 1, "empty": {}, "none": None}]
    assert found(spark, (1, a), (3, [{"y": 1}])) == []
    assert found(spark, (1, a), (2, b)) == []
    assert found(spark, (1, a), (2, [*b[:8], {"x": 1, "rare": 1}, {"x": 1, "rare": 2}])) == [("p/2", "added", "", "rare")]


def test_drift_of_dirty_files(spark):
    assert found(spark, (1, [None, "x", "[]"]), (2, [None, {"a": 1}])) == [("p/2", "added", "", "a")]
    assert found(spark, (1, [])) == []
    assert found(spark, (1, [{"a": 1e999}, {"a": 10**400}]), (2, [{"b": 1e999}, {"b": 10**400}])) == [("p/2", "renamed", "a", "b")]


def test_union_table_and_alternatives(spark):
    df = plans(spark, [{"a": 1, "b": [1]}, {"a": "x", "c": {"d": True}}, "bad", None])
    rows = {r.plan_id: r.asDict() for r in drift.union_table(df, "payload", ["plan_id"]).collect()}
    assert rows[0] == {"plan_id": 0, "a": "1", "a:string": None, "a:integer": 1, "b": "[1]", "c.d": None}
    assert rows[1]["a:string"] == "x" and rows[1]["c.d"] == "true"
    alt = {(r.path, r.type): r.n_values for r in drift.alternatives(df).collect()}
    assert alt == {("a", "number"): 1, ("a", "string"): 1, ("b", "array"): 1, ("c.d", "boolean"): 1}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2025-01-31T08:00:00Z", "2025-01-31T08:00:00Z"),
        ("2025-01-31 08:00:00", "2025-01-31T08:00:00Z"),
        ("2025-01-31T08:00:00.250+05:30", "2025-01-31T02:30:00Z"),
        ("2025-01-31T08:00:00-0730", "2025-01-31T15:30:00Z"),
        ("2025-01-31", "2025-01-31T00:00:00Z"),
        ("1738310400", "2025-01-31T08:00:00Z"),
        ("1969-12-31T23:59:59Z", "1969-12-31T23:59:59Z"),
        ("", None),
        ("soon", None),
        ("0000-00-00", None),
        ("2025-13-01", None),
        (None, None),
    ],
)
def test_times(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(format_seconds(parse_micros(F.col("t"))).alias("x")).first().x == want


TRIPLES = "subject string, predicate string, valid_from string, valid_to string, as_of string, observed_at string, object_value string, extra int, start string"


def versions(spark, rows, snapshots=3):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], TRIPLES)
    return sorted(tuple(r) for r in history.statement_history(df, snapshots).collect())


D = "2025-01-0{}T00:00:00Z".format


def test_history_rules(spark):
    rows = [
        ("s", "p", D(1), "", None, D(1), "a"),
        ("s", "p", D(2), None, None, D(2), "a"),  # the same value goes on
        ("s", "p", D(3), D(4), None, D(3), "b"),  # ends by itself
        ("s", "p", D(6), "later", None, D(6), "b"),  # a gap before it
        ("s", "p", "n/a", "", D(7), D(8), "c"),  # as_of for an unreadable start
        ("s", "p", "2025-01-07", "", None, D(9), "d"),  # the same start, observed later
        ("s", "p", "2025-01-07 00:00:00", "", None, D(9), "d"),  # delivered twice
        ("s", "p", None, "", "", D(9), "x"),  # no start at all
        ("s", "q", D(5), D(1), None, None, "e"),  # an end before the start is ignored
        (None, "q", D(5), "", None, None, None),
    ]
    want = [
        ("s", "p", D(1), D(3), "a"),
        ("s", "p", D(3), D(4), "b"),
        ("s", "p", D(6), D(7), "b"),
        ("s", "p", D(7), "", "d"),
        ("s", "q", D(5), "", "e"),
    ]
    for n in (1, 2, 9):
        got = versions(spark, rows[:-1], n)
        assert got == want
    assert len(versions(spark, [rows[-1]])) == 1
    assert versions(spark, []) == []


def test_history_over_segments(spark):
    """One entity over many segments equals a plain pass over its rows."""
    rows = [("s", "p", f"20{y:02d}-{m:02d}-01", "", None, D(1), "ab"[(y * m) % 3 == 0]) for y in range(10, 30) for m in (1, 2, 7)]
    got = versions(spark, rows)
    flat = sorted((r[2] + "T00:00:00Z", r[6]) for r in rows)
    want = [x for i, x in enumerate(flat) if not i or flat[i - 1][1] != x[1]]
    assert [(g[2], g[4]) for g in got] == want
    assert [g[3] for g in got] == [w[0] for w in want[1:]] + [""]


def test_merkle_finds_only_what_changed(spark):
    a = spark.range(5000).select((F.col("id") % 500).alias("k"), F.col("id").alias("v"))
    b = a.where(F.col("v") != 7).unionByName(spark.createDataFrame([(3, -1), (3, -1), (999, 5)], "k bigint, v bigint"))
    assert sorted(tuple(r) for r in history.merkle_changes(a, b, ["k"]).collect()) == [(3, -1, "new"), (999, 5, "new")]
    c = a.where(F.col("k") != 17)
    assert {tuple(r) for r in history.merkle_changes(a, c, ["k"]).select("k", "change").collect()} == {(17, "gone")}
    assert history.merkle_changes(a, a, ["k"]).count() == 0
    assert history.merkle_changes(a.limit(0), a, ["k"]).count() == 5000
    levels = (4, 4, 4)
    leaves = history.changed_leaves(history._digested(a, ["k"], levels), history._digested(b, ["k"], levels), levels)
    assert 0 < leaves.count() <= 3


def test_snapshots_read_changed_branches_alone(spark):
    a = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    b = a.where(F.col("k") != 5).withColumn("v", F.when(F.col("k") == 77, "new").otherwise(F.col("v")))
    levels = history.levels_for(20000)
    assert sum(levels) >= 8
    old, new = (history.Snapshot.write(x, ["k"], levels) for x in (a, b))
    assert sorted(tuple(r) for r in old.changes(new).collect()) == [(5, "5", "gone"), (77, "new", "new")]
    leaves = history.descend(history._paired(old.digests, new.digests), levels)
    assert leaves.count() == 2 and old.changes(old).count() == 0
    some = old.at(leaves)
    assert 0 < some.count() < 20000 / 20
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*_branch#\d+ (IN|INSET|=)", plan) and "PushedFilters: [" in plan and re.search(r"PushedFilters: \[[^]]*(In\(_leaf|EqualTo\(_leaf|Or\()", plan), plan


def plain_versions(rows):
    """Versions of (entity, at, stop, value), by one pass over them in order."""
    out = []
    rows = sorted(rows)
    for i, (e, at, stop, value) in enumerate(rows):
        end = stop if stop is not None and stop > at else None
        if i + 1 < len(rows) and rows[i + 1][0] == e and (end is None or rows[i + 1][1] < end):
            end = rows[i + 1][1]
        if out and out[-1][0] == e and out[-1][2] == at and out[-1][3] == value:
            out[-1] = (e, out[-1][1], end, value)
        else:
            out.append((e, at, end, value))
    return sorted(out, key=str)


def test_versions_of_a_hot_entity_over_partitions(spark):
    rng = random.Random(3)
    rows = [("hot", at, rng.choice([None, at + 1, at + 2, at - 5]), rng.choice("aab")) for at in rng.sample(range(30000), 12000)]
    rows += [("hot" + "x" * (i % 3), 40000 + i, None, "same") for i in range(4000)]
    rows += [(f"e{i % 50}", i, None, rng.choice(["v", "w"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "e string, at bigint, stop bigint, value string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in ("1", "4", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted((tuple(r) for r in history.versions(df, ["e"], "at", "stop", "value").collect()), key=str) == plain_versions(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_as_of(spark):
    h = spark.createDataFrame([("s", "p", D(1), D(3), "a"), ("s", "p", D(3), "", "b")], "subject string, predicate string, valid_from string, valid_to string, object_value string")
    assert [r.object_value for r in history.as_of(h, F.lit(D(3))).collect()] == ["b"]


def test_numbers_and_repeated_keys_are_kept(spark):
    big = 9007199254740993
    texts = [f'{{"a": [{{"n": {big}}}], "a": [{{"n": {big + 2}}}]}}', '{"a": [{"n": 1.5}]}', '{"a": NaN}', "[1]", "{broken", None, '{"a": [{"n": 1.5}]}']
    df = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)], "id int, payload string")
    df = df.withColumn("id", F.when(F.col("id") == 0, F.when(F.col("payload").contains("1.5"), 1).otherwise(0)).otherwise(F.col("id")))
    tables = nested.flatten_json(df, "payload", ["id"])
    rows = tables.table("a[]").select("_root.id", "_key", "value.*").collect()
    assert sorted((r.id, r["n:integer"], r["n:number"]) for r in rows) == [(0, big + 2, None), (1, None, 1.5)]
    roots = [r._key for r in tables.table().collect()]
    assert len(roots) == len(set(roots)) == 2
    assert sorted(tuple(r) for r in nested.rejected(df, "payload", ["id"]).collect()) == [(2, "unreadable"), (3, "not an object"), (4, "unreadable"), (5, "null")]


def test_sorts_of_long_and_mixed_values():
    long = "-".join(["ab"] * 40)
    assert drift.features(long + "-1") != drift.features(long + "-x") and drift._sort(long + "-1") != drift._sort(long + "-x")
    assert set(drift.features(["abc", 1, None])) == {"sa", "snumber", "snull", "vabc", "vnumber", "vnull"}
