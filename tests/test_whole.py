"""Operators do the whole job: nothing beyond a pool, a prefix or a depth is lost."""

import random
import re

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunks as C
from quillon.operators import graph as G
from quillon.operators import memory as M
from quillon.operators import planning as P
from quillon.plans.adapters import chunks, files, trade
from quillon.sources.tables import load

SMALL = "/root/testdata/sf0.001"


def test_code_tokens_of_long_texts(spark):
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(" ".join(words),)], "x string")
    assert df.select(T.code_tokens(F.col("x"), limit=None).alias("y")).first().y[-1] == "299"
    assert len(df.select(T.code_tokens(F.col("x")).alias("y")).first().y) == 64
    assert entry.queries()["code_tokens"](spark, SMALL).agg(F.max(F.size("tokens"))).first()[0] > 64


def test_chunk_guard_judges_every_chunk(spark):
    rng = random.Random(3)
    rows = [(i % 3, f"k{i:04}", rng.choice([0.5, 1.5, 2.0, 4.0]), rng.sample("abcdefgh", rng.randint(0, 4)), rng.choice("xy")) for i in range(900)]
    rows += [(None, "n1", 3.0, ["a"], "x"), (None, "n2", 2.9, ["a"], "y")]
    df = spark.createDataFrame(rows, "g int, key string, score double, t array<string>, shape string")
    want = {}
    for group in (0, 1, 2, None):
        kept = []
        for g, k, score, t, shape in sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1])):
            t = set(t)
            against = sum(len(t & o) / len(t | o) for o, s in kept if s != shape and t and o)
            want[g, k] = not t or score - 2.0 * against >= 1.0
            if want[g, k]:
                kept.append((t, shape))
    got = P.chunk_guard(df, "key", "t", "shape", 2.0, 1.0, "g").collect()
    assert {(r.g, r.key): r.kept for r in got} == want and len(got) == len(rows)
    assert P.chunk_guard(df, "key", "t", "shape", 2.0, 1.0).count() == len(rows)


def test_chunk_guard_query_has_every_chunk_of_every_plan(spark):
    key = ["plan_id", "path", "lineno", "end_lineno", "qualified_name"]
    assert entry.queries()["chunk_guard"](spark, SMALL).count() == chunks(spark, SMALL).select(*key).distinct().count()


def _steps(edges, start):
    """Breadth-first: node, fewest steps of 1 or more."""
    found, front, d = {}, {start}, 0
    while front:
        d += 1
        front = {b for a, b in edges if a in front} - set(found)
        found.update(dict.fromkeys(front, d))
    return found


def _centrality(nodes, edges):
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for n, d in _steps(edges, s).items():
            out[n] += 1 / d
    return out


def test_depth_has_no_limit(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(20, 17), (5, 2)]
    nodes, edges = spark.createDataFrame([(i,) for i in range(21)], "node int"), spark.createDataFrame(pairs, "src int, dst int")
    got = {r.node: r.centrality for r in G.depth_centrality(nodes, edges).collect()}
    assert got == pytest.approx(_centrality(range(21), pairs), abs=2e-6)
    assert G.distances(nodes.where("node = 0"), edges).where("node = 20").first().depth == 20
    assert G.distances(nodes.where("node = 0"), edges, 8).agg(F.max("depth")).first()[0] == 8


def test_whole_trade_graph(spark):
    nodes, edges = trade(spark, SMALL)
    nodes, pairs = [r.node for r in nodes.collect()], [(r.src, r.dst) for r in edges.collect()]
    assert any(a > b for a, b in pairs)
    got = {r.node: r.centrality for r in entry.queries()["import_depth"](spark, SMALL).collect()}
    assert got == pytest.approx(_centrality(nodes, pairs), abs=2e-6)
    near = {}
    for s in (1, 2):
        for n, d in _steps(pairs, s).items():
            if d <= 2 and n not in (1, 2):
                near[n] = min(d, near.get(n, 9))
    want = sorted(near.items(), key=lambda x: (x[1], x[0]))[:6]
    assert [tuple(r) for r in entry.queries()["neighbour_expansion"](spark, SMALL).collect()] == want


def test_module_suffixes_of_all_files(spark):
    rows = files(spark, SMALL).select("path", "module", F.size("symbols").alias("n")).collect()
    scores = {}
    for r in rows:
        if r.n > 0:
            scores[r.module] = max(r.n, scores.get(r.module, 0))
    want = {}
    for r in rows:
        m = re.sub(r"\.[a-z]+$", "", r.path, count=1).replace("src/", "").replace("/", ".")
        ends = [v for k, v in scores.items() if f".{k}".endswith(f".{m}") or f".{m}".endswith(f".{k}")]
        want[m] = float(scores.get(m, max(ends, default=0)))
    got = entry.queries()["module_suffixes"](spark, SMALL).collect()
    assert {r.module: r.match for r in got} == want and len(got) == len(want)
    assert any(r.match > 0 for r in got if r.module.startswith(("pkg.", "docs.", "tests.")))


def _greedy(rows, threshold):
    want, kept = {}, {}
    for k, g, _, t in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0])):
        t, before = set(t or ()), kept.setdefault(g, [])
        want[g, k] = all(not t or not o or len(t & o) / len(t | o) < threshold for o in before)
        if want[g, k]:
            before.append(t)
    return want


@pytest.mark.parametrize("threshold", [0.5, 0.9, 1.0])
def test_near_duplicates_of_every_row(spark, threshold):
    rng, rows = random.Random(5), []
    for i in range(900):
        if rows and rng.random() < 0.6:
            t = set(rng.choice(rows)[3] or ["a"])
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                t ^= {f"w{rng.randrange(400)}"}
        else:
            t = {f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 5, 9, 10, 19, 40, 90, 200]))}
        rows.append((i, rng.choice(["g", "g", "h", None]), rng.choice([None, 1.0, 2.0, 3.5, i * 0.01]), sorted(t) or rng.choice([None, []])))
    df = spark.createDataFrame(rows, "k int, g string, score double, t array<string>")
    want = _greedy(rows, threshold)
    got = {(r.g, r.k): r.kept for r in C.greedy_distinct(df, "k", "g", "t", threshold).collect()}
    assert got == want and not all(want.values())


def test_near_duplicates_query_has_every_hit(spark):
    q, folder = entry.queries(), "/root/testdata/sf0.01"
    docs = load(spark, folder, "documents").select("doc_id", T.word_set(F.col("text")).alias("t"))
    rows = [(r.doc_id, "q", r.score, r.t) for r in q["bm25_documents"](spark, folder).join(docs, "doc_id").collect()]
    got = {(r.query, r.doc_id): r.kept for r in q["near_duplicates_greedy"](spark, folder).collect()}
    assert got == _greedy(rows, 0.9) and len(got) > 100
    with pytest.raises(ValueError):
        C.greedy_distinct(spark.range(1), "id", "id", "id", 0.0)


def test_packing_sees_every_chunk(spark):
    rng = random.Random(7)
    rows = [(f"src/f{rng.randrange(80)}.py", i, i + rng.randrange(3), f"m.f{i % 7}", rng.choice([1.0, 1.05, 1.1, 1.2, 2.0])) for i in range(1500)]
    rows += [("src/low.py", i, i, "m.g", 0.001 * i) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "path string, lineno int, end_lineno int, qualified_name string, score double")
    for focused, k in ((["src/low.py", "src/none.py", "src/f1.py"], 12), ([], 30)):
        left, used, want = list(rows), set(), []
        while len(want) < k:
            best = min(left, key=lambda r: (not (r[0] in focused and r[0] not in used), -(r[4] + (0.15 if r[0] in used else 0.0)), r[0], r[1], r[3], r[2]))
            left.remove(best)
            used.add(best[0])
            want.append((*best[:4], len(want) + 1))
        assert [tuple(r) for r in C.pack_greedy(df, focused, k).orderBy("place").collect()] == want
        assert not focused or "src/low.py" in used


def test_packing_query_promotes_its_focused_files(spark):
    got = entry.queries()["greedy_packing"](spark, SMALL).orderBy("place").collect()
    paths = sorted(r.path for r in files(spark, SMALL).select("path").collect())[:3]
    assert {r.path for r in got[:3]} == set(paths) and len(got) == 20


def test_facts_beyond_the_best_are_reached(spark):
    rng = random.Random(9)
    rows = [(f"t{i:04}", 0.9 - i * 0.0001, 0.5, 1, None, rng.choice([9, 40, 70])) for i in range(1500)] + [("short", 0.01, 0.0, 0, None, 3), ("shorter", 0.01, 0.0, 0, None, 1)]
    df = spark.createDataFrame(rows, "text string, confidence double, importance double, uses int, last_used timestamp, tokens int")
    want, left = [], 50
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(want) < 12 and r[5] <= left:
            left -= r[5]
            want.append(r[0])
    assert [r.text for r in M.ranked_facts(df, 12, 50).collect()] == want and len({"short", "shorter"} & set(want)) > 0
