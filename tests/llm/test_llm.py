"""Training-data operators against brute force, round trips and small cases."""

import base64
import random
from collections import Counter

import numpy as np
import pytest
from compare import compare, duck
from dirty import make
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import bpe, hnsw, packing, quantiles, stuffing
from quillon.llm.queries import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_sql(spark, name):
    why, _ = compare(spark, duck(SMALL), SMALL, registry.queries[name], registry.sql[name])
    assert not why


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return [make(tmp_path_factory.mktemp(k), k) for k in ("empty", "awkward")]


@pytest.mark.parametrize("name", sorted(registry.queries))
def test_dirty(spark, folders, name):
    for folder in folders:
        registry.queries[name](spark, folder).collect()


# percentiles


def summary(values, eps, group=0):
    v = np.array(values, float)
    return quantiles.compress(*quantiles.summarise(np.full(len(v), group), v), eps / 4)


def check_bounds(values, s):
    _, v, g, d = s
    values = np.sort(np.asarray(values, float))
    low = np.cumsum(g)
    assert low[-1] == len(values)
    # a value's ranks run from the number below it, plus one, to the number not above it
    first, last = np.searchsorted(values, v, "left") + 1, np.searchsorted(values, v, "right")
    assert (first <= low + d).all() and (low <= last).all()


def merged_in_levels(parts, eps, fan):
    """The parts merged ``fan`` at a time until one is left, as the operator does; with its level."""
    level = 0
    while len(parts) > 1:
        level += 1
        out = []
        for i in range(0, len(parts), fan):
            some = parts[i : i + fan]
            part = np.repeat(np.arange(len(some)), [len(o[0]) for o in some])
            group, v, g, d = (np.concatenate([o[j] for o in some]) for j in range(4))
            out.append(quantiles.compress(*quantiles.merge(group, part, v, g, d), eps / 2 ** (level + 2)))
        parts = out
    return parts[0], level


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=60), min_size=1, max_size=6), st.sampled_from([0.01, 0.1, 0.3, 0.9]), st.integers(2, 6))
def test_merged_summaries_keep_their_bounds(parts, eps, fan):
    got, _ = merged_in_levels([summary(p, eps) for p in parts], eps, fan)
    everything = [x for p in parts for x in p]
    check_bounds(everything, got)
    assert quantiles.errors(*got).max() <= eps * len(everything)


@pytest.mark.parametrize("fan", [2, 24, 500])
@pytest.mark.parametrize("values", ["spread", "ties", "ordered"])
def test_error_after_500_merges(fan, values):
    eps, rng = 0.01, np.random.default_rng(3)
    x = {"spread": rng.lognormal(4, 1.5, 1_000_000), "ties": np.floor(rng.lognormal(1, 1, 1_000_000)), "ordered": np.arange(1_000_000.0)}[values]
    got, level = merged_in_levels([summary(p, eps) for p in np.split(x, 500)], eps, fan)
    check_bounds(x, got)
    assert quantiles.errors(*got).max() <= eps * len(x) and len(got[0]) <= 8 * 2**level / eps + 2
    if fan == 500:
        assert len(got[0]) < 2_000


def test_merging_a_group_beyond_what_is_held(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.lognormal(4, 1.5, 300_000)
    rows = quantiles._summaries_of(["k"], 0.01)
    import pyarrow as pa

    batch = lambda v: pa.RecordBatch.from_arrays([pa.array(["hot"] * len(v)), pa.array(v)], ["k", "_value"])
    leaves = [next(rows(iter([batch(v)]))) for v in np.split(x, 300)]
    monkeypatch.setattr(quantiles, "HELD", 5_000)
    (out,) = quantiles._merge_of(["k"], 0.01)(iter(leaves))
    r = out.to_pylist()[0]
    assert r["n"] == len(x) and r["err"] <= 0.01 * len(x) and r["level"] >= 2
    check_bounds(x, (None, np.array(r["v"]), np.array(r["g"]), np.array(r["d"])))


def test_percentiles_over_partitions_and_days(spark):
    rng = random.Random(1)
    rows = [(("hot" if rng.random() < 0.4 else f"g{rng.randrange(5)}") if i % 50 else None, rng.choice([None, float("nan"), rng.lognormvariate(4, 1.5)]) if i % 9 == 0 else rng.lognormvariate(4, 1.5)) for i in range(20000)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    days = [quantiles.merge_sketches(quantiles.sketch(part, ["k"], "x", 0.01), ["k"], 0.01, fan_in=3) for part in df.randomSplit([0.5, 0.5], 3)]
    both = quantiles.bounds(quantiles.merge_sketches(days[0].unionByName(days[1]), ["k"], 0.01), {"p50": 50, "p95": 95})
    want: dict = {}
    for k, x in rows:
        if x is not None and x == x:
            want.setdefault(k, []).append(x)
    got = {r.k: r for r in both.collect()}
    assert set(got) == set(want)
    for k, xs in want.items():
        xs.sort()
        assert got[k].n == len(xs) and got[k].err <= 0.01 * len(xs)
        for name, q in (("p50", 50), ("p95", 95)):
            exact = xs[max(1, -(-q * len(xs) // 100)) - 1]
            assert got[k][name + "_low"] <= exact <= got[k][name + "_high"]


def test_stage_values_and_decision(spark):
    rows = [
        ("i1", 1, "r", None, '[{"stage_name":"a","elapsed_ms":"12.5"},{"stage_name":"b"},{"stage_name":"c","elapsed_ms":-1},{"stage_name":"d","elapsed_ms":true}]'),
        ("i1", 2, "r", None, '{"a": 7, "b": "n/a", "c": null, "d": "1e3", "e": "0x10", "f": "5d"}'),
        ("i2", None, "r", "p", '[{"elapsed_ms":4}]'),
        ("i3", 1, None, "p", '{"a": 9}'),
        (None, 1, "q", "p", '{"a": 1}'),
        (None, 1, "q", "p", '{"a": 2}'),
        ("i4", 1, "q", "p", "broken"),
        ("i5", 1, "q", "p", None),
    ]
    df = spark.createDataFrame(rows, "invocation_id string, finished_at int, repo_key string, profile_key string, stage_latency_json string")
    got = sorted(tuple(r) for r in quantiles.stage_values(quantiles.last_finished(df)).collect())
    assert got == [("q", "p", "a", 1.0), ("q", "p", "a", 2.0), ("r", "", "a", 7.0), ("r", "", "d", 1000.0)]
    values = spark.createDataFrame([("r", "p", "s", float(x)) for x in [100] * 94 + [999.5] * 1 + [1000.0] * 5] + [("r", "p", "t", float(x)) for x in [100] * 94 + [1000.0] * 6], "repo_key string, profile_key string, stage_name string, elapsed_ms double")
    for eps in (0.002, 0.5):  # a coarse summary leaves both open, counting settles them
        found = quantiles.decide(quantiles.slow_tails(values, eps), values)
        assert [r.stage_name for r in found.collect()] == ["t"]


# vectors


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n, 5):
        x[i + 1 : i + 3] = x[i] + rng.normal(size=(len(x[i + 1 : i + 3]), d)) * 0.1
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def recall(found, x, k):
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    best = np.argsort(-sims, axis=1)[:, :k]
    return np.mean([len(set(found.get(i, ())) & set(best[i])) / k for i in range(len(x))])


def test_graph_recall():
    x = clustered(3000, 32, 1)
    g = hnsw.Graph(x)
    a, b, _ = g.neighbours(3)
    found: dict = {}
    for i, j in zip(a, b):
        found.setdefault(i, []).append(j)
    assert recall(found, x, 3) > 0.93
    ids, sims = g.search(x[:500], 1)
    assert np.mean(ids[:, 0] == np.arange(500)) > 0.98 and np.allclose(sims[:, 0], 1, atol=1e-3)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_graph_of_few(n):
    g = hnsw.Graph(clustered(10, 8, 2)[:n])
    assert len(g.neighbours(3)[0]) == n * min(3, max(0, n - 1))


def test_nearest_in_shards_with_copies(spark):
    x = clustered(4000, 24, 3)
    x[1000:1400] = x[999]  # a tenth are copies of one vector
    rows = [(int(i), "a" if i % 2 else None, v.tobytes()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, s string, unit binary")
    got = hnsw.nearest(df, ["s"], k=3, least=0.9, shard=500).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r.vec_id_a, []).append(r.vec_id_b)
    assert max(map(len, found.values())) <= 3
    hit = total = 0
    for parity in (0, 1):
        ids = np.arange(parity, 4000, 2)
        sims = x[ids].astype(float) @ x[ids].T.astype(float)
        np.fill_diagonal(sims, -2)
        for at, i in enumerate(ids):
            want = [int(ids[j]) for j in np.lexsort((ids, -np.round(sims[at], 5)))[:3] if sims[at][j] >= 0.9]
            total += len(want)
            hit += len(set(want) & set(found.get(int(i), ())))
    assert hit / total > 0.95
    copies = [i for i in range(999, 1400) if i % 2]
    assert found[copies[-1]] == copies[:3]


def test_hot_shards_are_cut(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_LIMIT", 300)
    x = clustered(900, 16, 4)
    df = spark.createDataFrame([(i, "s", v.tobytes()) for i, v in enumerate(x)], "vec_id bigint, s string, unit binary")
    found: dict = {}
    for r in hnsw.nearest(df, ["s"], k=3, shard=2000).collect():
        found.setdefault(r.vec_id_a, []).append(r.vec_id_b)
    assert recall(found, x, 3) > 0.93


@pytest.mark.parametrize("search", [False, True])
def test_large_shards_are_split_by_their_own_pivots(spark, monkeypatch, search):
    monkeypatch.setattr(hnsw, "SHARD_LIMIT", 400)
    monkeypatch.setattr(hnsw, "PIVOTS", 4)
    monkeypatch.setattr(hnsw, "CELL_ROWS", 500)
    x = clustered(3000, 16, 8)
    df = spark.createDataFrame([(i, "s", v.tobytes()) for i, v in enumerate(x)], "vec_id bigint, s string, unit binary")
    nodes = df.select(F.lit("s").alias("space"), F.col("vec_id").alias("node"), "unit")
    placed = nodes.mapInArrow(hnsw._assign(hnsw.pivots(nodes, 150), 0.08, 4), hnsw._PLACED)
    before = placed.groupBy("space", "shard").count().agg(F.max("count")).first()[0]
    split = hnsw.split_large(placed, 150, 0.08, 4)
    after = split.groupBy("space", "shard").count().agg(F.max("count")).first()[0]
    assert before > 400 and after < before / 2 and split.select("node").distinct().count() == 3000
    found: dict = {}
    for r in hnsw.nearest(df, ["s"], k=3, shard=150, search=search).collect():
        found.setdefault(r.vec_id_a, []).append(r.vec_id_b)
    # the two planted partners of every fifth vector
    hit = [len(set(found.get(i, ())) & {i + 1, i + 2}) / 2 for i in range(0, 2995, 5)]
    assert np.mean(hit) > 0.95


@pytest.mark.parametrize("text", [None, "", "[1, 2", "[]", "[1]", "[1, null]", '[1, "2"]', "[0, 0]", "[1, true]", "{}", "[1, NaN]", "[1, 1e999]"])
def test_unusable_vectors(text):
    assert hnsw.read_vector(text, 2) is None


def test_usable_vectors():
    assert np.allclose(hnsw.read_vector("[3, 4.0]", 2), [0.6, 0.8]) and np.allclose(hnsw.read_vector("[3e300, 4e300]", 2), [0.6, 0.8])
    assert hnsw.read_vector("[1]", None) is None


# tokens


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    assert bpe.PATTERN == P.PATTERN
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text):
    return np.frombuffer(bpe._encoder(bpe.VOCABULARY).encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinsth AB'12\n_-="), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoding_equals_reference(reference, text):
    ids = encode(text)
    assert ids == reference.encode_ordinary(text)
    d = bpe.Decoder()
    assert "".join(d.feed([i]) for i in ids) + d.close() == text


def test_long_words_and_blocks(reference):
    rng = random.Random(2)
    for text in ("a" * 3000, "=-" * 1500, "".join(rng.choice("abcdeinst") for _ in range(3000)), " " * 2000 + "x", "Ã" * 800, "<|endoftext|> x"):
        assert encode(text) == reference.encode_ordinary(text)
    text = " ".join("".join(rng.choice("ab1'é。") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    assert "".join(bpe.blocks(text, 300)) == text
    assert [i for b in bpe.blocks(text, 300) for i in encode(b)] == reference.encode_ordinary(text)
    chunks = [text[i : i + 7] for i in range(0, 4000, 7)]
    assert list(bpe.encode_stream(chunks)) == reference.encode_ordinary("".join(chunks))


def test_transducer_emits_early_and_holds_little(reference):
    m = bpe._encoder(bpe.VOCABULARY).m
    t = bpe.Transducer(m)
    out, held = [], 0
    for i in range(40):
        out += t.feed(b"abcdeinst" * 60)
        held = max(held, len(t.held))
    assert out and held <= 3 * t.wait + m.longest
    assert out + t.close() == reference.encode_ordinary("abcdeinst" * 60 * 40)


def test_null_and_empty_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello", "x"), (3, "hello", "x")], "doc_id bigint, text string, ids string")
    assert sorted((r.doc_id, r.ids) for r in bpe.encode_texts(df).collect()) == [(1, []), (2, []), (3, [31373]), (3, [31373])]
    assert sorted(r.n_tokens for r in bpe.count_tokens(df).collect()) == [0, 0, 1, 1]


# containers


def held(patterns):
    out: Counter = Counter()
    for p in patterns:
        for s, m in p.content:
            out[s] += m * p.repeat
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=15), st.sampled_from([40, 60]))
def test_plans_hold_all_and_fit(count, capacity):
    patterns = packing.plan(count, capacity)
    assert held(patterns) == Counter(count) and all(p.used <= capacity for p in patterns)
    for rows in packing.segments(patterns).values():
        assert (np.diff(rows[:, 0]) > 0).all()


def fewest(items, capacity):
    """The least number of containers, by trying all places."""
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= items[i]}:
            j = rooms.index(r)
            go(i + 1, [*rooms[:j], r - items[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_dominance_never_costs_a_container(items):
    items = sorted(items, reverse=True)
    fixed, rest = packing.reduce_dominated(Counter(items), 20)
    left = sorted(Counter(rest).elements(), reverse=True)
    assert sum(p.repeat for p in fixed) + (fewest(left, 20) if left else 0) == fewest(items, 20)


def test_packing_places(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, None, 1, 5, 50, 100, 101, 250, rng.randrange(1, 130)]) for _ in range(2000)]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "doc_id bigint, n_tokens bigint, size int")
    rows = packing.pack(df, 100, rows_per_bucket=200).toPandas()
    assert sorted(set(rows.doc_id)) == list(range(2000))
    full = rows[rows.n_tokens > 0].sort_values(["container", "place"])
    assert full.container.notna().all() and rows[rows.n_tokens <= 0].container.isna().all()
    assert full.n_tokens.sum() == sum(s or 0 for s in sizes)
    by = full.groupby("container")
    assert by.n_tokens.sum().max() <= 100
    assert (full.container_start == by.n_tokens.cumsum() - full.n_tokens).all() and (full.place == by.cumcount()).all()
    assert sorted(full.container.unique()) == list(range(full.container.nunique()))
    assert full.container.nunique() <= -(-full.n_tokens.sum() // 100) * 1.01 + 1
    whole = {i for i, s in enumerate(sizes) if s and s <= 100}
    assert full[full.doc_id.isin(whole)].groupby("doc_id").size().max() == 1


# stuffing

NOUNS = "reader file row note stage budget graph folder record signal window branch ledger oracle cursor".split()
VERBS = "opens checks moves reads keeps drops joins writes sorts finds".split()


def prose(rng, n):
    """Lines of made-up sentences."""
    one = lambda: f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(['each', 'the next', 'no', 'its own'])} {rng.choice(NOUNS)}, and {rng.choice(['nobody', 'the log', 'a test'])} {rng.choice(['knows', 'tells', 'shows'])} why {rng.randrange(99)} of them {rng.choice(['fail', 'stay', 'are late'])}."
    return "".join(" ".join(one() for _ in range(3)) + "\n" for _ in range(n))




def test_stuffed_pages(spark):
    rng = random.Random(5)
    words = "buy cheap online free best trial pro lite code search plan tool index".split()
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    spam = {
        1: ", ".join(pick(3) for _ in range(80)),
        2: "\n".join(f"- [{pick(2)}](https://x{i}.test/{rng.randrange(99)})" for i in range(40)),
        3: "".join("#" + pick(2).replace(" ", "-") for _ in range(80)),
        4: "\n".join(f"{pick(3)} - {rng.randrange(200)}.99 USD" for _ in range(40)),
        5: prose(rng, 1) + "\n".join(f"{i}. {pick(2)} : http://y{i}.test/a" for i in range(40)),
        6: "买便宜 代码搜索, " * 60,
        7: "buy (cheap) <b>online</b> best = deal\n" * 40,
        8: "Cheap hotels. Best hotels. Hotels online. " * 40,
        9: " ".join(f"{pick(4).capitalize()} {rng.choice(['for', 'and', 'with'])} {pick(2)}{rng.choice('.!?')}" for _ in range(50)),
    }
    plain = {
        11: prose(rng, 5),
        12: "\n".join(f"2026-01-{i:02d}T00:00:00Z WARN retry {i} of 30: not ready" for i in range(1, 30)),
        13: "import a\nimport b\n\ndef f(x):\n    y = x + 1\n    return [y for z in x]\n" * 8,
        14: "\n".join(f"lib-{w}==1.{i}.0" for i, w in enumerate(words * 3)),
        15: "| key | value |\n|---|---|\n" + "\n".join(f"| {w} | {i} |" for i, w in enumerate(words * 3)),
        16: "\n".join(f"**{w}**: {prose(rng, 1).strip()}" for w in words),
        17: prose(rng, 20) + "\n".join(f"- https://z.test/{i}" for i in range(8)),
        18: "data:" + base64.b64encode(rng.randbytes(900)).decode(),
        19: None,
        20: "",
        21: " \n\t ",
        22: "word",
        24: "?",
        25: "\n".join(f"{prose(rng, 1)[:60]}\n{prose(rng, 1)[:64]}" for _ in range(12)),
        26: "for (i = 0; i < n; i++) {\n  total += rows[i];\n}\n" * 20,
        23: prose(rng, 12) + spam[1][:600],
    }
    many = {100 + i: prose(rng, 1 + i % 7) for i in range(40)}
    rows = [(i, t, "clash") for i, t in {**spam, **plain, **many}.items()]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, chars string")
    assert sorted(r.doc_id for r in stuffing.stuffed(df).collect()) == sorted(spam)
    assert stuffing.stuffed(df.limit(0)).count() == 0


def test_script_of():
    assert [stuffing.script_of(t) for t in ("plain text", "Größe", "привет мир", "购买便宜 code", "無料のコード検索")] == ["latin", "latin", "cyrillic", "han", "kana"]


def test_kind_does_not_depend_on_where_a_long_line_is_cut():
    rng = random.Random(6)
    words = "buy cheap online free best trial pro lite code search".split()
    line = "The reader opens the file and it is there. " + " ".join(rng.choice(words) for _ in range(3000))
    for text in (line, line[::-1]):
        assert len({k for k, _, _ in stuffing.blocks(text)}) == 1
    assert sum(len(b) for _, _, b in stuffing.blocks(line)) == len(line)


def test_usual_ratios_by_language(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 3), lang) for i, lang in enumerate(["en"] * 60 + ["EN"] * 10 + ["xx"] * 5 + [None] * 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = stuffing.usual_ratios(stuffing.measured_blocks(df)).collect()
    assert {r.lang for r in got} == {"en", ""} and all(0 < r.usual < 1 and 0 < r.usual_bag for r in got)


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2] / "quillon"
    for p in root.rglob("*.py"):
        assert "llm" in p.parts or "quillon.llm" not in p.read_text(), p
