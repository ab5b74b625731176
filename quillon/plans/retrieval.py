"""Queries of ranking, fusion, vectors, chunks and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunks as C
from quillon.operators import planning as P
from quillon.operators import ranking as R
from quillon.operators import vector as V
from quillon.plans.adapters import CHUNKS_SQL, FILES_SQL, PARTS_SQL, chunks, files, low, parts, words_sql
from quillon.plans.registry import Registry
from quillon.sources import markdown
from quillon.sources.tables import load

registry = Registry()
TERMS = ["ranker", "token", "budget", "index"]


def _bm25_sql(source: str, key: str, terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    norm = "(0.25 + 0.75 * (len / avg))"
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * {norm}) ELSE 0 END" for i in range(len(terms)))
    matched = " + ".join(f"CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END" for i in range(len(terms)))
    return f"""WITH tok AS ({source}), docs AS (SELECT {key}, len(t) AS len, {tf} FROM tok WHERE len(t) > 0), stats AS (SELECT count(*) AS n, avg(len) AS avg, {df} FROM docs)
    SELECT * FROM (SELECT {key}, round(4.0 * ({score}), 6) AS score, {matched} AS matched FROM docs, stats) WHERE score > 0"""


@registry.query(_bm25_sql(f"SELECT doc_id, {words_sql('text')} AS t FROM documents", "doc_id", TERMS))
def bm25_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", T.words(F.col("text")).alias("t"))
    return R.bm25(docs, "doc_id", "t", TERMS, 1e-9)


@registry.query(f"SELECT doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_bm25_sql(f'SELECT doc_id, {words_sql("text")} AS t FROM documents', 'doc_id', TERMS)})) WHERE rank <= 20")
def bm25_top(spark: SparkSession, folder: str) -> DataFrame:
    return R.top(bm25_documents(spark, folder).select("doc_id", "score"), "doc_id", 20)


FILE_TERMS = ["parser", "table", "src", "docs"]


def _heuristic_sql(terms: list[str]) -> str:
    out = []
    for q in terms:
        short = len(q) < 4
        p = f"WHEN starts_with(p, '{q}') OR contains(p, '/{q}') THEN 3.0" + ("" if short else f" WHEN contains(p, '{q}') THEN 2.0")
        m = f"WHEN m = '{q}' THEN 3.0 WHEN ends_with(m, '.{q}') THEN 2.5" + ("" if short else f" WHEN contains(m, '{q}') THEN 1.5")
        hits = lambda c: f"len(list_filter({c}, lambda x: contains(x, '{q}')))"  # noqa: E731,B023
        exact = f"list_contains(s, '{q}')"
        out += [f"CASE {p} ELSE 0 END", f"CASE {m} ELSE 0 END"]
        out.append(f"CASE WHEN {exact} THEN 3.0 ELSE {'0' if short else f'least(2.0, 0.75 * {hits("s")})'} END")
        if not short:
            out += [f"least(1.5, 0.5 * {hits('i')})", f"CASE WHEN {exact} THEN 0 ELSE least(1.0, 0.2 * {hits('s')} + 0.1 * {hits('i')}) END"]
    base = " + ".join(out)
    return f"""WITH {FILES_SQL}, f AS (
      SELECT path, tier, {low('path')} AS p, {low('module')} AS m, list_transform(symbols, lambda x: {low('x')}) AS s, list_transform(imports, lambda x: {low('x')}) AS i FROM files
    ), b AS (SELECT path, tier, {base} AS base, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM f)
    SELECT path, score FROM (SELECT path, round((base + CASE WHEN base > 0 AND (starts_with(path, 'src/') OR starts_with(path, 'api/') OR starts_with(path, 'ui/')) THEN greatest(0.0, 1.4 - depth * 0.15) ELSE 0 END)
      * CASE WHEN tier = 'dependency' THEN 0.35 ELSE 1 END, 6) AS score FROM b) WHERE score >= 1"""


@registry.query(_heuristic_sql(FILE_TERMS))
def heuristic_files(spark: SparkSession, folder: str) -> DataFrame:
    return R.heuristic(files(spark, folder), FILE_TERMS, 1.0)


@registry.query()
def bm25_files(spark: SparkSession, folder: str) -> DataFrame:
    return R.file_bm25(files(spark, folder), FILE_TERMS, 1e-9)


@registry.query()
def bm25_two_stage(spark: SparkSession, folder: str) -> DataFrame:
    return R.bm25_two_stage(files(spark, folder), FILE_TERMS, 10)


_COVERAGE_SQL = " + ".join(f"CASE WHEN regexp_matches(b, '(^|[^a-z]){q}([^a-z]|$)') THEN 1.0 WHEN contains(b, '{q}') THEN 0.5 ELSE 0 END" for q in FILE_TERMS)


@registry.query(f"""WITH {FILES_SQL}, x AS (SELECT path, {low("concat_ws(' ', path, module, array_to_string(symbols, ' '), array_to_string(imports, ' '))")} AS b FROM files)
  SELECT path, CAST(least(1.0, ({_COVERAGE_SQL}) / {len(FILE_TERMS)}) AS DOUBLE) AS coverage FROM x""")
def term_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return R.coverage(files(spark, folder), FILE_TERMS)


@registry.query()
def hybrid_linear(spark: SparkSession, folder: str) -> DataFrame:
    return R.hybrid(files(spark, folder), FILE_TERMS)


@registry.query()
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return R.hybrid(files(spark, folder), FILE_TERMS, mode="rrf")


@registry.query()
def initial_selection(spark: SparkSession, folder: str) -> DataFrame:
    return R.select_initial(files(spark, folder), FILE_TERMS, "bm25_lite", 2.0, 10)


CHANNELS = {"price": 400, "size": 100, "qty": 300, "orders": 200}


def _rank(df: DataFrame, column: str, cap: int) -> DataFrame:
    return df.orderBy(F.desc(column), "p_partkey").limit(cap).select("p_partkey", F.row_number().over(W.orderBy(F.desc(column), "p_partkey")).alias("rank"))


_CHANNEL_SQL = " UNION ALL ".join(f"SELECT p_partkey, rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY {c} DESC, p_partkey) AS rank FROM parts) WHERE rank <= {n}" for c, n in CHANNELS.items())


@registry.query(f"WITH {PARTS_SQL}, fused AS (SELECT p_partkey, sum(1.0 / (60 + rank)) AS rrf FROM ({_CHANNEL_SQL}) GROUP BY 1) SELECT p_partkey, round(price, 6) AS score, round(coalesce(rrf, 0), 9) AS rrf FROM parts LEFT JOIN fused USING (p_partkey)")
def rrf_channels(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder)
    pool = p.select("p_partkey", F.round("price", 6).alias("score"))
    return R.fuse_channels(pool, {c: (_rank(p, c, n), n) for c, n in CHANNELS.items()}, "p_partkey").withColumn("rrf", F.round("rrf", 9))


@registry.query(f"WITH {PARTS_SQL}, fused AS (SELECT p_partkey, sum(1.0 / (60 + rank)) AS rrf FROM ({_CHANNEL_SQL}) GROUP BY 1) SELECT p_partkey, round(rrf / max(rrf) OVER (), 6) AS score FROM fused")
def rrf_normalised(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder)
    return R.over_max(R.rrf([_rank(p, c, n) for c, n in CHANNELS.items()], "p_partkey"), "rrf", "score").select("p_partkey", F.round("score", 6).alias("score"))


@registry.query("""WITH commits AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS idx FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 2000))
  SELECT l_partkey AS path, round(sum(1.0 / idx), 6) AS score, count(*) AS commits FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN commits ON l_orderkey = o_orderkey GROUP BY 1""")
def history_channel(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 2,000 commits (orders), each file (part) scored by 1 / place of its commits."""
    newest = load(spark, folder, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(2000)
    commits = newest.select("o_orderkey", F.row_number().over(W.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("idx"))
    touched = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("path")).distinct()
    return touched.join(F.broadcast(commits), "o_orderkey").groupBy("path").agg(F.round(F.sum(F.lit(1.0) / F.col("idx")), 6).alias("score"), F.count("*").alias("commits"))


_HITS_SQL = "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?i)\\b(?:ranker|budget)\\b')) AS hits FROM documents"


@registry.query(f"WITH h AS (SELECT * FROM ({_HITS_SQL}) WHERE hits > 0) SELECT doc_id, CAST(hits AS INT) AS hits, round(least(1.0, ln(1 + hits) / ln(1 + max(hits) OVER ())), 6) AS exact FROM h")
def exact_search(spark: SparkSession, folder: str) -> DataFrame:
    scored = R.exact_scores(R.exact_hits(load(spark, folder, "documents"), "doc_id", "text", ["ranker", "budget"]))
    return scored.select("doc_id", "hits", F.round("exact", 6).alias("exact"))


@registry.query(f"""WITH h AS (SELECT * FROM ({_HITS_SQL}) WHERE hits > 0), e AS (SELECT doc_id, round(least(1.0, ln(1 + hits) / ln(1 + max(hits) OVER ())), 6) AS exact FROM h),
  c AS ({_bm25_sql(f"SELECT doc_id, {words_sql('text')} AS t FROM documents", 'doc_id', ["token", "index"])}), t AS (SELECT max(score) AS top FROM c)
  SELECT doc_id, round(coalesce(score, 0.15 * top) + coalesce(exact, 0) * greatest(1.0, 0.35 * top), 6) AS score, score IS NULL AS injected FROM (SELECT doc_id, score FROM c) FULL JOIN e USING (doc_id), t""")
def exact_boost(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", T.words(F.col("text")).alias("t"))
    found = R.bm25(docs, "doc_id", "t", ["token", "index"], 1e-9)
    return R.exact_boost(found, exact_search(spark, folder), "doc_id")


_PATHS = r"[a-z_]+(?:/[a-z_]+)+\.(?:py|ts|go|rs)"


@registry.query(f"""WITH f AS (SELECT unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '{_PATHS}'))) AS value, 1.0 / (1 + doc_id % 5) AS w FROM documents),
  s AS (SELECT value, sum(w) AS raw FROM f GROUP BY 1) SELECT value, round(raw / max(raw) OVER (), 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 12""")
def hint_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve paths most mentioned; a document weighs 1 / (1 + doc_id mod 5)."""
    return R.hint_scores(load(spark, folder, "documents"), "text", F.lit(1.0) / (F.lit(1) + F.col("doc_id") % 5), _PATHS)


@registry.query(f"""WITH t AS (SELECT unnest({words_sql('text')}) AS token, 1.0 AS w FROM documents UNION ALL SELECT unnest({words_sql('path')}), 2.0 FROM documents)
  SELECT token, round(sum(w), 6) AS score FROM t WHERE length(token) >= 3 AND token NOT IN ('the', 'and') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def glossary(spark: SparkSession, folder: str) -> DataFrame:
    return R.glossary(load(spark, folder, "documents"), {"text": 1.0, "path": 2.0}, ["the", "and"], 50)


@registry.query(f"WITH {PARTS_SQL} SELECT p_partkey, round(price + 0.5 * qty + 2.0 * orders, 6) AS score, CAST(qty AS DOUBLE) AS qty, CAST(orders AS DOUBLE) AS orders FROM parts")
def priors(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder)
    sig = lambda c: p.select("p_partkey", F.col(c).cast("double").alias("value"))
    return R.priors(p.select("p_partkey", F.col("price").alias("score")), "p_partkey", {"qty": (sig("qty"), 0.5), "orders": (sig("orders"), 2.0)})


@registry.query(f"""WITH {PARTS_SQL}, r AS (SELECT p_partkey, price AS score, 1 AS pass FROM parts WHERE size < 30 UNION ALL SELECT p_partkey, qty * 2.0, 2 FROM parts WHERE size > 10)
  SELECT p_partkey, round(score, 6) AS score, CAST(pass AS INT) AS pass FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, pass) = 1) ORDER BY score DESC, p_partkey LIMIT 100""")
def second_pass(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder)
    a = p.where(F.col("size") < 30).select("p_partkey", F.col("price").alias("score"))
    b = p.where(F.col("size") > 10).select("p_partkey", (F.col("qty") * 2.0).alias("score"))
    return R.merge_passes(a, b, "p_partkey", 100).withColumn("score", F.round("score", 6))


@registry.query("SELECT p_partkey, p_retailprice AS score FROM part WHERE p_retailprice >= 0.8 * (SELECT max(p_retailprice) FROM part)")
def relative_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return R.relative_threshold(load(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("score")), 0.8)


@registry.query("SELECT doc_id, path FROM documents WHERE (regexp_matches(path, '^src/') OR regexp_matches(path, '^[^/]*\\.md$')) AND NOT regexp_matches(path, '\\.rs$')")
def path_filters(spark: SparkSession, folder: str) -> DataFrame:
    return R.path_filter(load(spark, folder, "documents").select("doc_id", "path"), "path", ["src/**", "*.md"], ["**/*.rs", "*.rs"])


@registry.query(f"""WITH s AS (SELECT doc_id, score, coalesce(source, '') IN ('docs', 'wiki') AS d FROM ({_bm25_sql(f"SELECT doc_id, {words_sql('text')} AS t FROM documents", 'doc_id', TERMS)}) JOIN documents USING (doc_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, doc_id) AS n FROM s)
  SELECT doc_id, score, CAST(place AS INT) AS place FROM (SELECT doc_id, score, row_number() OVER (ORDER BY CASE WHEN d AND n <= 2 THEN 0 WHEN NOT d AND n <= 2 THEN 1 ELSE 2 END, score DESC, doc_id) AS place FROM n WHERE n <= 10) WHERE place <= 10""")
def mixed_top_k(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "source")
    ranked = bm25_documents(spark, folder).join(docs, "doc_id")
    return R.quota_top_k(ranked, "doc_id", F.coalesce("source", F.lit("")).isin("docs", "wiki"), 10)


@registry.query(f"""SELECT repo_key, round(file_count / 1000.0 + CASE WHEN contains({low('repo_key')}, 'ga') THEN 2 WHEN contains({low("main_language || ' ' || tier")}, 'ga') THEN 1 ELSE 0 END
  + CASE WHEN contains({low('repo_key')}, 'go') THEN 2 WHEN contains({low("coalesce(main_language, '') || ' ' || coalesce(tier, '')")}, 'go') THEN 1 ELSE 0 END, 6) AS score FROM repositories ORDER BY 2 DESC, 1 LIMIT 10""")
def workspace_routing(spark: SparkSession, folder: str) -> DataFrame:
    return R.route(load(spark, folder, "repositories"), "repo_key", F.col("file_count") / 1000.0, F.col("repo_key"), F.concat_ws(" ", T.text("main_language"), T.text("tier")), ["ga", "go"], 10)


@registry.query()
def skill_routing(spark: SparkSession, folder: str) -> DataFrame:
    skills = load(spark, folder, "repositories").select(
        F.col("repo_key").alias("name"), F.array(T.text("tier")).alias("intents"), F.array(T.text("main_language")).alias("modules"), F.array("repo_key").alias("topics"),
        F.array(F.lit("timeout")).alias("errors"), T.text("main_language").alias("description"), F.col("file_count").alias("priority"),
    )
    return R.select_skills(skills, "go parser timeout in griba", "first_party", "go", 5)




@registry.query(f"""WITH {FILES_SQL}, s AS (SELECT module, max(len(symbols)) AS score FROM files GROUP BY 1 HAVING max(len(symbols)) > 0),
  o AS (SELECT DISTINCT replace(regexp_replace(path, '\\.[a-z]+$', ''), 'src/', '') AS p FROM files), m AS (SELECT DISTINCT replace(p, '/', '.') AS module FROM o)
  SELECT m.module, CAST(coalesce((SELECT max(score) FROM s WHERE s.module = m.module), (SELECT max(score) FROM s WHERE ends_with('.' || s.module, '.' || m.module) OR ends_with('.' || m.module, '.' || s.module)), 0) AS DOUBLE) AS match FROM m""")
def module_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """The modules of all files, by which the names of all files without ``src/`` are scored."""
    f = files(spark, folder)
    scores = f.groupBy("module").agg(F.max(F.size("symbols")).cast("double").alias("score")).where(F.col("score") > 0)
    module = F.translate(F.replace(F.regexp_replace("path", r"\.[a-z]+$", ""), F.lit("src/"), F.lit("")), "/", ".")
    return R.suffix_score(f.select(module.alias("module")), scores)


@registry.query(f"WITH {PARTS_SQL}, h AS (SELECT * FROM parts ORDER BY price DESC, p_partkey LIMIT 64) SELECT p_partkey, round(price + 3.0 * ln(1 + qty) / ln(1 + max(qty) OVER ()) + 1.0 * ln(1 + orders) / ln(1 + max(orders) OVER ()), 6) AS score, true AS in_pool FROM h UNION ALL SELECT p_partkey, round(price, 6), false FROM parts WHERE p_partkey NOT IN (SELECT p_partkey FROM h)")
def graph_lookup_rerank(spark: SparkSession, folder: str) -> DataFrame:
    p = parts(spark, folder).withColumnRenamed("price", "score")
    out = R.pool_rerank(p, "p_partkey", {"qty": 3.0, "orders": 1.0}, 64)
    return out.withColumn("score", F.round("score", 6))


@registry.query(f"""WITH s AS (SELECT doc_id, n_chars, len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS n FROM documents WHERE n_chars IS NOT NULL),
  r AS (SELECT doc_id, n_chars AS score, sum(n) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM s) SELECT doc_id, score, CAST(running AS BIGINT) AS running FROM r WHERE running <= 20000""")
def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").where(F.col("n_chars").isNotNull()).select("doc_id", F.col("n_chars").alias("score"), T.estimate_tokens(F.col("text")).alias("n"))
    return R.budget_prefix(docs, "doc_id", "n", 20000)


@registry.query(f"""WITH t AS (SELECT path, score FROM ({_heuristic_sql(FILE_TERMS)}) ORDER BY score DESC, path LIMIT 20), pins AS (SELECT * FROM (VALUES ('src/pinned.py', 0), ('docs/pinned.md', 1)) v(path, focus)), peak AS (SELECT coalesce(max(score), 0) AS top FROM t)
  SELECT path, CASE WHEN focus IS NOT NULL THEN top + 1 - focus * 0.001 ELSE score END AS score, CAST(focus AS INT) AS focus FROM t FULL JOIN pins USING (path), peak""")
def focused(spark: SparkSession, folder: str) -> DataFrame:
    ranked = R.top(heuristic_files(spark, folder), "path", 20).select("path", "score")
    return R.focus(ranked, "path", ["src/pinned.py", "docs/pinned.md"])


# --- vectors


@registry.query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct({words_sql('text')})) AS token FROM documents), s AS (
  SELECT doc_id, CAST(('0x' || substr(sha256(token), 1, 8)) AS BIGINT) % 32 AS slot, sum(CASE WHEN CAST(('0x' || substr(sha256(token), 9, 2)) AS INT) % 2 = 0 THEN 1.0 ELSE -1.0 END * CASE WHEN length(token) >= 8 THEN 1.25 ELSE 1.0 END) AS w FROM t GROUP BY 1, 2),
  n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM s GROUP BY 1) SELECT doc_id, slot, round(w / norm, 6) + 0.0 AS value FROM s JOIN n USING (doc_id) WHERE norm > 0""")
def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    tokens = load(spark, folder, "documents").select("doc_id", F.explode(T.word_set(F.col("text"))).alias("token"))
    return V.hash_slots(tokens, "doc_id", "token", 32).withColumn("value", F.round("value", 6) + 0.0)


_QUERY_VECTOR = "(SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    return list(load(spark, folder, "embeddings").orderBy("vec_id").select("embedding").first()[0])


@registry.query(f"SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_QUERY_VECTOR}), 5) AS similarity FROM embeddings")
def cosine_all(spark: SparkSession, folder: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, folder)])
    return load(spark, folder, "embeddings").select("vec_id", F.round(V.cosine(F.col("embedding"), q), 5).alias("similarity"))


@registry.query(f"""WITH s AS (SELECT vec_id, CAST(vec_id % 97 AS DOUBLE) AS score, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_QUERY_VECTOR}) AS sim FROM embeddings),
  h AS (SELECT vec_id, score, CASE WHEN sim < 0.1 THEN 0 ELSE sim END AS sim FROM s ORDER BY score DESC, vec_id LIMIT 50)
  SELECT vec_id, round(0.6 * (score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0) + 0.4 * (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()), 5) AS score, 1 AS in_pool FROM h""")
def cosine_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The head of a reranking by a given score and similarity."""
    df = load(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % 97).cast("double").alias("score"), F.col("embedding").alias("vector"))
    out = V.rerank_with_vectors(df.select("vec_id", "score"), "vec_id", df, _query_vector(spark, folder), 50, lexical=0.6, semantic=0.4, floor=0.1)
    return out.where(F.col("in_pool") == 1).select("vec_id", F.round("score", 5).alias("score"), "in_pool")


@registry.query(f"SELECT doc_id, round(CASE WHEN list_contains(t, 'ranker') THEN 1.0 ELSE 0 END + CASE WHEN list_contains(t, 'token') THEN 0.5 ELSE 0 END, 6) AS score FROM (SELECT doc_id, {words_sql('text')} AS t FROM documents)")
def late_interaction(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", F.round(V.late_interaction(T.words(F.col("text")), {"ranker": 1.0, "token": 0.5}), 6).alias("score"))


@registry.query(f"""SELECT doc_id, round(greatest(0, least(1, 0.85 * len(list_intersect(['ranker', 'token'], t)) / 2.0 + 0.15 * CAST(('0x' || substr(sha256('ranker token' || chr(10) || x), 1, 8)) AS BIGINT) / 4294967296.0)), 6) AS score
  FROM (SELECT doc_id, coalesce(text, '') AS x, {words_sql('text')} AS t FROM documents)""")
def hash_cross_encoder(spark: SparkSession, folder: str) -> DataFrame:
    score = V.hash_cross_score("ranker token", F.col("text"), T.words(F.col("text")), ["ranker", "token"])
    return load(spark, folder, "documents").select("doc_id", F.round(score, 6).alias("score"))


# --- sections


@registry.query()
def doc_sections(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.heading_paths(markdown.sections(load(spark, folder, "documents"), "doc_id", "text"), "doc_id")


@registry.query("""SELECT doc_id, regexp_extract(x, '^\\[(.*)\\]\\(', 1) AS label, regexp_extract(x, '\\(([^)]*)\\)$', 1) AS target
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\\[[^\\]\\n]*\\]\\([^)\\s]+\\)')) AS x FROM documents)""")
def doc_links(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.links(load(spark, folder, "documents"), "doc_id", "text")


@registry.query()
def section_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """Sections ranked by BM25 over heading, path and body, whose tokens count 3, 2 and 1 times."""
    s = doc_sections(spark, folder).withColumn("key", F.concat_ws("#", "doc_id", "section"))
    tokens = F.flatten(F.array(*[T.words(F.col("heading"))] * 3, *[T.words(F.col("path"))] * 2, T.words(F.col("body"))))
    return R.bm25(s.select("key", tokens.alias("t")), "key", "t", ["ranker", "cache", "index"], 1e-9)


# --- chunks


@registry.query(f"WITH {CHUNKS_SQL} SELECT qualified_name AS name, count(*) AS hits FROM chunks GROUP BY 1")
def reference_hits(spark: SparkSession, folder: str) -> DataFrame:
    return C.reference_hits(chunks(spark, folder).select(F.col("qualified_name").alias("name")))


_CHUNK_TERMS = ["table", "score"]


def _chunk_sql() -> str:
    name = f"list_extract(string_split({low('qualified_name')}, '.'), -1)"
    out = []
    for q in _CHUNK_TERMS:
        out += [f"CASE WHEN contains({low('c.path')}, '{q}') THEN 1.0 ELSE 0 END", f"CASE WHEN contains({low('module')}, '{q}') THEN 0.8 ELSE 0 END"]
        out.append(f"CASE WHEN {name} = '{q}' OR {low('qualified_name')} = '{q}' THEN 2.5 WHEN contains({low('qualified_name')}, '{q}') THEN 1.4 ELSE 0 END")
        out.append(f"CASE WHEN contains({low('kind')}, '{q}') THEN 0.5 ELSE 0 END")
    return f"""WITH {FILES_SQL}, d AS (SELECT DISTINCT path, lineno, end_lineno, qualified_name, kind FROM chunks), h AS (SELECT qualified_name, count(*) AS hits FROM chunks GROUP BY 1)
      SELECT c.path, c.lineno, c.end_lineno, c.qualified_name, round(0.35 * len(symbols) + {' + '.join(out)} + least(2.5, 0.3 * hits), 6) AS score
      FROM d c JOIN files f ON c.path = f.path JOIN h USING (qualified_name)"""


@registry.query(_chunk_sql())
def chunk_scores(spark: SparkSession, folder: str) -> DataFrame:
    f = files(spark, folder)
    d = chunks(spark, folder).select("path", "lineno", "end_lineno", "qualified_name", F.col("kind").alias("signature")).distinct().join(f.select("path", "module"), "path")
    return C.chunk_scores(d, f.select("path", F.size("symbols").cast("double").alias("score")), reference_hits(spark, folder), _CHUNK_TERMS)


def _tests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Chunks, stack frames, fault scores and covered lines: lines of the chunk table's own starts and ends."""
    c = chunks(spark, folder)
    spans = c.select("path", "lineno", "end_lineno", "qualified_name").distinct()
    frames = c.where(F.col("kind") == "method").select("path", F.col("lineno").alias("line"))
    faults = c.where(F.col("kind") == "function").select("path", F.col("end_lineno").alias("line"), F.coalesce("score", F.lit(0.0)).alias("score"))
    covered = c.select("path", (F.col("lineno") + 2).alias("line"))
    return spans, frames, faults, covered


_TESTS_SQL = f"""{CHUNKS_SQL}, spans AS (SELECT DISTINCT path, lineno, end_lineno, qualified_name FROM chunks),
  frames AS (SELECT path, lineno AS line FROM chunks WHERE kind = 'method'), faults AS (SELECT path, end_lineno AS line, coalesce(score, 0) AS score FROM chunks WHERE kind = 'function'),
  covered AS (SELECT DISTINCT path, lineno + 2 AS line FROM chunks), hits AS (
    SELECT s.path, lineno, end_lineno, qualified_name, 1.0 AS v FROM spans s JOIN frames p ON s.path = p.path AND line BETWEEN lineno AND end_lineno
    UNION ALL SELECT s.path, lineno, end_lineno, qualified_name, 1.5 * greatest(0, score) FROM spans s JOIN faults p ON s.path = p.path AND line BETWEEN lineno AND end_lineno
    UNION ALL SELECT s.path, lineno, end_lineno, qualified_name, least(1.0, 0.05 * count(*)) FROM spans s JOIN covered p ON s.path = p.path AND line BETWEEN lineno AND end_lineno GROUP BY 1, 2, 3, 4)"""


@registry.query(f"WITH {_TESTS_SQL} SELECT path, lineno, end_lineno, qualified_name, round(sum(v), 6) AS score FROM hits GROUP BY 1, 2, 3, 4 HAVING round(sum(v), 6) > 0 ORDER BY score DESC, path, lineno, qualified_name LIMIT 12")
def suspicious_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return C.suspicious(*_tests(spark, folder))


def _spectrum(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events")
    runs = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("failed"))
    seen = e.where(F.col("event_type") != "error").select("user_id", F.to_date("ts").alias("d"), F.concat_ws(":", "event_type", F.floor(F.col("value") / 20).cast("int")).alias("line")).distinct()
    total = runs.agg(F.sum("failed")).scalar()
    g = seen.join(runs, ["user_id", "d"]).groupBy("line").agg(F.sum("failed").alias("ef"), F.sum(1 - F.col("failed")).alias("ep"))
    return g.withColumn("nf", total - F.col("ef"))


_SPECTRUM_SQL = """WITH r AS (SELECT user_id, CAST(ts AS DATE) AS d, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed FROM events GROUP BY 1, 2),
  s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type || ':' || CAST(floor(value / 20) AS INT) AS line FROM events WHERE event_type <> 'error'),
  g AS (SELECT line, sum(failed) AS ef, sum(1 - failed) AS ep, (SELECT sum(failed) FROM r) - sum(failed) AS nf FROM s JOIN r USING (user_id, d) GROUP BY 1)"""


@registry.query(f"{_SPECTRUM_SQL} SELECT line, round(CASE WHEN (ef + nf) * (ef + ep) > 0 THEN ef / sqrt((ef + nf) * (ef + ep)) ELSE 0 END, 6) AS score FROM g")
def sbfl_ochiai(spark: SparkSession, folder: str) -> DataFrame:
    return _spectrum(spark, folder).select("line", F.round(C.sbfl(F.col("ef"), F.col("ep"), F.col("nf")), 6).alias("score"))


@registry.query(f"{_SPECTRUM_SQL} SELECT line, round(CASE WHEN ep + nf > 0 THEN ef * ef / (ep + nf) ELSE ef * ef END, 6) AS score FROM g")
def sbfl_dstar(spark: SparkSession, folder: str) -> DataFrame:
    return _spectrum(spark, folder).select("line", F.round(C.sbfl(F.col("ef"), F.col("ep"), F.col("nf"), "dstar"), 6).alias("score"))


@registry.query(f"""WITH {CHUNKS_SQL}, u AS (SELECT path, lineno, end_lineno, qualified_name, 2.0 * coalesce(score, 0) AS score, 1 AS t FROM chunks WHERE coalesce(kind, '') = 'method'
  UNION ALL SELECT path, lineno, end_lineno, qualified_name, coalesce(score, 0), 0 FROM chunks WHERE coalesce(kind, '') <> 'method')
  SELECT path, lineno, end_lineno, qualified_name, round(sum(score), 6) AS score, CAST(max(t) AS INT) AS from_tests FROM u GROUP BY 1, 2, 3, 4""")
def plan_merge(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).withColumn("score", F.coalesce("score", F.lit(0.0)))
    return C.merge_ranked(c.where(T.text("kind") == "method"), c.where(T.text("kind") != "method"), 2.0)


@registry.query(f"""WITH {CHUNKS_SQL}, d AS (SELECT path, lineno, end_lineno, qualified_name, max(coalesce(score, 0)) AS score FROM chunks GROUP BY 1, 2, 3, 4)
  SELECT path, lineno, end_lineno, qualified_name, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, lineno, qualified_name, end_lineno) AS place FROM d) WHERE place <= 2""")
def per_file_limit(spark: SparkSession, folder: str) -> DataFrame:
    d = chunks(spark, folder).groupBy("path", "lineno", "end_lineno", "qualified_name").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    return C.per_file(d, 2)


_ROLE = "lower(trim(coalesce(evidence.role, '')))"
_SRC = lambda s: f"coalesce(list_contains(evidence.sources, '{s}'), false)"
_TIER_SQL = f"""CASE WHEN {_ROLE} = 'direct' THEN 'EXTRACTED' WHEN {_ROLE} = 'neighbor_context' THEN 'INFERRED' WHEN {_ROLE} = 'hint_only' THEN 'AMBIGUOUS'
  WHEN {_SRC('test_hint')} AND NOT {_SRC('direct_candidate')} THEN 'INFERRED' WHEN {_SRC('fallback_ranker')} OR {_SRC('stale_memory')} THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END"""


@registry.query(f"""WITH {CHUNKS_SQL} SELECT tier, round(s, 6) AS confidence, count(*) AS n FROM (SELECT {_TIER_SQL} AS tier,
  CASE WHEN {_ROLE} = 'direct' AND {_SRC('direct_candidate')} THEN 1.0 WHEN {_ROLE} = 'direct' THEN 0.95 WHEN {_ROLE} = 'neighbor_context' THEN 0.72 WHEN {_ROLE} = 'hint_only' AND {_SRC('test_hint')} THEN 0.35 WHEN {_ROLE} = 'hint_only' THEN 0.28
   WHEN {_SRC('test_hint')} AND NOT {_SRC('direct_candidate')} THEN 0.65 WHEN {_SRC('fallback_ranker')} THEN 0.2 WHEN {_SRC('stale_memory')} THEN 0.18 ELSE 0 END AS s FROM chunks) GROUP BY 1, 2""")
def evidence_confidence(spark: SparkSession, folder: str) -> DataFrame:
    tier, score = C.confidence(F.col("evidence"))
    return chunks(spark, folder).select(tier.alias("tier"), F.round(score, 6).alias("confidence")).groupBy("tier", "confidence").agg(F.count("*").alias("n"))


@registry.query(f"""WITH {CHUNKS_SQL}, t AS (SELECT plan_id, {_TIER_SQL} AS tier FROM chunks)
  SELECT plan_id, count(*) FILTER (WHERE tier = 'EXTRACTED') AS extracted, count(*) FILTER (WHERE tier = 'INFERRED') AS inferred, count(*) FILTER (WHERE tier = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (WHERE tier = 'UNKNOWN') AS unknown, count(*) AS total,
  round((count(*) FILTER (WHERE tier = 'EXTRACTED') + 0.75 * count(*) FILTER (WHERE tier = 'INFERRED') + 0.25 * count(*) FILTER (WHERE tier = 'AMBIGUOUS')) / count(*), 6) AS strength FROM t GROUP BY 1""")
def confidence_summary(spark: SparkSession, folder: str) -> DataFrame:
    tier, _ = C.confidence(F.col("evidence"))
    return C.confidence_summary(chunks(spark, folder).select("plan_id", tier.alias("tier")), by=["plan_id"])


_FLAG = lambda c: f"count(*) FILTER (WHERE coalesce(CAST(evidence.{c} AS VARCHAR) IN ('true', '1', '1.0'), false))"


@registry.query(f"""WITH {CHUNKS_SQL} SELECT plan_id, count(*) AS chunks, {', '.join(f'{_FLAG(c)} AS {n}_count, round({_FLAG(c)} / count(*), 6) AS {n}_ratio' for n, c in (('direct', 'direct_retrieval'), ('neighbor', 'neighbor_context'), ('hint_only', 'hint_only')))} FROM chunks GROUP BY 1""")
def grounding(spark: SparkSession, folder: str) -> DataFrame:
    return C.grounding(chunks(spark, folder).select("plan_id", "evidence.*"), ["plan_id"])


@registry.query(f"""WITH {CHUNKS_SQL}, a AS (SELECT coalesce(score, 0) / 10 AS s, starts_with(path, 'src/') AS f, {_ROLE} = 'direct' AS strong, {_ROLE} = 'neighbor_context' AS support, starts_with(path, 'tests/') AS test FROM chunks)
  SELECT CASE WHEN f AND (strong OR s >= 0.6) THEN 'keep' WHEN strong AND s >= 0.25 THEN 'need_more_read' WHEN f AND (support OR s >= 0.15) THEN 'need_more_read' WHEN test AND NOT f AND NOT strong THEN 'drop' WHEN support OR s >= 0.1 THEN 'downrank' ELSE 'drop' END AS action, count(*) AS n FROM a GROUP BY 1""")
def refine_actions(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder)
    role = F.lower(F.trim(T.text(F.col("evidence.role"))))
    action = C.refine_action(F.coalesce("score", F.lit(0.0)) / 10, F.col("path").startswith("src/"), role == "direct", role == "neighbor_context", F.col("path").startswith("tests/"))
    return c.select(action.alias("action")).groupBy("action").agg(F.count("*").alias("n"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    d = chunks(spark, folder).groupBy("path", "lineno", "end_lineno", "qualified_name").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.max("kind").alias("kind"))
    return d.withColumn("tokens", C.chunk_tokens(F.col("path"), F.col("qualified_name"), F.col("kind"), F.lit("")))


@registry.query()
def diverse_selection(spark: SparkSession, folder: str) -> DataFrame:
    return C.select_diverse(_scored(spark, folder), 20, 400)


@registry.query()
def greedy_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The first three paths are focused, and one that isn't there."""
    scored = _scored(spark, folder)
    first = [r.path for r in scored.select("path").distinct().orderBy("path").limit(3).collect()]
    return C.pack_greedy(scored, ["src/pinned.py", *first], 20)


@registry.query()
def near_duplicates_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Each hit, and whether it is kept as no near duplicate of a better one that is."""
    docs = load(spark, folder, "documents").select("doc_id", "text")
    hits = bm25_documents(spark, folder).join(docs, "doc_id").select("doc_id", "score", T.word_set(F.col("text")).alias("t"), F.lit("q").alias("query"))
    return C.greedy_distinct(hits, "doc_id", "query", "t", 0.9)


@registry.query()
def chunk_cards(spark: SparkSession, folder: str) -> DataFrame:
    return C.cards(_scored(spark, folder), 20)


# --- text functions


@registry.query()
def code_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", T.code_tokens(F.col("text"), limit=None).alias("tokens"))


@registry.query(f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS INT) AS tokens,
  CASE WHEN contains({low('text')}, 'traceback') OR contains({low('text')}, 'error') THEN 'fix' WHEN contains({low('text')}, 'refactor') THEN 'refactor' ELSE 'implement' END AS intent FROM documents""")
def text_rules(spark: SparkSession, folder: str) -> DataFrame:
    intent = T.first_rule(F.col("text"), [("fix", ["traceback", "error"]), ("refactor", ["refactor"])], "implement")
    return load(spark, folder, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), intent.alias("intent"))


@registry.query("SELECT doc_id, path, list_extract(list_filter(string_split(replace(replace(path, '/', '.'), ' ', ''), '.'), lambda x: x <> ''), -1) AS tail FROM documents WHERE path IS NOT NULL")
def tail_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").where(F.col("path").isNotNull()).select("doc_id", "path", T.tail_symbol(F.col("path")).alias("tail"))


@registry.query("SELECT doc_id, starts_with(path, 'tests/') AND NOT ends_with(path, '.md') AS ignored FROM documents WHERE path IS NOT NULL")
def ignore_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """The last pattern that fits decides."""
    hidden = T.ignored(F.col("path"), ["# comment", "/tests/", "!*.md"])
    return load(spark, folder, "documents").where(F.col("path").isNotNull()).select("doc_id", hidden.alias("ignored"))


@registry.query(f"""WITH t AS (SELECT doc_id, list_distinct({words_sql('path')}) AS w FROM documents)
  SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, ['src', 'lib', 'py'])) / len(list_distinct(list_concat(w, ['src', 'lib', 'py']))) END, 6) AS jaccard, round(len(list_intersect(['src', 'lib', 'py'], w)) / 3.0, 6) AS overlap FROM t""")
def token_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    q = F.array(F.lit("src"), F.lit("lib"), F.lit("py"))
    w = T.word_set(F.col("path"))
    return load(spark, folder, "documents").select("doc_id", F.round(T.jaccard(w, q), 6).alias("jaccard"), F.round(T.overlap(q, w), 6).alias("overlap"))


# --- plans


@registry.query(f"""WITH {FILES_SQL} SELECT path, CASE WHEN regexp_matches({low('path')}, '^docs?/') THEN 'docs' WHEN regexp_matches({low('path')}, '^tests?/') THEN 'tests' WHEN regexp_matches({low('path')}, '\\.(md|mdx|rst)$') THEN 'markdown' ELSE 'code' END AS domain,
  round(len(symbols) + CASE WHEN contains({low("path || ' ' || module")}, 'table') THEN 5.0 ELSE 0 END + CASE WHEN contains({low("path || ' ' || module")}, 'score') THEN 5.0 ELSE 0 END + CASE WHEN regexp_matches({low('path')}, '^docs?/') THEN 2.0 WHEN regexp_matches({low('path')}, '^tests?/') THEN -1.0 ELSE 0 END, 6) AS score FROM files""")
def quick_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Files by their symbols, the query's tokens in their names, and boosts of their domain."""
    f = files(spark, folder).select("path", "module", F.size("symbols").cast("double").alias("score"))
    return P.quick_scores(f, "table score", {"docs": 2.0, "tests": -1.0}).select("path", P.domain(F.col("path")).alias("domain"), "score")


@registry.query(f"""WITH {CHUNKS_SQL}, t AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY score DESC NULLS LAST, path, qualified_name) <= 5)
  SELECT src, dst, kind, max(weight) AS weight FROM (SELECT 'query:' || CAST(plan_id AS VARCHAR) AS src, 'file:' || path AS dst, 'candidate' AS kind, coalesce(score, 0) AS weight FROM t
  UNION ALL SELECT 'file:' || path, 'chunk:' || path || ':' || qualified_name, 'contains', 1.0 FROM t) GROUP BY 1, 2, 3""")
def plan_view(spark: SparkSession, folder: str) -> DataFrame:
    return P.plan_view(chunks(spark, folder), 5)


@registry.query()
def chunk_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Each plan's chunks, judged among themselves."""
    d = chunks(spark, folder).groupBy("plan_id", "path", "lineno", "end_lineno", "qualified_name").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.max("kind").alias("kind"))
    shape = C.signature(F.col("path"), F.col("qualified_name"), F.col("kind"), F.lit(""))
    key = F.concat_ws("#", "path", "lineno", "end_lineno", "qualified_name")
    s = d.select("plan_id", key.alias("key"), "score", T.code_tokens(F.col("qualified_name"), limit=None).alias("t"), shape.alias("shape"))
    return P.chunk_guard(s, "key", "t", "shape", 2.0, 1.0, "plan_id")
