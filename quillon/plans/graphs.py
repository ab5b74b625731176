"""Queries over graphs: co-change, references, ranks, expansion, propagation, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.times import parse_micros
from quillon.operators import graph as G
from quillon.operators import memory as M
from quillon.plans.adapters import CHUNKS_SQL, FILES_SQL, TRADE_SQL, chunks, files, micros_sql, trade
from quillon.plans.registry import Registry
from quillon.sources.tables import load

registry = Registry()
NOW = "1999-01-01T00:00:00Z"


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    o = load(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    li = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item"))
    return li.join(o, "o_orderkey").select(F.col("o_orderkey").alias("basket"), "ts", "item")


_PAIRS_SQL = """items AS (SELECT DISTINCT o_orderkey AS basket, o_orderdate AS ts, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  ok AS (SELECT basket FROM items GROUP BY 1 HAVING count(*) >= 2),
  w AS (SELECT i.*, pow(0.5, greatest(0, (epoch_us(TIMESTAMP '1999-01-01') - epoch_us(ts)) / 86400e6) / 365.0) AS w FROM items i SEMI JOIN ok USING (basket)),
  pairs AS (SELECT a.item AS src, b.item AS dst, sum(a.w) AS score FROM w a JOIN w b ON a.basket = b.basket AND a.item <> b.item GROUP BY 1, 2)"""


@registry.query(f"WITH {_PAIRS_SQL} SELECT src, dst, round(score, 6) AS score FROM pairs")
def cochange_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return G.cochange(_baskets(spark, folder), NOW, 365.0).withColumn("score", F.round("score", 6))


@registry.query(f"WITH {_PAIRS_SQL}, r AS (SELECT src, dst, round(score, 6) AS score FROM pairs) SELECT src, dst, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS place FROM r) WHERE place <= 8")
def cochange_top(spark: SparkSession, folder: str) -> DataFrame:
    return G.top_neighbours(cochange_pairs(spark, folder), 8)


@registry.query(f"WITH {_PAIRS_SQL}, r AS (SELECT src, dst, round(score, 6) AS score FROM pairs), t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= 8) SELECT dst, round(sum(score), 6) AS score FROM t WHERE src IN (1, 2, 3) AND dst NOT IN (1, 2, 3) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def cochange_query(spark: SparkSession, folder: str) -> DataFrame:
    return G.query_neighbours(cochange_top(spark, folder), [1, 2, 3], 10)


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(spark, folder).where(F.col("qualified_name") != "")
    refs = c.select("path", F.col("qualified_name").alias("name"), F.when(F.col("kind") == "method", "call").otherwise(F.coalesce("kind", F.lit("reference"))).alias("kind"))
    return refs, c.select("path", F.col("qualified_name").alias("name")).distinct()


_REF_SQL = f"""{CHUNKS_SQL}, refs AS (SELECT path, qualified_name AS name, CASE WHEN kind = 'method' THEN 2.0 ELSE 1.0 END AS w FROM chunks WHERE qualified_name <> ''),
  defs AS (SELECT DISTINCT path, qualified_name AS name FROM chunks WHERE qualified_name <> ''),
  keyed AS (SELECT path, unnest(list_distinct([name, list_extract(list_filter(string_split(replace(name, '/', '.'), '.'), lambda x: x <> ''), -1)])) AS name, w FROM refs),
  edges AS (SELECT k.path AS src, d.path AS dst, sum(w) AS weight FROM keyed k JOIN defs d USING (name) WHERE k.path <> d.path GROUP BY 1, 2)"""


@registry.query(f"WITH {_REF_SQL} SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM edges")
def reference_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.reference_edges(*_references(spark, folder))


@registry.query(f"WITH {_REF_SQL} SELECT src, dst, CAST(weight AS DOUBLE) AS weight, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM edges) WHERE place <= 3")
def reference_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return G.adjacency(reference_edges(spark, folder), 3)


@registry.query(f"WITH {_REF_SQL}, i AS (SELECT dst AS node, count(*) AS inbound, sum(weight) AS weight FROM edges GROUP BY 1), o AS (SELECT src AS node, count(*) AS outbound FROM edges GROUP BY 1) SELECT node, coalesce(inbound, 0) AS inbound, CAST(coalesce(weight, 0) AS DOUBLE) AS weight, coalesce(outbound, 0) AS outbound FROM i FULL JOIN o USING (node)")
def degrees(spark: SparkSession, folder: str) -> DataFrame:
    return G.inbound(reference_edges(spark, folder))


@registry.query(f"WITH {CHUNKS_SQL}, d AS (SELECT DISTINCT path, qualified_name AS name FROM chunks WHERE qualified_name <> '') SELECT path, name FROM d WHERE name IN (SELECT name FROM d GROUP BY 1 HAVING count(*) <= 1)")
def rare_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return G.rare_keys(_references(spark, folder)[1], 1).select("path", "name")


@registry.query(f"WITH {FILES_SQL}, i AS (SELECT path, module FROM files), m AS (SELECT module, min(path) AS dst FROM files GROUP BY 1), c AS (SELECT DISTINCT a.path AS src, b.path AS other FROM chunks a JOIN chunks b ON a.plan_id = b.plan_id AND a.path <> b.path) SELECT DISTINCT src, dst FROM c JOIN files f ON f.path = other JOIN m USING (module) WHERE src <> dst")
def import_edges(spark: SparkSession, folder: str) -> DataFrame:
    """A file imports the modules of the files that plans name together with it."""
    f = files(spark, folder)
    return G.import_edges(_imports(spark, folder), f.select("module", "path"))


def _imports(spark: SparkSession, folder: str) -> DataFrame:
    """path, module: of the files that a plan names beside a path. A plan names few chunks, so the join is bounded."""
    c = chunks(spark, folder).select("plan_id", "path").distinct()
    f = files(spark, folder).select(F.col("path").alias("other"), "module")
    return c.join(c.withColumnRenamed("path", "other"), "plan_id").where(F.col("path") != F.col("other")).join(f, "other").select("path", "module").distinct()


@registry.query(f"""WITH {FILES_SQL}, i AS (SELECT DISTINCT a.path, f.module FROM chunks a JOIN chunks b ON a.plan_id = b.plan_id AND a.path <> b.path JOIN files f ON f.path = b.path),
  home AS (SELECT module, min(path) AS t FROM files GROUP BY 1), stems AS (SELECT string_split(module, '.')[-1] AS stem, min(path) AS t FROM files GROUP BY 1 HAVING count(*) = 1)
  SELECT i.path, i.module, coalesce(h.t, m.t, s.t) AS target, CASE WHEN h.t IS NOT NULL THEN 'module' WHEN m.t IS NOT NULL THEN 'member' ELSE 'stem' END AS how
  FROM i LEFT JOIN home h USING (module) LEFT JOIN home m ON m.module = i.module || '.main' LEFT JOIN stems s ON s.stem = string_split(i.module, '.')[-1] WHERE coalesce(h.t, m.t, s.t) IS NOT NULL""")
def import_targets(spark: SparkSession, folder: str) -> DataFrame:
    f = files(spark, folder)
    imports = _imports(spark, folder).withColumn("name", F.lit("main"))
    return G.resolve_imports(imports, f.select("module", "path"))


def _rank_sql(rounds: int, weighted: bool, seeds: list[int] | None, normalise: bool) -> str:
    w = "weight" if weighted else "1.0"
    seed = f"CASE WHEN node IN ({', '.join(map(str, seeds))}) THEN {1.0 / len(seeds)!r} ELSE 0 END" if seeds else "1.0 / (SELECT count(*) FROM nodes)"
    steps = [f"p AS (SELECT src, dst, {w} / sum({w}) OVER (PARTITION BY src) AS part FROM edges)", f"s AS (SELECT node, CAST({seed} AS DOUBLE) AS seed FROM nodes)", "r0 AS (SELECT node, seed, seed AS rank FROM s)"]
    for i in range(1, rounds + 1):
        prev = f"r{i - 1}"
        steps.append(f"""q{i} AS MATERIALIZED (SELECT s.node, s.seed, 0.15 * s.seed + 0.85 * coalesce(f.flow, 0) + 0.85 * s.seed * (SELECT coalesce(sum(rank), 0) FROM {prev} WHERE node NOT IN (SELECT src FROM p)) AS rank
          FROM s LEFT JOIN (SELECT dst, sum(rank * part) AS flow FROM p JOIN {prev} ON src = node GROUP BY 1) f ON f.dst = s.node)""")
        steps.append(f"r{i} AS MATERIALIZED (SELECT node, seed, rank{f' / (SELECT sum(rank) FROM q{i})' if seeds else ''} AS rank FROM q{i})")
    last = f"r{rounds}"
    return f"WITH {TRADE_SQL}, {', '.join(steps)} SELECT node, round(rank{f' / (SELECT sum(rank) FROM {last})' if normalise else ''}, 6) AS rank FROM {last}"


@registry.query(_rank_sql(12, False, None, False))
def pagerank_uniform(spark: SparkSession, folder: str) -> DataFrame:
    return G.pagerank(*trade(spark, folder)).withColumn("rank", F.round("rank", 6))


@registry.query(_rank_sql(14, False, [1, 2, 3], False))
def pagerank_personalised(spark: SparkSession, folder: str) -> DataFrame:
    return G.pagerank(*trade(spark, folder), rounds=14, seeds=[1, 2, 3]).withColumn("rank", F.round("rank", 6))


@registry.query(_rank_sql(20, True, None, True))
def pagerank_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return G.pagerank(*trade(spark, folder), rounds=20, weighted=True, normalise=True).withColumn("rank", F.round("rank", 6))


_ALL = "thin AS (SELECT src, dst FROM edges)"
_REACH = """WITH RECURSIVE {trade}, {thin}, reach(start, node, depth) AS (
  SELECT DISTINCT src, dst, 1 FROM thin UNION SELECT start, t.dst, depth + 1 FROM reach JOIN thin t ON node = t.src WHERE depth < {depth}
), best AS (SELECT start, node, min(depth) AS depth FROM reach GROUP BY 1, 2)"""


@registry.query(_REACH.format(trade=TRADE_SQL, thin=_ALL, depth=25) + " SELECT n.node, round(coalesce(sum(1.0 / depth), 0), 6) AS centrality FROM nodes n LEFT JOIN best b ON b.node = n.node GROUP BY 1")
def import_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Over all edges and any number of steps; no path between 25 nodes has more than 25."""
    return G.depth_centrality(*trade(spark, folder))


@registry.query(_REACH.format(trade=TRADE_SQL, thin="thin AS (SELECT dst AS src, src AS dst FROM edges)", depth=2) + " SELECT node, CAST(min(depth) AS INT) AS depth FROM best WHERE start IN (1, 2) AND node NOT IN (1, 2) GROUP BY 1 ORDER BY 2, 1 LIMIT 12")
def reverse_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = trade(spark, folder)
    return G.reverse_dependents(nodes.where(F.col("node").isin(1, 2)), edges, 2, 12)


@registry.query(_REACH.format(trade=TRADE_SQL, thin=_ALL, depth=2) + " SELECT node, CAST(min(depth) AS INT) AS depth FROM best WHERE start IN (1, 2) AND node NOT IN (1, 2) GROUP BY 1 ORDER BY 2, 1 LIMIT 6")
def neighbour_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Along all edges, the nearest six."""
    nodes, edges = trade(spark, folder)
    return G.neighbours(nodes.where(F.col("node").isin(1, 2)), edges, 2, 6)


@registry.query(f"""WITH {CHUNKS_SQL}, spans AS (SELECT DISTINCT path, qualified_name AS name, lineno, end_lineno FROM chunks), pts AS (SELECT DISTINCT path, lineno + 3 AS line FROM chunks)
  SELECT p.path, line, name, lineno, end_lineno FROM pts p JOIN spans s ON p.path = s.path AND line BETWEEN lineno AND end_lineno
  QUALIFY row_number() OVER (PARTITION BY p.path, line ORDER BY end_lineno - lineno, lineno DESC, name) = 1""")
def enclosing_symbols(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder)
    return G.enclosing(c.select("path", (F.col("lineno") + 3).alias("line")), c.select("path", F.col("qualified_name").alias("name"), "lineno", "end_lineno").distinct())


@registry.query(f"""WITH {TRADE_SQL}, deg AS (SELECT dst, count(*) AS deg FROM edges GROUP BY 1)
  SELECT dst AS node, round(least(0.5, sum(greatest(0, 0.2 * greatest(0.5, src * 0.2) - least(0.4, greatest(0, deg - 8.0) * 0.02)))), 6) AS bonus FROM edges JOIN deg USING (dst) WHERE src IN (1, 2, 3, 4) GROUP BY 1""")
def graph_prior(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = trade(spark, folder)
    seeds = nodes.where(F.col("node").isin(1, 2, 3, 4)).withColumn("strength", F.col("node") * 0.2)
    return G.propagate(seeds, edges, 0.2, 0.5)


@registry.query(f"""WITH {_REF_SQL}, ch AS (SELECT DISTINCT path AS node, string_split(path, '/')[1] AS path FROM chunks)
  SELECT e.dst AS node, round(least(0.6, count(*) * 0.2), 6) AS bonus FROM edges e JOIN ch a ON a.node = e.src JOIN ch t ON t.node = e.dst WHERE starts_with(e.src, 'src/') AND a.path = t.path GROUP BY 1""")
def graph_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Bonus for chunks that refer to anchors in the same top directory."""
    ch = chunks(spark, folder).select(F.col("path").alias("node"), F.element_at(F.split("path", "/"), 1).alias("path"), F.lit("").alias("parent")).distinct()
    anchors = ch.where(F.col("node").startswith("src/")).select("node")
    return G.closure(anchors, ch, reference_edges(spark, folder), 0.2, 0.6)


def _triples(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "memory_triples")
    return t.select(F.col("fact_handle").alias("handle"), "subject", "predicate", F.col("object_value").alias("object"), "confidence", parse_micros(F.col("as_of")).alias("as_of"))


@registry.query()
def triple_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    """Facts around the two most frequent objects."""
    t = _triples(spark, folder)
    seeds = [r.object for r in t.groupBy("object").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "object").limit(2).collect()]
    return G.triple_neighbourhood(t, seeds)


@registry.query("""SELECT node, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS facts FROM (SELECT subject AS node, 'subject' AS role FROM memory_triples UNION ALL SELECT object_value, 'object' FROM memory_triples) GROUP BY 1""")
def memory_graph(spark: SparkSession, folder: str) -> DataFrame:
    return G.graph_view(_triples(spark, folder))


@registry.query(f"WITH {CHUNKS_SQL}, x AS (SELECT path, coalesce(score, 0) AS score, coalesce(evidence.hint_support, false) AS hint FROM chunks) SELECT 'score' AS key, count(DISTINCT path) AS paths FROM x WHERE score > 0 UNION ALL SELECT 'hint', count(DISTINCT path) FROM x WHERE hint")
def subgraph_payload(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.create_map(F.lit("score"), F.coalesce("score", F.lit(0.0)), F.lit("hint"), F.coalesce("evidence.hint_support", F.lit(False)).cast("double"))
    return G.subgraph_keys(chunks(spark, folder).select("path", parts.alias("breakdown")))


@registry.query(f"""WITH {TRADE_SQL}, s AS (SELECT n.node, coalesce(sum(e.weight), 0) AS base, CAST(count(e.src) AS DOUBLE) AS inbound FROM nodes n LEFT JOIN edges e ON e.dst = n.node GROUP BY 1),
  m AS (SELECT *, min(base) OVER () AS l, max(base) OVER () AS h, min(inbound) OVER () AS il, max(inbound) OVER () AS ih FROM s)
  SELECT node, round(l + (0.75 * (base - l) / (h - l) + 0.25 * CASE WHEN ih = il THEN CASE WHEN ih > 0 THEN 1 ELSE 0 END ELSE (inbound - il) / (ih - il) END) * (h - l), 4) AS score FROM m""")
def file_ranking(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = trade(spark, folder)
    g = nodes.join(edges, nodes.node == edges.dst, "left").groupBy("node").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("base"), F.count("src").cast("double").alias("inbound"))
    return G.file_rank(g, "node", {"base": 3.0, "inbound": 1.0}).withColumn("score", F.round("score", 4))


@registry.query(f"""WITH t AS (SELECT *, {micros_sql("as_of")} AS a, {micros_sql("valid_to")} AS z, epoch_us(TIMESTAMP '2024-06-01') AS m FROM memory_triples)
  SELECT fact_handle, subject, predicate, object_value FROM t WHERE a <= m AND (z IS NULL OR z >= m)""")
def valid_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts known and not over at a moment."""
    t = load(spark, folder, "memory_triples")
    at = parse_micros(F.lit("2024-06-01T00:00:00Z"))
    return t.where(M.valid_at(parse_micros(F.col("as_of")), parse_micros(F.col("valid_to")), at)).select("fact_handle", "subject", "predicate", "object_value")
