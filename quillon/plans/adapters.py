"""The driver's tables in the roles the operators expect, with SQL that builds the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.tables import load

NOW = "2025-07-01T00:00:00Z"
NOW_SQL = "TIMESTAMP '2025-07-01 00:00:00'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(x: str) -> str:
    """SQL: lower case of A to Z."""
    return f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"


def words_sql(x: str) -> str:
    return f"regexp_extract_all({low(x)}, '[a-z0-9_]+')"


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """plan_id, created_at and the fields of each candidate chunk with a path and lines; equal rows once."""
    plans = load(spark, folder, "evidence_plans").select("plan_id", "created_at", F.explode("candidate_chunks").alias("e")).distinct()
    e = plans.select("plan_id", "created_at", "e.*")
    return e.where((F.col("path") != "") & (F.col("lineno") > 0)).withColumn("qualified_name", F.coalesce("qualified_name", F.lit(""))).withColumn("end_lineno", F.greatest("lineno", F.coalesce("end_lineno", "lineno")))


CHUNKS_SQL = """chunks AS (
  SELECT plan_id, created_at, e.path AS path, coalesce(e.qualified_name, '') AS qualified_name, e.kind AS kind, e.lineno AS lineno,
         greatest(e.lineno, coalesce(e.end_lineno, e.lineno)) AS end_lineno, e.score AS score, e.evidence AS evidence
  FROM (SELECT DISTINCT plan_id, created_at, e FROM (SELECT plan_id, created_at, unnest(candidate_chunks) AS e FROM evidence_plans))
  WHERE e.path <> '' AND e.lineno > 0
)"""


def module_of(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, r"\.[a-z]+$", ""), "/", ".")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, module, tier, symbols, imports: one row for each path of the candidate chunks."""
    c = chunks(spark, folder)
    name = F.when(F.col("qualified_name") != "", F.col("qualified_name"))
    out = c.groupBy("path").agg(F.array_sort(F.collect_set(name)).alias("symbols"), F.array_sort(F.collect_set("kind")).alias("imports"))
    tier = F.when(F.col("path").startswith("pkg/"), "dependency").otherwise("first_party")
    return out.select("path", module_of(F.col("path")).alias("module"), tier.alias("tier"), "symbols", "imports")


FILES_SQL = CHUNKS_SQL + """, files AS (
  SELECT path, replace(regexp_replace(path, '\\.[a-z]+$', ''), '/', '.') AS module,
         CASE WHEN starts_with(path, 'pkg/') THEN 'dependency' ELSE 'first_party' END AS tier,
         coalesce(list_sort(list(DISTINCT qualified_name) FILTER (WHERE qualified_name <> '')), []) AS symbols,
         coalesce(list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)), []) AS imports
  FROM chunks GROUP BY path
)"""


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """p_partkey with sales figures: price, size, qty, orders."""
    li = load(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("qty"), F.count_distinct("l_orderkey").alias("orders"))
    return load(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")).join(li, "p_partkey", "left").fillna(0)


PARTS_SQL = """parts AS (
  SELECT p_partkey, p_retailprice AS price, p_size AS size, coalesce(qty, 0) AS qty, coalesce(orders, 0) AS orders
  FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS qty, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
)"""


def trade(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nations and their main partners: edges from the customer's nation to suppliers' nations that get more than its mean
    trade, weighted by quantity in hundreds."""
    c = load(spark, folder, "customer").select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("src"))
    o = load(spark, folder, "orders").select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"))
    s = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("sk"), F.col("s_nationkey").alias("dst"))
    li = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk"), "l_quantity")
    e = li.join(o, "ok").join(c, "ck").join(s, "sk").where(F.col("src") != F.col("dst"))
    nodes = load(spark, folder, "nation").select(F.col("n_nationkey").alias("node"))
    all_ = e.groupBy("src", "dst").agg((F.sum("l_quantity") / 100).alias("weight"))
    return nodes, all_.withColumn("_mean", F.avg("weight").over(W.partitionBy("src"))).where(F.col("weight") > F.col("_mean")).drop("_mean")


TRADE_SQL = """nodes AS (SELECT n_nationkey AS node FROM nation), edges AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) / 100 AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2 QUALIFY sum(l_quantity) > avg(sum(l_quantity)) OVER (PARTITION BY c_nationkey)
)"""


def micros_sql(column: str) -> str:
    """SQL: microseconds of a time written as text."""
    stamp = r"'^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$'"
    return f"""CASE WHEN regexp_matches(trim({column}), '^\\d{{1,12}}$') THEN CAST(trim({column}) AS BIGINT) * 1000000
      WHEN regexp_matches(trim({column}), {stamp}) THEN
        epoch_us(TRY_CAST(CASE WHEN regexp_matches(trim({column}), '(Z|[+-]\\d{{2}}:\\d{{2}})$') AND length(trim({column})) > 10
          THEN replace(trim({column}), 'Z', '+00:00') ELSE trim({column}) || CASE WHEN length(trim({column})) = 10 THEN ' 00:00:00+00:00' ELSE '+00:00' END END AS TIMESTAMPTZ)) END"""
