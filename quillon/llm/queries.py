"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, hnsw, packing, quantiles, stuffing
from quillon.plans.registry import Registry
from quillon.session import materialise
from quillon.sources.tables import load

registry = Registry()

P3_SQL = """
WITH last AS (
  SELECT * FROM runtime_invocations
  QUALIFY invocation_id IS NULL OR row_number() OVER (PARTITION BY invocation_id
    ORDER BY finished_at DESC, repo_key DESC NULLS LAST, profile_key DESC NULLS LAST, stage_latency_json DESC) = 1
), stages AS (
  SELECT repo_key, coalesce(profile_key, '') AS profile_key, unnest(CASE json_type(stage_latency_json)
      WHEN 'ARRAY' THEN list_transform(CAST(CAST(stage_latency_json AS JSON) AS JSON[]), lambda e: {'s': e ->> '$.stage_name', 'v': e ->> '$.elapsed_ms'})
      ELSE list_transform(json_keys(stage_latency_json), lambda k: {'s': k, 'v': json_extract_string(stage_latency_json, '$."' || k || '"')}) END) AS e
  FROM last WHERE repo_key IS NOT NULL AND json_valid(stage_latency_json)
), read AS (
  SELECT repo_key, profile_key, e.s AS stage_name, TRY_CAST(e.v AS DOUBLE) AS ms FROM stages
  WHERE regexp_matches(e.v, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
)
SELECT repo_key, profile_key, stage_name FROM read WHERE ms >= 0 AND stage_name IS NOT NULL GROUP BY ALL
HAVING quantile_disc(ms, 0.95) >= 1000 AND quantile_disc(ms, 0.5) <= 200
"""


def _stage_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "runtime_invocations").select("invocation_id", "finished_at", "repo_key", "profile_key", "stage_latency_json")
    return quantiles.stage_values(quantiles.last_finished(rows))


@registry.query(P3_SQL)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups with a low median and a slow tail, by rank-interval summaries."""
    values = _stage_values(spark, folder)
    return quantiles.decide(quantiles.slow_tails(values), values)


@registry.query()
def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentile of each group with their bounds and the rank error."""
    return _percentiles(_stage_values(spark, folder), quantiles.GROUPS, 0.002)


def _percentiles(values: DataFrame, groups: list[str], eps: float) -> DataFrame:
    merged = quantiles.merge_sketches(quantiles.sketch(values, groups, "elapsed_ms", eps), groups, eps)
    out = quantiles.bounds(merged, {"p50": 50, "p90": 90, "p95": 95, "p99": 99})
    return out.withColumn("rank_error", F.col("err")).drop("v", "g", "d", "err", "level")


_HELD_SQL = P3_SQL.split("SELECT repo_key, profile_key, stage_name FROM read")[0]


@registry.query(_HELD_SQL + "SELECT stage_name, count(*) AS n, true AS within, true AS bounded FROM read WHERE ms >= 0 AND stage_name IS NOT NULL GROUP BY 1")
def p3_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """By stage alone, whose groups are large and compressed: whether the exact percentiles lie within the bounds, and the rank
    error within ``eps * n``. The exact ones are counted: a value is the percentile if enough values aren't above it and
    too few are below."""
    eps, names = 0.002, {"p50": 50, "p90": 90, "p95": 95, "p99": 99}
    values = materialise(_stage_values(spark, folder).select("stage_name", "elapsed_ms"))
    got = _percentiles(values, ["stage_name"], eps)
    on = values.join(F.broadcast(got.select(F.col("stage_name").alias("s"), *[f"{p}_{x}" for p in names for x in ("low", "high")])), F.col("stage_name") == F.col("s"))
    counts = on.groupBy("stage_name").agg(
        *[F.count_if(F.col("elapsed_ms") < F.col(f"{p}_low")).alias(f"{p}_below") for p in names], *[F.count_if(F.col("elapsed_ms") <= F.col(f"{p}_high")).alias(f"{p}_upto") for p in names]
    )
    held = F.lit(True)
    for p, q in names.items():
        held = held & (F.col(f"{p}_below") < quantiles.rank_of(q)) & (F.col(f"{p}_upto") >= quantiles.rank_of(q))
    return got.join(counts, "stage_name").select("stage_name", "n", held.alias("within"), (F.col("rank_error") <= eps * F.col("n")).alias("bounded"))


P4_SQL = """
WITH last AS (
  SELECT * FROM embedding_vectors
  QUALIFY row_number() OVER (PARTITION BY provider, model, dimension, path ORDER BY written_at DESC, vec_id DESC) = 1
), usable AS (
  SELECT vec_id, provider, model, dimension, list_transform(v, lambda x: coalesce(x, 0)) AS v FROM (SELECT *, TRY_CAST(vector_json AS DOUBLE[]) AS v FROM last)
  WHERE len(v) = dimension AND len(list_filter(v, lambda x: x IS NULL)) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s
  FROM usable a JOIN usable b ON a.provider = b.provider AND a.model = b.model AND a.dimension = b.dimension AND a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(s, 6) DESC, b.vec_id) <= 3
)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM near WHERE s >= 0.9
"""


@registry.query(P4_SQL)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors of cosine 0.9 or more, one among the three most similar of the other, by small-world graphs."""
    vectors = hnsw.usable_vectors(load(spark, folder, "embedding_vectors"))
    return hnsw.unordered_pairs(hnsw.nearest(vectors, hnsw.GROUP, k=3, least=0.9))


@registry.query()
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text."""
    return bpe.encode_texts(load(spark, folder, "documents"))


@registry.query()
def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each text comes back from its ids."""
    documents = load(spark, folder, "documents").select("doc_id", "text")
    back = bpe.decode_ids(bpe.encode_texts(documents)).withColumnRenamed("text", "back")
    return documents.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


@registry.query()
def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Container and place of every text or piece."""
    return packing.pack(bpe.count_tokens(load(spark, folder, "documents")))


@registry.query()
def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by how many tokens they hold."""
    placed = p7_packed(spark, folder).where(F.col("container").isNotNull())
    filled = placed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return filled.groupBy("tokens").agg(F.count("*").alias("containers"), F.sum("items").alias("items"))


@registry.query()
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of which more than half is keywords, links, products or tags."""
    return stuffing.stuffed(load(spark, folder, "documents")).select("doc_id")


@registry.query()
def p8_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The usual compression ratios of text by script, language and length."""
    return stuffing.usual_ratios(stuffing.measured_blocks(load(spark, folder, "documents")))
