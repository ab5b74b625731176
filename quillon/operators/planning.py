"""What a plan is made of around the rankings: query terms, policies, domains, guards, maps, cards and views."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from quillon.functions.text import CAMEL, ascii_lower, code_tokens, days_between, text
from quillon.operators import graph as G
from quillon.operators.ranking import order, rrf


def exact_tokens(query: str, limit: int = 12) -> list[str]:
    """Distinct tokens of a query for whole-word search, case ignored, order kept."""
    out: dict[str, str] = {}
    for t in re.findall(r"[A-Za-z0-9_.]{2,}", query):
        out.setdefault(t.lower(), t)
    return list(out.values())[:limit]


def query_terms(query: str, variants: dict[str, list[str]] | None = None, limit: int = 16) -> list[str]:
    """Ordered distinct terms of a query: variants of known phrases, words and their camel-case parts, words without a plural
    or verb ending. The limit is tested between words."""
    out: list[str] = []

    def add(*terms: str) -> None:
        out.extend(t for t in dict.fromkeys(x.lower() for x in terms) if len(t) > 1 and t not in out)

    for phrase, more in (variants or {}).items():
        if phrase in query.lower():
            add(*more)
    for word in re.findall(r"[A-Za-z0-9_-]+", query):
        if len(out) >= limit:
            break
        stems = [word[: -len(e)] for e in ("ing", "ed", "es", "s") if word.lower().endswith(e) and len(word) - len(e) > 3][:1]
        add(word.strip("-"), *re.findall(CAMEL, word), *stems)
    return out


def text_score(raw: Column) -> Column:
    """A full-text rank (smaller is better, at most 0 for hits) as a score: |s| + 1, or 1 / (1 + s) for positive ones."""
    return F.when(raw <= 0, F.abs(raw) + 1).otherwise(F.lit(1.0) / (F.lit(1.0) + raw))


def domain(path: Column) -> Column:
    """docs, tests, markdown or code; the first rule that fits."""
    p = ascii_lower(text(path))
    return F.when(p.rlike("^docs?/"), "docs").when(p.rlike("^tests?/"), "tests").when(p.rlike(r"\.(md|mdx|rst)$"), "markdown").otherwise("code")


def intent_boost(path: Column, boosts: dict[str, float]) -> Column:
    """The sum of the boosts of domains."""
    d = domain(path)
    return reduce(lambda a, b: a + b, [F.when(d == k, v).otherwise(0.0) for k, v in boosts.items()], F.lit(0.0))


def quick_scores(rows: DataFrame, query: str, boosts: dict[str, float], per_hit: float = 5.0) -> DataFrame:
    """Rows (path, module, score) with ``per_hit`` for each query token in path and module and the boosts of their domain."""
    blob = ascii_lower(F.concat_ws(" ", text("path"), text("module")))
    hits = reduce(lambda a, b: a + b, [F.when(F.contains(blob, F.lit(t.lower())), per_hit).otherwise(0.0) for t in exact_tokens(query)], F.lit(0.0))
    return rows.select("path", F.round(F.col("score") + hits + intent_boost(F.col("path"), boosts), 6).alias("score"))


# The weights of the five retrieval policies that the operators here read.
POLICIES = {
    "bugfix_test": {"cochange_weight": 0.0, "chunk_weight": 1.3, "docs_weight": 0.3, "worktree_weight": 1.25, "test_signal_weight": 1.6, "scip_weight": 0.8, "graph_lookup_pool": 16, "edge_weight": 0.12, "prior_cap": 0.24},
    "doc_intent": {"cochange_weight": 0.0, "chunk_weight": 1.05, "docs_weight": 1.35, "worktree_weight": 0.45, "test_signal_weight": 0.8, "scip_weight": 1.0, "graph_lookup_pool": 24, "edge_weight": 0.1, "prior_cap": 0.22},
    "feature": {"cochange_weight": 1.2, "chunk_weight": 1.1, "docs_weight": 0.55, "worktree_weight": 1.1, "test_signal_weight": 0.8, "scip_weight": 1.0, "graph_lookup_pool": 16, "edge_weight": 0.16, "prior_cap": 0.34},
    "refactor": {"cochange_weight": 1.0, "chunk_weight": 1.15, "docs_weight": 0.45, "worktree_weight": 0.95, "test_signal_weight": 0.9, "scip_weight": 1.35, "graph_lookup_pool": 20, "edge_weight": 0.18, "prior_cap": 0.4},
    "general": {"cochange_weight": 0.0, "chunk_weight": 1.0, "docs_weight": 0.0, "worktree_weight": 0.85, "test_signal_weight": 1.0, "scip_weight": 1.0, "graph_lookup_pool": 14, "edge_weight": 0.14, "prior_cap": 0.3},
}
MARKERS = {"bugfix_test": ["fix", "bug", "error", "failing", "traceback"], "doc_intent": ["docs", "document", "explain", "why", "how"], "refactor": ["refactor", "rename", "cleanup"], "feature": ["add", "implement", "support", "feature"]}


def choose_policy(query: str) -> tuple[str, dict[str, float]]:
    """The first policy one of whose markers stands in the query as a word."""
    words = set(re.findall("[a-z]+", query.lower()))
    name = next((n for n, marks in MARKERS.items() if words & set(marks)), "general")
    return name, POLICIES[name]


def shadow_arm(executed: str, model: dict[str, dict[str, float]], arms: list[str]) -> tuple[str, float]:
    """The arm of a set that a model holds best beside the executed one, with its confidence; none: ('', 0)."""
    scores = {a: v for a, v in model.get(executed, {}).items() if a in arms}
    best = max(scores, key=lambda a: (scores[a], a), default="")
    return best, scores.get(best, 0.0)


def worktree_prior(changed: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """node, prior: changed files 1, what depends on them directly .5."""
    near = G.reverse_dependents(changed, edges, 1, limit).select("node", F.lit(0.5).alias("prior"))
    return changed.select("node", F.lit(1.0).alias("prior")).unionByName(near)


def query_guard(changed: DataFrame, path: str, query: list[str], least: int = 1) -> DataFrame:
    """Changed paths that share at least ``least`` tokens with the query; if none does, the first one."""
    shared = F.size(F.array_intersect(code_tokens(F.col(path)), F.array(*[F.lit(q) for q in query])))
    ranked = changed.withColumn("_ok", shared >= least)
    some = ranked.agg(F.max("_ok")).scalar()
    first = ranked.agg(F.min(path)).scalar()
    return ranked.where(F.col("_ok") | (~some & (F.col(path) == first))).drop("_ok")


def chunk_guard(chunks: DataFrame, key: str, tokens: str, shape: str, penalty: float, least: float, group: str | None = None) -> DataFrame:
    """Chunks (key, score, tokens, shape) kept in order of score while score less ``penalty`` times the conflict with the kept
    ones is at least ``least``: conflict is the Jaccard likeness of the tokens at different shapes. Chunks without tokens are
    kept. Every chunk is judged among those of its ``group``, such as a plan, all at once; without a group all are one:
    group, key, kept."""
    types, by = dict(chunks.dtypes), [group] if group else []
    rows = chunks.select(*by, F.struct(F.col(key).alias("k"), "score", F.col(tokens).alias("t"), F.col(shape).alias("s")).alias("_r"))
    parts = rows.groupBy(*by).agg(F.collect_list("_r").alias("_r"))

    def judge(part: list[dict]) -> list[dict]:
        kept: list[tuple[set, object]] = []
        out = []
        for r in sorted(part, key=lambda r: (r["score"] is None, -(r["score"] or 0.0), r["k"])):
            t = set() if r["t"] is None else set(r["t"])
            against = sum(len(t & o) / len(t | o) for o, p in kept if p != r["s"] and t and o)
            ok = not t or r["score"] is not None and r["score"] - penalty * against >= least
            out.append({"k": r["k"], "kept": ok})
            if ok:
                kept.append((t, r["s"]))
        return out

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = pa.array([judge(p) for p in b.column(b.schema.get_field_index("_r")).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in by], flags], [*by, "_f"])

    flag = StructType().add("k", chunks.schema[key].dataType).add("kept", "boolean")
    kind = to_arrow_type(ArrayType(flag))
    schema = StructType([*[chunks.schema[c] for c in by], StructField("_f", ArrayType(flag))])
    judged = parts.mapInArrow(choose, schema).select(*by, F.explode("_f").alias("_f"))
    return judged.select(*by, F.col("_f.k").cast(types[key]).alias(key), "_f.kept")


def shielded(penalty: Column, linked: Column, attenuation: float = 0.5, enforce: bool = False) -> tuple[Column, Column]:
    """The penalty that counts and the shield: linked chunks are penalised less, if the shield is enforced and not only reported."""
    shield = F.when(linked, penalty * attenuation).otherwise(F.lit(0.0))
    return (penalty - shield if enforce else penalty), shield


def disclosure(mode: str, has_snippet: Column, has_signature: Column) -> tuple[Column, Column]:
    """What of a chunk is shown (refs, signature, snippet, skeleton) and why it isn't what was asked for."""
    if mode == "snippet":
        shown = F.when(has_snippet, "snippet").when(has_signature, "signature").otherwise("refs")
    elif mode in ("signature", "skeleton"):
        shown = F.when(has_signature, mode).otherwise("refs")
    else:
        shown = F.lit("refs")
    return shown, F.when(shown != mode, F.lit("not_available")).otherwise(F.lit(""))


def skeletons(chunks: DataFrame) -> DataFrame:
    """Chunks as nested skeletons: place, name, shape."""
    return chunks.select("path", F.struct(F.struct("lineno", "end_lineno").alias("span"), F.struct("qualified_name", F.element_at(F.split("qualified_name", r"\."), -1).alias("name")).alias("symbol"), (F.col("end_lineno") - F.col("lineno") + 1).alias("lines")).alias("skeleton"))


def stage_map(ranked: DataFrame, seeds: DataFrame, edges: DataFrame, key: str, k: int, neighbours: int) -> DataFrame:
    """A stage's map: the seeds, then their best-connected neighbours, then ranked files, ``k`` in all: key, reason, place."""
    seed = seeds.select(key).distinct()
    near = edges.join(seed.withColumnRenamed(key, "src"), "src").groupBy(F.col("dst").alias(key)).agg(F.sum("weight").alias("w")).join(seed, key, "left_anti").orderBy(F.desc("w"), key).limit(neighbours)
    rest = ranked.join(seed, key, "left_anti").join(near.select(key), key, "left_anti").select(key, F.lit(2).alias("_r"), F.col("score").alias("_w")).orderBy(F.desc("_w"), key).limit(k)
    rows = seed.select(key, F.lit(0).alias("_r"), F.lit(0.0).alias("_w")).unionByName(near.select(key, F.lit(1).alias("_r"), F.col("w").alias("_w"))).unionByName(rest)
    place = F.row_number().over(W.orderBy("_r", F.desc("_w"), key))
    return rows.orderBy("_r", F.desc("_w"), key).limit(k).select(key, F.element_at(F.array(F.lit("seed"), F.lit("neighbour"), F.lit("ranked")), F.col("_r") + 1).alias("reason"), place.alias("place"))


def seeded_rank(ranked: DataFrame, seeds: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Precomputed scores plus .12 for seeds and up to .08 (.01 for each edge to it) for every file."""
    degree = edges.groupBy(F.col("dst").alias(key)).agg(F.count("*").alias("_d"))
    is_seed = seeds.select(key).distinct().withColumn("_s", F.lit(0.12))
    out = ranked.join(degree, key, "left").join(is_seed, key, "left")
    return out.select(key, F.round(F.col("score") + F.coalesce("_s", F.lit(0.0)) + F.least(F.lit(0.08), F.coalesce("_d", F.lit(0)) * 0.01), 6).alias("score"))


def plan_view(chunks: DataFrame, limit: int) -> DataFrame:
    """Nodes and edges of a plan (plan_id, path, qualified_name, score): from query to files to chunks: src, dst, kind, weight."""
    top = chunks.withColumn("_n", F.row_number().over(W.partitionBy("plan_id").orderBy(F.desc_nulls_last("score"), "path", "qualified_name"))).where(F.col("_n") <= limit)
    to_file = top.select(F.concat(F.lit("query:"), F.col("plan_id")).alias("src"), F.concat(F.lit("file:"), "path").alias("dst"), F.lit("candidate").alias("kind"), F.coalesce("score", F.lit(0.0)).alias("weight"))
    to_chunk = top.select(F.concat(F.lit("file:"), "path").alias("src"), F.concat_ws(":", F.lit("chunk"), "path", "qualified_name").alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"))
    return to_file.unionByName(to_chunk).groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))


def fused_memories(semantic: DataFrame, lexical: DataFrame, key: str, limit: int, k: int = 60) -> DataFrame:
    """Two searches (key, score) fused by their ranks: key, score."""
    ranked = [d.orderBy(*order(key)).limit(limit).select(key, F.row_number().over(W.orderBy(*order(key))).alias("rank")) for d in (semantic, lexical)]
    return rrf(ranked, key, k).select(key, F.round("rrf", 9).alias("score")).orderBy(*order(key)).limit(limit)


def with_fallback(primary: Callable[[], DataFrame], secondary: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The primary source's rows, or the secondary's if it fails or has none."""
    try:
        df = primary()
        if df.take(1):
            return df, "primary"
    except Exception as e:
        return secondary(), f"failed: {type(e).__name__}"
    return secondary(), "empty"


def vacuum(rows: DataFrame, seen: Column, created: Column, now: str, ttl_days: float, age_days: float) -> DataFrame:
    """How many rows a vacuum keeps, and how many it drops for not having been seen or for age."""
    stale = F.coalesce(days_between(now, seen) > ttl_days, F.lit(False))
    old = F.coalesce(days_between(now, created) > age_days, F.lit(False))
    return rows.agg(F.count_if(~stale & ~old).alias("kept"), F.count_if(stale).alias("unseen"), F.count_if(~stale & old).alias("aged"))


def replay(stored: DataFrame, exported: DataFrame, key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Exported events recorded again: the joined log, and how many were imported, there already, or not valid."""
    fresh = exported.where(valid).join(stored.select(key), key, "left_anti").dropDuplicates([key])
    known = exported.where(valid).join(stored.select(key), key, "left_semi")
    counts = exported.agg(F.count_if(~valid).alias("invalid")).withColumns({"imported": fresh.agg(F.count("*")).scalar(), "known": known.agg(F.count("*")).scalar()})
    return stored.unionByName(fresh.select(*stored.columns)), counts


def overview(**parts: DataFrame) -> DataFrame:
    """One-row summaries side by side, their columns prefixed by their names."""
    first, *others = [df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns]) for name, df in parts.items()]
    for df in others:
        for c in df.columns:
            first = first.withColumn(c, df.agg(F.max(c)).scalar())
    return first


def issue_cases(issues: DataFrame, top_k: int = 8, lane: str = "issue_report") -> DataFrame:
    """Benchmark cases of issues (issue_id, query, selected_path) with a query and a path."""
    ok = (F.trim(text("query")) != "") & (F.trim(text("selected_path")) != "")
    return issues.where(ok).select(F.concat(F.lit("issue-"), "issue_id").alias("case_id"), "query", F.array("selected_path").alias("expected"), F.lit(top_k).alias("top_k"), F.lit(lane).alias("lane"))
