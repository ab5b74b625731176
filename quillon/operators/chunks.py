"""Chunks of files: scores, faults located by tests, selection under limits, confidence.

Chunk rows carry path, qualified_name, kind, lineno, end_lineno, score. Joins of points with line spans go by cells of
lines, so they are equi-joins. Greedy selections run on a pool that is cut to a fixed size first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import ascii_lower, estimate_tokens, jaccard, text
from quillon.operators.ranking import total
from quillon.session import materialise

# The weights of chunk scores and penalties.
FILE_PRIOR, PATH_MATCH, MODULE_MATCH = 0.35, 1.0, 0.8
SYMBOL_EXACT, SYMBOL_PARTIAL, SIGNATURE_MATCH = 2.5, 1.4, 0.5
REFERENCE_FACTOR, REFERENCE_CAP = 0.3, 2.5
SAME_PATH, SAME_FAMILY, SAME_KIND, NEARBY, NEARBY_LINES = 0.20, 0.30, 0.10, 0.15, 24

KEY = ["path", "lineno", "end_lineno", "qualified_name"]


def family(name: Column) -> Column:
    """The last dotted part of a qualified name."""
    return F.element_at(F.split(text(name), r"\."), -1)


def reference_hits(references: DataFrame) -> DataFrame:
    """name, hits."""
    return references.groupBy("name").agg(F.count("*").alias("hits"))


def chunk_scores(chunks: DataFrame, files: DataFrame, hits: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks (path, module, qualified_name, signature, lines) scored by their file's score and by each term in path, module,
    name and signature, plus what refers to them."""
    path, module = ascii_lower(text("path")), ascii_lower(text("module"))
    name, signature = ascii_lower(family(F.col("qualified_name"))), ascii_lower(text("signature"))
    full = ascii_lower(text("qualified_name"))
    has = lambda c, q: F.contains(c, F.lit(q))
    parts = []
    for q in terms:
        parts.append(F.when(has(path, q), PATH_MATCH).otherwise(0.0))
        parts.append(F.when(has(module, q), MODULE_MATCH).otherwise(0.0))
        parts.append(F.when((name == q) | (full == q), SYMBOL_EXACT).when(has(full, q), SYMBOL_PARTIAL).otherwise(0.0))
        parts.append(F.when(has(signature, q), SIGNATURE_MATCH).otherwise(0.0))
    rows = chunks.join(files.select("path", F.col("score").alias("_file")), "path").join(hits.select(F.col("name").alias("qualified_name"), "hits"), "qualified_name", "left")
    refs = F.least(F.lit(REFERENCE_CAP), F.coalesce("hits", F.lit(0)) * REFERENCE_FACTOR)
    return rows.select(*KEY, F.round(F.col("_file") * FILE_PRIOR + total(parts) + refs, 6).alias("score"))


def sbfl(ef: Column, ep: Column, nf: Column, metric: str = "ochiai") -> Column:
    """Suspiciousness of executed-by-failing (ef), executed-by-passing (ep) and failing-without (nf) counts: ochiai or
    dstar; 0 where the denominator is 0, except a D* of ef squared where only failing tests execute it."""
    ef, ep, nf = (c.cast("double") for c in (ef, ep, nf))
    if metric == "ochiai":
        down = F.sqrt((ef + nf) * (ef + ep))
        return F.when(down > 0, ef / down).otherwise(F.lit(0.0))
    down = ep + nf
    return F.when(down > 0, ef * ef / down).when(ef > 0, ef * ef).otherwise(F.lit(0.0))


def points_in_spans(points: DataFrame, spans: DataFrame, key: list[str], cell: int = 64) -> DataFrame:
    """Pairs of points (path, line) and spans (key columns with path, lineno, end_lineno) around them, by cells of lines."""
    ends = F.greatest("lineno", "end_lineno")
    cut = spans.select(*key, ends.alias("_end")).distinct().withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lineno") / cell).cast("bigint"), F.floor(F.col("_end") / cell).cast("bigint"))))
    rows = points.withColumn("_cell", F.floor(F.col("line") / cell).cast("bigint"))
    return rows.join(cut, ["path", "_cell"]).where(F.col("line").between(F.col("lineno"), F.col("_end"))).drop("_cell", "_end")


def suspicious(chunks: DataFrame, frames: DataFrame, faults: DataFrame, covered: DataFrame, n: int = 12) -> DataFrame:
    """Chunks by what tests say of their lines: 1.5 times the summed fault scores, plus stack frames, plus .05 for each
    covered line up to 1; the first ``n`` with a positive score."""
    lines = [
        frames.select("path", "line", F.lit(1.0).alias("f"), F.lit(0.0).alias("s"), F.lit(0.0).alias("c")),
        faults.select("path", "line", F.lit(0.0).alias("f"), F.greatest(F.lit(0.0), F.col("score")).alias("s"), F.lit(0.0).alias("c")),
        covered.select("path", "line").distinct().select("path", "line", F.lit(0.0).alias("f"), F.lit(0.0).alias("s"), F.lit(1.0).alias("c")),
    ]
    points = reduce(DataFrame.unionByName, lines).groupBy("path", "line").agg(*[F.sum(x).alias(x) for x in "fsc"])
    hits = points_in_spans(points, chunks.where(F.col("lineno") > 0), KEY).groupBy(*KEY).agg(*[F.sum(x).alias(x) for x in "fsc"])
    score = F.round(F.col("s") * 1.5 + F.col("f") + F.least(F.lit(1.0), F.col("c") * 0.05), 6)
    return hits.select(*KEY, score.alias("score")).where(F.col("score") > 0).orderBy(F.desc("score"), "path", "lineno", "qualified_name").limit(n)


def merge_ranked(suspects: DataFrame, candidates: DataFrame, weight: float = 1.0) -> DataFrame:
    """Both kinds of chunks by key, scores added, those of tests times ``weight``: key, score, from_tests."""
    rows = suspects.select(*KEY, (F.col("score") * weight).alias("score"), F.lit(1).alias("t")).unionByName(candidates.select(*KEY, "score", F.lit(0).alias("t")))
    return rows.groupBy(*KEY).agg(F.round(F.sum("score"), 6).alias("score"), F.max("t").alias("from_tests"))


def per_file(chunks: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` chunks of each path."""
    place = F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "lineno", "qualified_name"))
    return chunks.withColumn("place", place).where(F.col("place") <= limit)


def chunk_tokens(path: Column, name: Column, signature: Column, snippet: Column) -> Column:
    """max(12, words + 8)."""
    return F.greatest(F.lit(12), estimate_tokens(F.concat_ws(" ", text(path), text(name), text(signature), text(snippet))) + 8)


def _pool(chunks: DataFrame, n: int) -> DataFrame:
    return chunks.orderBy(F.desc("score"), "path", "lineno", "qualified_name").limit(n)


def select_diverse(chunks: DataFrame, k: int, budget: int, limit: int = 3, pool: int = 256) -> DataFrame:
    """Chunks (key, kind, score, tokens) chosen one by one: the greatest score less what it shares with those chosen (file,
    last name, kind, nearness of lines), at most ``limit`` from a file, within the budget of tokens. The pool is the
    best ``pool`` chunks, so the choice is one bounded task: key, score, place."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "path", "lineno", "qualified_name"], ascending=[False, True, True, True]).reset_index(drop=True)
        penalty = pd.Series(0.0, index=rows.index)
        last = rows.qualified_name.str.rsplit(".", n=1).str[-1]
        left, used, of_file, out = set(rows.index), 0, {}, []
        while left and len(out) < k:
            best = min(left, key=lambda i: (-(rows.score[i] - penalty[i]), i))
            left.discard(best)
            row = rows.loc[best]
            if of_file.get(row.path, 0) >= limit or used + row.tokens > budget:
                continue
            used += row.tokens
            of_file[row.path] = of_file.get(row.path, 0) + 1
            out.append((row.path, row.lineno, row.end_lineno, row.qualified_name, round(row.score - penalty[best], 6), len(out) + 1))
            same = rows.path == row.path
            near = same & ((rows.lineno - row.lineno).abs() <= NEARBY_LINES)
            penalty += same * SAME_PATH + (last == last[best]) * SAME_FAMILY + (rows.kind == row.kind) * SAME_KIND + near * NEARBY
        return pd.DataFrame(out, columns=[*KEY, "score", "place"])

    rows = _pool(chunks, pool).select(*KEY, F.coalesce("kind", F.lit("")).alias("kind"), "score", "tokens")
    return rows.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(choose, "path string, lineno int, end_lineno int, qualified_name string, score double, place int")


def conflict(a: Column, b: Column, same_shape: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two token sets as a conflict; none at equal shapes or below ``least``."""
    j = jaccard(a, b)
    return F.when(same_shape | (j < least), F.lit(0.0)).otherwise(j)


def _parts(size: int, threshold: float) -> int:
    """Two more than the tokens in which two sets of up to ``size`` tokens and that likeness can differ."""
    return math.floor((1 - threshold) / (1 + threshold) * 2 * size + 1e-6) + 2


def _signatures(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """_id and hashes of tokens: _id, level, part, sig. A level is a class of sizes whose neighbours differ by the threshold;
    tokens fall into a part each by their hash, and sig is the sum of a part's hashes."""
    base = 1 / (threshold - 1e-6)
    for b in batches:
        ids, hashes = b.column(0), b.column(1)
        rows, levels, parts, sigs = [], [], [], []
        for i, h in enumerate(hashes):
            h = h.values.to_numpy(zero_copy_only=False).view(np.uint64)
            own = math.floor(math.log(len(h), base))
            for level in (own, own + 1):
                n = _parts(math.ceil(base ** (level + 1)), threshold)
                sig = np.zeros(n, np.uint64)
                np.add.at(sig, (h % np.uint64(n)).astype(np.int64), h)
                rows.append(np.full(n, i)), levels.append(np.full(n, level, np.int32)), parts.append(np.arange(n, dtype=np.int32)), sigs.append(sig.view(np.int64))
        if rows:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(rows))), *[pa.array(np.concatenate(x)) for x in (levels, parts, sigs)]], ["_id", "level", "part", "sig"])


def _like(sets: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of ids of token sets (_id, _g, _o, _t) among ``firsts`` (_id), of one group and at least as like as
    ``threshold``, the first in order before the second. A level has two parts more than tokens in which sets that like can
    differ, so two parts at least are the same in both: pairs meet by equality, none is missed, and those that meet twice on a
    level are verified."""
    hashed = sets.select("_id", F.transform("_t", lambda t: F.xxhash64(t)).alias("h")).where(F.size("h") > 0)
    signed = hashed.mapInArrow(lambda batches: _signatures(batches, threshold), "_id bigint, level int, part int, sig bigint")
    keyed = signed.join(firsts.select("_id", F.xxhash64("_g").alias("g")), "_id").select("_id", "level", F.xxhash64("g", "part", "sig").alias("sig"))
    met = keyed.withColumnRenamed("_id", "a").join(keyed.withColumnRenamed("_id", "b"), ["level", "sig"]).where(F.col("a") < F.col("b"))
    met = met.groupBy("a", "b", "level").agg(F.count("*").alias("n")).where(F.col("n") >= 2).select("a", "b").distinct()
    side = lambda x: sets.select(F.col("_id").alias(x), F.struct("_id", "_g", "_o", "_t").alias(f"s{x}"))
    both = materialise(met).join(side("a"), "a").join(side("b"), "b")
    alike = both.where(F.col("sa._g").eqNullSafe(F.col("sb._g")) & (jaccard(F.col("sa._t"), F.col("sb._t")) >= threshold))
    ahead = F.col("sa._o") < F.col("sb._o")
    return alike.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b"))


def _first_wins(pairs: DataFrame) -> DataFrame:
    """_id: what falls to a better one that stands. In each round those that no open pair puts behind another stand, and what is
    like them falls."""
    live, fallen = materialise(pairs), None
    while live.take(1):
        heads = live.select("a").join(live.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        gone = materialise(live.join(heads, "a", "left_semi").select(F.col("b").alias("_id")).distinct())
        fallen = gone if fallen is None else fallen.unionByName(gone)
        live = materialise(live.join(gone.withColumnRenamed("_id", "a"), "a", "left_anti").join(gone.withColumnRenamed("_id", "b"), "b", "left_anti"))
    return live.select(F.col("a").alias("_id")) if fallen is None else fallen


def greedy_distinct(rows: DataFrame, key: str, group: str, tokens: str, threshold: float) -> DataFrame:
    """Within each group, rows in order of score, key that are less like all kept ones than ``threshold`` (above 0, 1 at most;
    Jaccard of token sets): key, group, kept, for every row. Keys are unique in a group. Rows without tokens are like none.
    Of equal sets only the first can be kept; pairs of like sets are found by equality and resolved in rounds. Made for high
    thresholds: the lower it is, the more pairs meet."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sets = F.array_sort(F.array_distinct(F.coalesce(F.col(tokens), F.array().cast(rows.schema[tokens].dataType))))
    place = F.struct(F.col("score").isNull().alias("n"), (-F.col("score")).alias("s"), F.col(key).alias("k"))
    base = rows.select(F.col(key).alias("_k"), F.struct(F.col(group).alias("g")).alias("_g"), place.alias("_o"), sets.alias("_t"))
    base = materialise(base.withColumns({"_d": F.sha2(F.to_json("_t"), 256), "_id": F.monotonically_increasing_id()}))
    firsts = base.where(F.size("_t") > 0).groupBy("_g", "_d").agg(F.min(F.struct("_o", "_id")).alias("_f"))
    firsts = materialise(firsts.select("_g", F.col("_f._id").alias("_id")))
    kept = firsts.join(_first_wins(_like(base, firsts, threshold)), "_id", "left_anti").select("_id", F.lit(True).alias("_kept"))
    out = base.select("_k", "_g", "_id", (F.size("_t") == 0).alias("_bare")).join(kept, "_id", "left")
    return out.select(F.col("_k").alias(key), F.col("_g.g").alias(group), (F.col("_bare") | F.coalesce("_kept", F.lit(False))).alias("kept"))


# Tier and score by the signals of a score breakdown.
BOOST_TIERS = {
    "graph_closure_bonus": 0.78,
    "cochange_boost": 0.75,
    "graph_lookup_boost": 0.75,
    "scip_reference_boost": 0.82,
    "xref_boost": 0.72,
    "coverage_boost": 0.70,
}


def confidence(evidence: Column, breakdown: Column | None = None) -> tuple[Column, Column]:
    """Tier and score of a chunk by its evidence (role, sources) and the map of its score's parts, by ordered rules."""
    role = F.lower(F.trim(text(evidence["role"])))
    source = lambda s: F.coalesce(F.array_contains(evidence["sources"], s), F.lit(False))
    boost = lambda k: F.coalesce(F.try_element_at(breakdown, F.lit(k)), F.lit(0.0)) > 0 if breakdown is not None else F.lit(False)
    hint, candidate = source("test_hint"), source("direct_candidate")
    rules = [
        ((role == "direct") & candidate, "EXTRACTED", 1.0),
        (role == "direct", "EXTRACTED", 0.95),
        ((role == "neighbor_context") & boost("graph_closure_bonus"), "INFERRED", 0.85),
        (role == "neighbor_context", "INFERRED", 0.72),
        *[(boost(k), "INFERRED", v) for k, v in BOOST_TIERS.items()],
        ((role == "hint_only") & hint, "AMBIGUOUS", 0.35),
        (role == "hint_only", "AMBIGUOUS", 0.28),
        (hint & ~candidate, "INFERRED", 0.65),
        (boost("budget_truncation_penalty"), "AMBIGUOUS", 0.25),
        (source("fallback_ranker"), "AMBIGUOUS", 0.20),
        (source("stale_memory"), "AMBIGUOUS", 0.18),
    ]
    tier, score = F.lit("UNKNOWN"), F.lit(0.0)
    for when, t, v in reversed(rules):
        tier, score = F.when(when, F.lit(t)).otherwise(tier), F.when(when, F.lit(v)).otherwise(score)
    return tier, score


def confidence_summary(df: DataFrame, tier: str = "tier", by: list[str] | None = None) -> DataFrame:
    """Counts of each tier, their total, and strength: the share of EXTRACTED plus .75 of INFERRED plus .25 of AMBIGUOUS."""
    of = lambda t: F.count_if(F.col(tier) == t)
    n = F.count("*")
    strength = F.round((of("EXTRACTED") + of("INFERRED") * 0.75 + of("AMBIGUOUS") * 0.25) / F.greatest(n, F.lit(1)), 6)
    aggs = [of("EXTRACTED").alias("extracted"), of("INFERRED").alias("inferred"), of("AMBIGUOUS").alias("ambiguous"), of("UNKNOWN").alias("unknown"), n.alias("total"), strength.alias("strength")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def grounding(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares of chunks with direct retrieval, neighbour context and hints alone."""
    n = F.greatest(F.count("*"), F.lit(1))
    flags = {"direct": "direct_retrieval", "neighbor": "neighbor_context", "hint_only": "hint_only"}
    out = []
    for name, column in flags.items():
        c = F.count_if(F.coalesce(F.col(column).cast("string").isin("true", "1", "1.0"), F.lit(False)))
        out += [c.alias(f"{name}_count"), F.round(c / n, 6).alias(f"{name}_ratio")]
    return evidence.groupBy(*by).agg(F.count("*").alias("chunks"), *out)


def refine_action(score: Column, focused: Column, strong: Column, support: Column, is_test: Column) -> Column:
    """keep, need_more_read, downrank or drop."""
    return (
        F.when(focused & (strong | (score >= 0.6)), "keep")
        .when(strong & (score >= 0.25), "need_more_read")
        .when(focused & (support | (score >= 0.15)), "need_more_read")
        .when(is_test & ~focused & ~strong, "drop")
        .when(support | (score >= 0.1), "downrank")
        .otherwise("drop")
    )


def signature(path: Column, name: Column, kind: Column, signature_: Column) -> Column:
    """A short hash of a chunk's shape: kind, number of parameters, depth of name and path."""
    params = F.size(F.split(text(signature_), ","))
    return F.substring(F.sha2(F.concat_ws("|", text(kind), params.cast("string"), F.size(F.split(text(name), r"\.")).cast("string"), F.size(F.split(text(path), "/")).cast("string")), 256), 1, 12)


def cards(chunks: DataFrame, n: int) -> DataFrame:
    """The first chunks as cards, and the file of each as a card of its own."""
    top = _pool(chunks, n)
    return top.select("path", F.struct(*KEY, "score").alias("chunk_card"), F.struct("path", F.count("*").over(W.partitionBy("path")).alias("chunks")).alias("file_card"))


def pack_greedy(chunks: DataFrame, focused: list[str], k: int, bonus: float = 0.15) -> DataFrame:
    """Up to ``k`` chunks, step by step: focused files not yet covered first, then the best score, with ``bonus`` for files
    already packed: key, place. Of each file at most its best ``k`` chunks can be packed, and files that aren't focused are
    opened in order of their best chunk, so those of the focused and of the first ``k`` files are all that matters."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        left = list(rows.sort_values(["score", "path", "lineno", "qualified_name", "end_lineno"], ascending=[False, True, True, True, True]).itertuples())
        used: set = set()
        out = []
        while left and len(out) < k:
            best = min(left, key=lambda r: (not (r.path in focused and r.path not in used), -(r.score + (bonus if r.path in used else 0.0)), r.path, r.lineno, r.qualified_name, r.end_lineno))
            left.remove(best)
            used.add(best.path)
            out.append((best.path, best.lineno, best.end_lineno, best.qualified_name, len(out) + 1))
        return pd.DataFrame(out, columns=[*KEY, "place"])

    place = F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "lineno", "qualified_name", "end_lineno"))
    best = materialise(chunks.select(*KEY, "score").withColumn("_n", place).where(F.col("_n") <= k))
    is_focused = F.col("path").isin(focused)
    opened = best.where((F.col("_n") == 1) & ~is_focused).orderBy(F.desc("score"), "path").limit(k).select("path")
    pool = best.where(is_focused).unionByName(best.where(~is_focused).join(F.broadcast(opened), "path", "left_semi"))
    return pool.select(*KEY, "score", F.lit(1).alias("_g")).groupBy("_g").applyInPandas(choose, "path string, lineno int, end_lineno int, qualified_name string, place int")
