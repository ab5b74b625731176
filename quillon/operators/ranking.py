"""Ranking of files and texts. Every ranking ends in a total order: score descending, then the key.

Collection statistics are one row, used as a scalar subquery; query terms are driver-side literals, so scoring needs no
shuffle: each document is scored where it is read, and only the top rows move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import ascii_lower, code_tokens, glob_regex, signal, text, words
from quillon.session import materialise

# The weights of the scores.
PATH_EXACT, PATH_CONTAINS = 3.0, 2.0
MODULE_EXACT, MODULE_TAIL, MODULE_CONTAINS = 3.0, 2.5, 1.5
SYMBOL_EXACT, SYMBOL_PARTIAL, SYMBOL_PARTIAL_CAP = 3.0, 0.75, 2.0
IMPORT_FACTOR, IMPORT_CAP = 0.5, 1.5
CONTENT_SYMBOL, CONTENT_IMPORT, CONTENT_CAP = 0.2, 0.1, 1.0
DEPTH_BASE, DEPTH_FACTOR = 1.4, 0.15
DEPENDENCY = 0.35
K1, B, SCALE, PATH_PRIOR = 1.2, 0.75, 4.0, 0.1
SHORTLIST_MIN, SHORTLIST_FACTOR = 16, 6
HYBRID_BM25, HYBRID_HEURISTIC, HYBRID_COVERAGE, HYBRID_SCALE = 0.45, 0.45, 0.10, 10.0
HYBRID_MIN, HYBRID_FACTOR = 12, 4
RRF_K = 60
SOURCE_ROOTS = ("src/", "api/", "ui/")


def equals(value: str):
    return lambda x: x == F.lit(value)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def order(key: str, score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc(key)]


def top(df: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The first ``k`` rows by score and key, with their rank."""
    return df.orderBy(*order(key, score)).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order(key, score))))


def in_source(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [path.startswith(r) for r in SOURCE_ROOTS])


def boosted_tokens(path: Column, module: Column, symbols: Column, imports: Column) -> Column:
    """Tokens of a file's fields, path three times, module and symbols twice, imports once."""
    each = lambda c: F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: code_tokens(x, limit=96)))
    return F.flatten(F.array(*[code_tokens(path, limit=96)] * 3, *[code_tokens(module, limit=96)] * 2, *[each(symbols)] * 2, each(imports)))


def bm25(df: DataFrame, key: str, tokens: str, terms: list[str], min_score: float = 0.0, path: Column | None = None, tier: Column | None = None) -> DataFrame:
    """``key``, ``score`` and ``matched`` of each document with tokens. Documents without tokens don't count, terms aren't
    de-duplicated, scores below ``min_score`` are dropped. NULL tokens are no tokens."""
    docs = df.select(F.col(key), F.size(tokens).alias("_len"), *[F.size(F.filter(tokens, equals(q))).cast("double").alias(f"_tf{i}") for i, q in enumerate(terms)], *([path.alias("_path")] if path is not None else []), *([tier.alias("_tier")] if tier is not None else []))
    docs = materialise(docs.where(F.col("_len") > 0))  # a few numbers for each text: it is tokenised once
    n = len(terms)
    stats = docs.agg(F.struct(F.count("*").cast("double").alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(n)]).alias("s")).scalar()
    docs = docs.withColumn("_s", stats)
    norm = F.lit(1.0 - B) + F.lit(B) * (F.col("_len") / F.greatest(F.col("_s.avg"), F.lit(1e-9)))
    parts = []
    for i in range(n):
        tf, df_ = F.col(f"_tf{i}"), F.col(f"_s.df{i}")
        idf = F.log(F.lit(1.0) + (F.col("_s.n") - df_ + 0.5) / (df_ + 0.5))
        parts.append(F.when(tf > 0, idf * (tf * (K1 + 1)) / (tf + K1 * norm)).otherwise(F.lit(0.0)))
    matched = reduce(lambda a, b: a + b, [F.when(F.col(f"_tf{i}") > 0, F.lit(1)).otherwise(F.lit(0)) for i in range(n)], F.lit(0))
    score = total(parts) * SCALE
    if path is not None:
        score = score + F.when(in_source(F.col("_path")), matched * F.lit(PATH_PRIOR)).otherwise(F.lit(0.0))
    if tier is not None:
        score = score * F.when(F.col("_tier") == "dependency", F.lit(DEPENDENCY)).otherwise(F.lit(1.0))
    out = docs.select(key, F.round(score, 6).alias("score"), matched.alias("matched"))
    return out.where(F.col("score") >= max(0.0, min_score))


def heuristic(df: DataFrame, terms: list[str], min_score: float = 0.0) -> DataFrame:
    """``path`` and ``score`` of files (path, module, tier, symbols, imports) by where the terms occur. Terms of fewer than
    four letters fit only as prefixes, whole names and tails; content counts only without an exact symbol."""
    path, module = ascii_lower(text("path")), ascii_lower(text("module"))
    lower = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), ascii_lower)
    symbols, imports = lower("symbols"), lower("imports")
    depth = F.size(F.filter(F.split(text("path"), "/"), lambda p: p != ""))
    parts: list[Column] = []
    hits = lambda names, q: F.size(F.filter(names, lambda x: F.contains(x, F.lit(q)))).cast("double")
    for q in terms:
        short = len(q) < 4
        p = F.when(path.startswith(q) | F.contains(path, F.lit("/" + q)), PATH_EXACT)
        m = F.when(module == q, MODULE_EXACT).when(module.endswith("." + q), MODULE_TAIL)
        exact = F.array_contains(symbols, q)
        s = F.when(exact, SYMBOL_EXACT)
        if not short:
            p = p.when(F.contains(path, F.lit(q)), PATH_CONTAINS)
            m = m.when(F.contains(module, F.lit(q)), MODULE_CONTAINS)
            s = s.otherwise(F.least(F.lit(SYMBOL_PARTIAL_CAP), hits(symbols, q) * SYMBOL_PARTIAL))
            parts.append(F.least(F.lit(IMPORT_CAP), hits(imports, q) * IMPORT_FACTOR))
            parts.append(F.when(exact, F.lit(0.0)).otherwise(F.least(F.lit(CONTENT_CAP), hits(symbols, q) * CONTENT_SYMBOL + hits(imports, q) * CONTENT_IMPORT)))
        parts += [F.coalesce(x, F.lit(0.0)) for x in (p, m, s)]
    if terms:
        base = total(parts)
        bonus = F.when((base > 0) & in_source(F.col("path")), F.greatest(F.lit(0.0), F.lit(DEPTH_BASE) - depth * DEPTH_FACTOR)).otherwise(F.lit(0.0))
        score = base + bonus
    else:
        score = F.when(in_source(F.col("path")), F.greatest(F.lit(0.1), F.lit(2.5) - depth * 0.2)).otherwise(F.lit(0.0))
    score = score * F.when((F.col("tier") == "dependency") & (score > 0), F.lit(DEPENDENCY)).otherwise(F.lit(1.0))
    return df.select("path", F.round(score, 6).alias("score")).where(F.col("score") >= max(0.0, min_score))


def coverage(df: DataFrame, terms: list[str]) -> DataFrame:
    """``path`` and ``coverage``: of the terms the share found, as a token 1, within other text one half."""
    empty = F.array().cast("array<string>")
    blob = ascii_lower(F.concat_ws(" ", text("path"), text("module"), F.coalesce("symbols", empty), F.coalesce("imports", empty)))
    tokens = code_tokens(blob, limit=None)
    found = [F.when(F.array_contains(tokens, q), 1.0).when(F.contains(blob, F.lit(q)), 0.5).otherwise(0.0) for q in terms]
    return df.select("path", F.least(F.lit(1.0), total(found) / max(1, len(terms))).alias("coverage"))


def file_bm25(files: DataFrame, terms: list[str], min_score: float = 0.0) -> DataFrame:
    tokens = files.withColumn("_tokens", boosted_tokens(F.col("path"), F.col("module"), F.col("symbols"), F.col("imports")))
    return bm25(tokens, "path", "_tokens", terms, min_score, F.col("path"), F.col("tier"))


def bm25_two_stage(files: DataFrame, terms: list[str], top_k: int) -> DataFrame:
    """BM25 over a heuristic shortlist; the collection is the shortlist."""
    short = heuristic(files, terms, 1e-9).orderBy(*order("path")).limit(max(SHORTLIST_MIN, SHORTLIST_FACTOR * top_k))
    return file_bm25(files.join(short.select("path"), "path", "left_semi"), terms)


def rrf(rankings: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (key, rank): the sum of 1 / (k + rank); what a ranking misses adds nothing."""
    rows = reduce(DataFrame.unionByName, [r.select(key, "rank") for r in rankings])
    return rows.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("rrf"))


def over_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """``column`` divided by its maximum, 0 if that isn't positive."""
    peak = df.agg(F.max(column)).scalar()
    return df.withColumn("_peak", peak).withColumn(out, F.when(F.col("_peak") > 0, F.col(column) / F.col("_peak")).otherwise(F.lit(0.0))).drop("_peak")


def hybrid(files: DataFrame, terms: list[str], top_n: int = 10, mode: str = "linear", k: int = RRF_K) -> DataFrame:
    """BM25 shortlist scored by BM25, heuristic and coverage: path, score. ``mode`` is linear or rrf."""
    short = top(file_bm25(files, terms), "path", max(HYBRID_FACTOR * top_n, HYBRID_MIN))
    listed = files.join(F.broadcast(short.select("path")), "path", "left_semi")
    heur = heuristic(listed, terms).withColumn("rank", F.row_number().over(W.orderBy(*order("path"))))
    rows = short.select("path", F.col("score").alias("b")).join(heur.select("path", F.col("score").alias("h")), "path", "left").join(coverage(listed, terms), "path")
    rows = rows.fillna({"h": 0.0})
    all_ = W.partitionBy()  # over the shortlist alone
    peak = lambda c: F.when(F.max(c).over(all_) > 0, F.col(c) / F.max(c).over(all_)).otherwise(F.lit(0.0))
    if mode == "rrf":
        rows = rows.join(rrf([short, heur], "path", k), "path")
        score = peak("rrf") * (HYBRID_BM25 + HYBRID_HEURISTIC) + F.col("coverage") * HYBRID_COVERAGE
    else:
        score = peak("b") * HYBRID_BM25 + peak("h") * HYBRID_HEURISTIC + F.col("coverage") * HYBRID_COVERAGE
    return rows.select("path", F.round(score * HYBRID_SCALE, 6).alias("score"))


RANKERS = {
    "heuristic": lambda files, terms, k: heuristic(files, terms),
    "bm25_lite": lambda files, terms, k: bm25_two_stage(files, terms, k),
    "hybrid_re2": lambda files, terms, k: hybrid(files, terms, k),
    "rrf_hybrid": lambda files, terms, k: hybrid(files, terms, k, "rrf"),
}


def rank_files(files: DataFrame, terms: list[str], ranker: str = "heuristic", top_k: int = 10) -> DataFrame:
    """Rankers by name."""
    return RANKERS[ranker](files, terms, top_k)


def select_initial(files: DataFrame, terms: list[str], ranker: str, min_score: float, top_k: int) -> DataFrame:
    """The first ranking of a ladder that isn't empty: the ranker, the ranker with a score of 1, the heuristic, all files by
    depth. A collection of fewer than four files takes the heuristic at once."""
    if len(files.limit(4).take(4)) < 4:
        ranker = "heuristic"
    steps = [lambda: rank_files(files, terms, ranker, top_k).where(F.col("score") >= min_score), lambda: rank_files(files, terms, ranker, top_k).where(F.col("score") >= 1), lambda: heuristic(files, terms, 1e-9)]
    for step in steps:
        found = step().select("path", "score")
        if found.take(1):
            return found
    return heuristic(files, [])


def fuse_channels(pool: DataFrame, channels: dict[str, tuple[DataFrame, int]], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of several channels, each a ranking (key, rank) cut to its cap, over the pool's rows: key,
    score, rrf. Order: rrf, score, key. Rows of the pool in no channel have 0."""
    ranked = [r.where(F.col("rank") <= cap).join(pool.select(key), key, "left_semi") for r, cap in channels.values()]
    return pool.select(key, "score").join(rrf(ranked, key, k), key, "left").fillna({"rrf": 0.0})


def exact_hits(df: DataFrame, key: str, column: str, tokens: list[str]) -> DataFrame:
    """How often one of the tokens stands as a whole word, of texts where any does: key, hits."""
    pattern = "(?i)\\b(?:" + "|".join(t.replace(".", "\\.") for t in tokens) + ")\\b"
    return df.select(key, F.regexp_count(text(column), F.lit(pattern)).alias("hits")).where(F.col("hits") > 0)


def exact_scores(hits: DataFrame) -> DataFrame:
    """log1p of the hits over log1p of the most hits."""
    peak = hits.agg(F.max("hits")).scalar()
    return hits.withColumn("exact", F.least(F.lit(1.0), F.log1p("hits") / F.log1p(peak)))


def exact_boost(candidates: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Candidates (key, score) boosted by up to max(1, .35 of the top score); rows of ``scores`` that are no candidates
    come in at .15 of the top plus their boost."""
    peak = F.coalesce(candidates.agg(F.max("score")).scalar(), F.lit(0.0))
    both = candidates.select(key, "score").join(scores.select(key, "exact"), key, "full").withColumn("_top", peak)
    boost = F.coalesce("exact", F.lit(0.0)) * F.greatest(F.lit(1.0), F.col("_top") * 0.35)
    return both.select(key, F.round(F.coalesce("score", F.col("_top") * 0.15) + boost, 6).alias("score"), F.col("score").isNull().alias("injected"))


def glossary(df: DataFrame, fields: dict[str, float], stop: list[str], n: int) -> DataFrame:
    """The ``n`` words of the highest weighted count over text columns: token, score."""
    parts = [df.select(F.explode(words(F.col(c))).alias("token"), F.lit(w).alias("w")) for c, w in fields.items()]
    sums = reduce(DataFrame.unionByName, parts).where((F.length("token") >= 3) & ~F.col("token").isin(stop)).groupBy("token").agg(F.round(F.sum("w"), 6).alias("score"))
    return sums.orderBy(F.desc("score"), "token").limit(n)


def hint_scores(df: DataFrame, column: str, weight: Column, pattern: str, limit: int = 12) -> DataFrame:
    """Values a pattern finds in texts, each weighted, summed, over the maximum, the first ``limit``: value, score."""
    found = df.select(F.explode(F.array_distinct(F.regexp_extract_all(text(column), F.lit(pattern), F.lit(0)))).alias("value"), weight.alias("w"))
    sums = found.groupBy("value").agg(F.sum("w").alias("raw"))
    scored = over_max(sums, "raw", "score").select("value", F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "value").limit(limit)


def merge_passes(primary: DataFrame, secondary: DataFrame, key: str, limit: int) -> DataFrame:
    """Two passes by key with the greater score, the first pass on ties: key, score, pass."""
    rows = primary.select(key, "score", F.lit(1).alias("pass")).unionByName(secondary.select(key, "score", F.lit(2).alias("pass")))
    best = rows.groupBy(key).agg(F.max_by(F.struct("score", "pass"), F.struct("score", -F.col("pass"))).alias("b"))
    return best.select(key, "b.score", "b.pass").orderBy(*order(key)).limit(limit)


def relative_threshold(df: DataFrame, ratio: float) -> DataFrame:
    """Rows of at least ``ratio`` times the top score."""
    return df.withColumn("_top", df.agg(F.max("score")).scalar()).where(F.col("score") >= F.col("_top") * ratio).drop("_top")


def path_filter(df: DataFrame, path: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Paths that fit one of ``include`` (if there are any) and none of ``exclude``; plain paths or globs."""
    fits = lambda ps: reduce(lambda a, b: a | b, [F.col(path).rlike(glob_regex("/" + p.lstrip("/"))) for p in ps])
    if include:
        df = df.where(fits(include))
    return df.where(~fits(exclude)) if exclude else df


def quota_top_k(df: DataFrame, key: str, is_docs: Column, k: int, quota: int = 2) -> DataFrame:
    """Up to ``quota`` documents first, then up to ``quota`` others, then by rank, ``k`` in all: key, score, place."""
    first = df.select(key, "score", is_docs.alias("_docs"))
    within = F.row_number().over(W.partitionBy("_docs").orderBy(*order(key)))
    short = first.withColumn("_n", within).where(F.col("_n") <= k)
    slot = F.when(F.col("_docs") & (F.col("_n") <= quota), 0).when(~F.col("_docs") & (F.col("_n") <= quota), 1).otherwise(2)
    return short.withColumn("place", F.row_number().over(W.orderBy(slot, F.desc("score"), key))).where(F.col("place") <= k).select(key, "score", "place")


def focus(df: DataFrame, key: str, pinned: list[str]) -> DataFrame:
    """Pinned rows first, in their order, above the top score; those that aren't there come in."""
    pins = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(pinned)], f"{key} string, focus int")
    both = df.select(key, "score").join(pins, key, "full")
    peak = F.coalesce(df.agg(F.max("score")).scalar(), F.lit(0.0))
    return both.withColumn("score", F.when(F.col("focus").isNotNull(), peak + 1 - F.col("focus") * 0.001).otherwise(F.col("score"))).select(key, "score", "focus")


def priors(candidates: DataFrame, key: str, signals: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Candidates with weighted signals (key, value) added: key, score, one column for each signal."""
    out = candidates.select(key, "score")
    for name, (df, _) in signals.items():
        out = out.join(df.select(key, F.col("value").alias(name)), key, "left")
    out = out.fillna(0.0, list(signals))
    return out.withColumn("score", F.round(F.col("score") + total([F.col(n) * w for n, (_, w) in signals.items()]), 6))


def pool_rerank(df: DataFrame, key: str, weights: dict[str, float], pool: int, use_log: bool = True) -> DataFrame:
    """The pool's head re-scored by signals normalised over the pool, the tail untouched: key, score, in_pool."""
    head = top(df, key, pool)
    all_ = W.partitionBy()
    bonus = total([signal(F.col(c).cast("double"), F.max(c).over(all_).cast("double"), use_log) * w for c, w in weights.items()])
    head = head.select(key, F.round(F.col("score") + bonus, 6).alias("score"), F.lit(True).alias("in_pool"))
    return head.unionByName(df.join(head.select(key), key, "left_anti").select(key, "score", F.lit(False).alias("in_pool")))


def route(df: DataFrame, key: str, weight: Column, name: Column, context: Column, terms: list[str], k: int) -> DataFrame:
    """Weight plus 2 for each term in the name and 1 for each only in the context; the first ``k``: key, score."""
    low, ctx = ascii_lower(text(name)), ascii_lower(text(context))
    parts = [F.when(F.contains(low, F.lit(q)), 2.0).when(F.contains(ctx, F.lit(q)), 1.0).otherwise(0.0) for q in dict.fromkeys(terms)]
    return df.select(key, F.round(weight + total(parts), 6).alias("score")).orderBy(*order(key)).limit(k)


def select_skills(skills: DataFrame, query: str, intent: str, module: str, n: int = 3) -> DataFrame:
    """Skills (name, intents, modules, errors, topics, description, priority) by what of the query they mention: intent 3,
    module 2, each error phrase 4, words of modules, topics and name, capped. Only rows with a signal beyond the intent."""
    low = query.lower()
    tokens = F.array(*[F.lit(t) for t in dict.fromkeys(low.replace("-", " ").split())])
    lower = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    expand = lambda c: F.array_distinct(F.flatten(F.transform(lower(c), lambda x: F.split(x, "[^a-z0-9]+"))))
    hits = lambda names: F.size(F.array_intersect(tokens, names))
    errors = F.size(F.filter(lower("errors"), lambda e: F.contains(F.lit(low), e)))
    has_module = F.array_contains(lower("modules"), module.lower())
    by = [F.least(hits(expand("modules")), F.lit(2)), F.least(hits(expand("topics")), F.lit(3)), F.least(hits(F.split(F.lower("name"), "[^a-z0-9]+")), F.lit(2))]
    words_ = hits(F.split(F.lower(text("description")), "[^a-z0-9]+"))
    by.append(F.when(words_ >= 2, F.least(words_, F.lit(2))).otherwise(F.lit(0)))
    extra = errors * 4 + F.when(has_module, 2).otherwise(0) + by[0] + by[1] + by[2] + by[3]
    score = extra + F.when(F.array_contains(lower("intents"), intent.lower()), 3).otherwise(0)
    return skills.select("name", score.alias("score"), "priority", extra.alias("_x")).where(F.col("_x") > 0).drop("_x").orderBy(F.desc("score"), F.desc("priority"), "name").limit(n)


def suffix_score(left: DataFrame, scores: DataFrame) -> DataFrame:
    """For each ``module`` the score of the same module, else the best of those of which it is a suffix or that are a
    suffix of it (at dots): module, match. Suffixes are joined by equality, not by comparing all pairs."""
    parts = lambda c: F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda i: F.array_join(F.slice(F.split(c, r"\."), i, F.size(F.split(c, r"\."))), ".")), lambda s: s != "")
    own = left.select("module").distinct()
    exact = own.join(scores.where(F.col("score") > 0).select("module", F.col("score").alias("exact")), "module", "left")
    longer = own.join(scores.select(F.explode(parts(F.col("module"))).alias("module"), F.col("score").alias("s")), "module").groupBy("module").agg(F.max("s").alias("a"))
    shorter = own.select("module", F.explode(parts(F.col("module"))).alias("m")).join(scores.select(F.col("module").alias("m"), F.col("score").alias("s")), "m").groupBy("module").agg(F.max("s").alias("b"))
    both = exact.join(longer, "module", "left").join(shorter, "module", "left")
    return both.select("module", F.coalesce("exact", F.greatest("a", "b"), F.lit(0.0)).alias("match"))


def budget_prefix(df: DataFrame, key: str, tokens: str, budget: int) -> DataFrame:
    """The ranked prefix whose tokens stay within the budget, and where it stops: key, score, running."""
    running = F.sum(tokens).over(W.orderBy(*order(key)).rowsBetween(W.unboundedPreceding, 0))
    return df.orderBy(*order(key)).limit(max(1, budget)).withColumn("running", running).where(F.col("running") <= budget).select(key, "score", F.col("running").cast("bigint").alias("running"))



def symbol_score(files: DataFrame, terms: list[str]) -> DataFrame:
    """path, symbol: the best of a file's symbols, 2 for one that is a term and 1 for one that contains it, over all terms. Files
    without symbols have no row."""
    rows = files.select("path", F.explode("symbols").alias("_s"))
    x = ascii_lower(text("_s"))
    each = [F.when(x == t, 2.0).when(F.contains(x, F.lit(t)), 1.0).otherwise(0.0) for t in terms]
    return rows.groupBy("path").agg(F.max(F.greatest(F.lit(0.0), *each)).alias("symbol"))
