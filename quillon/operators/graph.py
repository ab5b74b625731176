"""Graphs as edge tables (src, dst, weight): ranks, distances, expansions, co-change, propagation.

Iterations cut their lineage by writing each round's state, which is one row for each node.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import half_life, tail_symbol
from quillon.session import materialise

DAMPING = 0.85


def _step(nodes: DataFrame, ranks: DataFrame, edges: DataFrame, base: Column, spread: Column) -> DataFrame:
    """One round: base plus the damped rank along the edges plus the share of nodes without out-edges (``sink``)."""
    flow = edges.join(ranks.select("node", "rank"), edges.src == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("part")).alias("flow"))
    lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0))).scalar()
    joined = nodes.join(flow, nodes.node == flow.dst, "left").withColumn("_lost", lost)
    return joined.select("node", "seed", "sink", (base + DAMPING * F.coalesce("flow", F.lit(0.0)) + DAMPING * F.col("_lost") * spread).alias("rank"))


def _parts(edges: DataFrame, weight: bool) -> DataFrame:
    w = F.col("weight") if weight else F.col("n")
    sums = edges.where(F.col("weight") > 0).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").cast("double").alias("n"))
    out = sums.groupBy("src").agg(F.sum(w).alias("out"))
    return sums.join(out, "src").select("src", "dst", (w / F.col("out")).alias("part"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 12, weighted: bool = False, seeds: list | None = None, normalise: bool = False) -> DataFrame:
    """node, rank after a fixed number of rounds with damping .85.

    Plain: edges count as often as they occur, the rank of nodes without out-edges is spread evenly. ``weighted``: edges
    by their weight. ``seeds``: ranks start at and return to the seeds, each round normalised. ``normalise``: the result
    adds up to 1. Edges to unknown nodes are dropped; a single node has rank 1; no nodes give no rows. The edges are
    put in order of their sources once and stay there, so that a round moves ranks alone; its ranks, which the next
    needs twice, are written."""
    nodes = nodes.select("node").distinct()
    n = nodes.count()
    if n <= 1:
        return nodes.select("node", F.lit(1.0).alias("rank"))
    edges = materialise(edges.select("src", "dst", "weight"))
    known = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    parts = materialise(_parts(known, weighted))
    seed = F.when(F.col("node").isin(seeds), 1.0 / len(seeds)).otherwise(0.0) if seeds else F.lit(1.0 / n)
    sources = parts.select(F.col("src").alias("node"), F.lit(False).alias("_s")).distinct()
    nodes = materialise(nodes.join(sources, "node", "left").select("node", seed.alias("seed"), F.coalesce("_s", F.lit(True)).alias("sink")))
    held = parts.repartition("src").persist()
    ranks = nodes.withColumn("rank", F.col("seed"))
    for _ in range(rounds):
        ranks = materialise(_step(nodes, ranks, held, (1 - DAMPING) * F.col("seed"), F.col("seed")))
        if seeds:
            ranks = ranks.withColumn("rank", F.col("rank") / ranks.agg(F.sum("rank")).scalar())
    held.unpersist()
    if normalise:
        ranks = ranks.withColumn("rank", F.col("rank") / ranks.agg(F.sum("rank")).scalar())
    return ranks.select("node", "rank")


def distances(starts: DataFrame, edges: DataFrame, depth: int | None = None, every: int = 16) -> DataFrame:
    """start, node, depth: the nodes reached from each start along the edges, with the fewest steps (1 or more; a start in
    a cycle reaches itself), up to ``depth``, or all that can be reached. What was found is written as one table every
    ``every`` steps."""
    hops = edges.select("src", "dst").distinct()
    seen = materialise(starts.select(F.col("node").alias("start")).distinct().join(hops, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(1).alias("depth")))
    front = seen
    for d in count(2) if depth is None else range(2, depth + 1):
        step = front.join(hops, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = materialise(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
        if d % every == 0:
            seen = materialise(seen)
    return seen


def depth_centrality(nodes: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """node, centrality: the sum of 1 / steps over all nodes from which it is reached, within ``depth`` steps if given."""
    sums = distances(nodes, edges, depth).groupBy("node").agg(F.sum(F.lit(1.0) / F.col("depth")).alias("c"))
    return nodes.select("node").distinct().join(sums, "node", "left").select("node", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("centrality"))


def reverse_dependents(changed: DataFrame, edges: DataFrame, depth: int, extra: int) -> DataFrame:
    """node, depth: what depends on the changed nodes, nearest first, at most ``extra`` nodes."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = distances(changed, back, depth).groupBy("node").agg(F.min("depth").alias("depth"))
    return found.join(changed.select("node"), "node", "left_anti").orderBy("depth", "node").limit(extra)


def neighbours(seeds: DataFrame, edges: DataFrame, depth: int, limit: int) -> DataFrame:
    """node, depth: nodes around the seeds along the edges, nearest first, at most ``limit``."""
    found = distances(seeds, edges, depth).groupBy("node").agg(F.min("depth").alias("depth"))
    return found.join(seeds.select("node"), "node", "left_anti").orderBy("depth", "node").limit(limit)


def import_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """src, dst: files that import a module, to the first file (by path) of that module; no loops, each once."""
    home = modules.groupBy("module").agg(F.min("path").alias("dst"))
    return imports.select(F.col("path").alias("src"), "module").join(home, "module").where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """path, target, how: each import (path, module, name) to a file: of that module, of module.name, else by the file's
    stem if it is the only one of that stem."""
    home = modules.groupBy("module").agg(F.min("path").alias("target"))
    stems = modules.withColumn("stem", F.element_at(F.split("module", r"\."), -1)).groupBy("stem").agg(F.min("path").alias("target"), F.count("*").alias("n")).where(F.col("n") == 1)
    full = F.concat_ws(".", "module", "name")
    a = imports.join(home.withColumnRenamed("target", "t1"), "module", "left")
    b = a.join(home.select(F.col("module").alias("m2"), F.col("target").alias("t2")), full == F.col("m2"), "left")
    c = b.join(stems.select("stem", F.col("target").alias("t3")), F.element_at(F.split("module", r"\."), -1) == F.col("stem"), "left")
    how = F.when(F.col("t1").isNotNull(), "module").when(F.col("t2").isNotNull(), "member").when(F.col("t3").isNotNull(), "stem")
    return c.select("path", "module", F.coalesce("t1", "t2", "t3").alias("target"), how.alias("how")).where(F.col("target").isNotNull())


# What a reference of each kind weighs.
KIND_WEIGHTS = {"reference": 1.0, "call": 2.0, "invoke": 2.0, "inherits": 2.5, "inheritance": 2.5, "extends": 2.5, "implements": 2.0}
KIND_DEFAULT = 1.0


def reference_edges(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst, weight: references (path, name, kind) to the files that define the name or its last part, weighted by kind
    and summed; no loops. Multiplicity is a weight, not repeated rows."""
    kind = reduce(lambda out, kv: F.when(F.lower("kind") == kv[0], F.lit(kv[1])).otherwise(out), KIND_WEIGHTS.items(), F.lit(KIND_DEFAULT))
    keys = F.array_distinct(F.array(F.col("name"), tail_symbol(F.col("name"))))
    refs = references.select(F.col("path").alias("src"), F.explode(keys).alias("key"), kind.alias("w"))
    refs = refs.groupBy("src", "key").agg(F.sum("w").alias("w"))
    defs = symbols.select(F.col("name").alias("key"), F.col("path").alias("dst")).distinct()
    return refs.join(defs, "key").where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.sum("w").alias("weight"))


def adjacency(edges: DataFrame, targets: int = 24) -> DataFrame:
    """The heaviest ``targets`` edges of each source, ties by target: src, dst, weight, place."""
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return edges.withColumn("place", place).where(F.col("place") <= targets)


def rare_keys(symbols: DataFrame, most: int = 3) -> DataFrame:
    """Symbols whose name is defined at most ``most`` times."""
    return symbols.join(symbols.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("name"), "name", "left_semi")


def enclosing(points: DataFrame, spans: DataFrame, cell: int = 64) -> DataFrame:
    """For each point (path, line) the innermost span (path, name, lineno, end_lineno) around it: smallest, then latest
    start, then name. Spans are cut into cells of lines, so the join is by equality on path and cell."""
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lineno") / cell).cast("int"), F.floor(F.greatest("lineno", "end_lineno") / cell).cast("int"))))
    on = points.select("path", "line").distinct().withColumn("cell", F.floor(F.col("line") / cell).cast("int")).join(cells, ["path", "cell"]).where(F.col("line").between(F.col("lineno"), F.col("end_lineno")))
    best = F.min_by(F.struct("name", "lineno", "end_lineno"), F.struct(F.col("end_lineno") - F.col("lineno"), -F.col("lineno"), "name"))
    return on.groupBy("path", "line").agg(best.alias("s")).select("path", "line", "s.name", "s.lineno", "s.end_lineno")


def cochange(baskets: DataFrame, now: str, half_life_days: float = 30.0) -> DataFrame:
    """src, dst, score of items changed together: baskets (basket, ts, item) of two items or more, each ordered pair weighted
    by .5 ** (age / half-life, at least a day); baskets of the future have age 0. The pairs are what is asked for, so the
    cost is that of the result."""
    items = baskets.select("basket", "ts", "item").distinct()
    sizes = items.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("ts")) / F.lit(86_400e6))
    rows = items.join(sizes.select("basket"), "basket", "left_semi").withColumn("w", half_life(age, max(1.0, half_life_days)))
    other = rows.select("basket", F.col("item").alias("dst"))
    pairs = rows.join(other, "basket").where(F.col("item") != F.col("dst"))
    return pairs.groupBy(F.col("item").alias("src"), "dst").agg(F.sum("w").alias("score"))


def top_neighbours(pairs: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` best of each source: src, dst, score, place."""
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return pairs.withColumn("place", place).where(F.col("place") <= cap)


def query_neighbours(pairs: DataFrame, seeds: list, n: int) -> DataFrame:
    """dst, score summed over the seeds, without the seeds, the first ``n``."""
    sums = pairs.where(F.col("src").isin(seeds) & ~F.col("dst").isin(seeds)).groupBy("dst").agg(F.round(F.sum("score"), 6).alias("score"))
    return sums.orderBy(F.desc("score"), "dst").limit(n)


def inbound(edges: DataFrame) -> DataFrame:
    """node, inbound (edges), weight, and out: the degree table of a graph."""
    a = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"), F.sum("weight").alias("weight"))
    b = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outbound"))
    return a.join(b, "node", "full").fillna(0)


def propagate(seeds: DataFrame, edges: DataFrame, weight: float, cap: float, hub_cap: float = 8.0, hub_weight: float = 0.02) -> DataFrame:
    """node, bonus: seeds (node, strength) push weight * max(.5, strength) less a hub penalty to their neighbours; a node's
    addends are summed up to ``cap``. The penalty grows with the target's in-degree beyond ``hub_cap``, up to .8 cap."""
    degree = edges.groupBy("dst").agg(F.count("*").alias("deg"))
    hub = F.least(F.lit(0.8 * cap), F.greatest(F.lit(0.0), F.col("deg") - F.lit(hub_cap)) * hub_weight)
    push = seeds.join(edges, seeds.node == edges.src).join(degree, "dst")
    add = F.greatest(F.lit(0.0), F.greatest(F.lit(0.5), F.col("strength")) * weight - hub)
    return push.groupBy(F.col("dst").alias("node")).agg(F.round(F.least(F.lit(cap), F.sum(add)), 6).alias("bonus"))


def closure(anchors: DataFrame, chunks: DataFrame, edges: DataFrame, bonus: float, cap: float) -> DataFrame:
    """node, bonus of chunks (node, path, parent) that are neighbours of an anchor and share its file or its non-empty
    parent: ``bonus`` for each anchor up to ``cap``."""
    a = anchors.join(chunks, "node").select(F.col("node").alias("src"), F.col("path").alias("ap"), F.col("parent").alias("aq"))
    t = chunks.select(F.col("node").alias("dst"), "path", "parent")
    on = a.join(edges.select("src", "dst"), "src").join(t, "dst").where((F.col("ap") == F.col("path")) | ((F.col("aq") != "") & (F.col("aq") == F.col("parent"))))
    return on.groupBy(F.col("dst").alias("node")).agg(F.round(F.least(F.lit(cap), F.count("*") * F.lit(bonus)), 6).alias("bonus"))


def seed_strength(lexical: Column, prior: Column, least_lexical: float, least_prior: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(lexical / least_lexical, F.lit(0.6) * prior / least_prior))


def triple_neighbourhood(triples: DataFrame, seeds: list[str], hops: int = 2, limit: int = 50) -> DataFrame:
    """Facts (handle, subject, predicate, object, confidence, as_of) within ``hops`` of the seeds, with the hop, the surest
    and newest first: at most ``limit`` of each hop. No node is visited twice."""
    front = triples.sparkSession.createDataFrame([(s,) for s in seeds], "node string")
    seen, out = front, None
    for hop in range(1, hops + 1):
        touched = triples.join(F.broadcast(front.withColumnRenamed("node", "subject")), "subject", "left_semi").unionByName(
            triples.join(F.broadcast(front.withColumnRenamed("node", "object")), "object", "left_semi")
        )
        found = touched.distinct().orderBy(F.desc("confidence"), F.desc("as_of"), "handle", "object").limit(limit).withColumn("hop", F.lit(hop))
        if out is not None:
            found = found.join(out.select("handle"), "handle", "left_anti")
        found = materialise(found)
        out = found if out is None else out.unionByName(found)
        ends = found.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
        front = materialise(ends.join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    return out


def graph_view(triples: DataFrame) -> DataFrame:
    """node, roles (sorted, joined by commas), facts of a set of triples."""
    roles = triples.select(F.explode(F.array(F.struct(F.col("subject").alias("node"), F.lit("subject").alias("role")), F.struct(F.col("object").alias("node"), F.lit("object").alias("role")))).alias("x"))
    return roles.groupBy("x.node").agg(F.array_join(F.array_sort(F.collect_set("x.role")), ",").alias("roles"), F.count("*").alias("facts"))


def subgraph_keys(breakdown: DataFrame) -> DataFrame:
    """key, paths: how many distinct paths have a positive part of each key in (path, breakdown map)."""
    return breakdown.select("path", F.explode("breakdown").alias("key", "value")).where(F.col("value") > 0).groupBy("key").agg(F.count_distinct("path").alias("paths"))


def file_rank(df: DataFrame, key: str, signals: dict[str, float]) -> DataFrame:
    """The weighted mean of min-max normalised signals, scaled back to the range of the first: key, score."""
    peaks = df.agg(F.struct(*[x for c in signals for x in (F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))])).scalar()
    df = df.withColumn("_p", peaks)
    unit = lambda c: F.when(F.col(f"_p.hi_{c}") - F.col(f"_p.lo_{c}") <= 1e-12, F.when(F.col(f"_p.hi_{c}") > 0, 1.0).otherwise(0.0)).otherwise((F.col(c) - F.col(f"_p.lo_{c}")) / (F.col(f"_p.hi_{c}") - F.col(f"_p.lo_{c}")))
    total = sum(signals.values())
    mean = reduce(lambda a, b: a + b, [unit(c) * (w / total) for c, w in signals.items()])
    base = next(iter(signals))
    return df.select(key, F.round(F.col(f"_p.lo_{base}") + mean * (F.col(f"_p.hi_{base}") - F.col(f"_p.lo_{base}")), 6).alias("score"))


def locality(seed: Column, candidate: Column) -> Column:
    """How many leading directories two paths share."""
    a, b = F.split(seed, "/"), F.split(candidate, "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + F.when(s["go"] & x, 1).otherwise(0)).alias("n"), (s["go"] & x).alias("go")), lambda s: s["n"])
