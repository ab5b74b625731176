"""Most similar vectors by hierarchical navigable small-world graphs, one for each shard.

``Graph`` holds the layers as flat neighbour arrays (node times slots, int32) and works on many points at once: inserts go
in batches whose points search the graph so far together, step by step, by array operations.

``nearest`` spreads the vectors over shards by their most similar pivots, those near a border to several, builds a graph for each shard and merges the shards' answers. Exact copies are searched for once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import materialise

#: Vectors in a shard, in the mean; a shard of more than ``SHARD_LIMIT`` is cut into several that are all searched.
SHARD = 2048
SHARD_LIMIT = 8 * SHARD
#: Pivots in all: their vectors go to every task, so this bounds what is broadcast.
PIVOTS = 4096
#: Vectors of the sample to which the pivots are fitted, in all, and rounds of fitting.
SAMPLE, ROUNDS = 65_536, 8
#: Levels of pivots below the first, vectors of a cell's sample to which its pivots are fitted, and rows of a cell in one task.
DEPTH, CELL_SAMPLE, CELL_ROWS = 2, 16_384, 200_000


class Graph:
    """A small-world graph over unit vectors ``x``; similarity is the inner product."""

    def __init__(self, x: np.ndarray, slots: int = 12, ef: int = 32, batch: int = 256, seed: int = 7):
        self.x = np.ascontiguousarray(x, np.float32)
        self.n, self.ef, self.batch = len(x), ef, batch
        self.keep = slots
        rng = np.random.default_rng(seed)
        levels = np.minimum(np.floor(-np.log(1 - rng.random(self.n)) / np.log(slots)).astype(int), 6)
        self.order = np.argsort(-levels, kind="stable")
        self.level = levels
        top = int(levels.max(initial=0))
        # upper layers are numbered by insertion order, in which the nodes of a level form a prefix
        self.rank = np.empty(self.n, np.int64)
        self.rank[self.order] = np.arange(self.n)
        self.size = [int((levels >= k).sum()) for k in range(top + 1)]
        self.adj = [np.full((m, 2 * slots), -1, np.int32) for m in self.size]
        self.used = [np.zeros(m, np.int32) for m in self.size]
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.y = self.x[self.order]  # all below works on insertion numbers
        self._build()

    def _search(self, q: np.ndarray, entry: np.ndarray, layer: int, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The best ``ef`` nodes that a best-first search from ``entry`` (queries x some) finds: ids, similarities,
        padded by -1 and -2."""
        adj, y = self.adj[layer], self.y
        b, slots = len(q), adj.shape[1]
        seen = np.zeros((b, len(adj)), np.int32)
        ids = np.full((b, ef), -1, np.int32)
        sims = np.full((b, ef), -2, np.float32)
        k = min(entry.shape[1], ef)
        ids[:, :k] = entry[:, :k]
        sims[:, :k] = np.einsum("bkd,bd->bk", y[ids[:, :k]], q)
        np.put_along_axis(seen, ids[:, :k].astype(np.int64), 1, 1)
        done = ids < 0
        live = np.arange(b)
        stamp = 2
        while len(live):
            width_now = min(width, ef)
            score = np.where(done[live], -3, sims[live])
            if width_now < ef:
                pick = np.argpartition(-score, width_now - 1, axis=1)[:, :width_now]
            else:
                pick = np.broadcast_to(np.arange(ef), score.shape)
            ok = np.take_along_axis(score, pick, 1) > -2
            some = ok.any(1)
            live, pick, ok = live[some], pick[some], ok[some]
            if not len(live):
                break
            done[live[:, None], pick] = True
            from_ = np.where(ok, ids[live[:, None], pick], 0)
            near = np.where(ok[:, :, None], adj[from_], -1).reshape(len(live), -1)
            row, col = np.nonzero(near >= 0)
            node = near[row, col]
            at = live[row]
            fresh = seen[at, node] == 0
            row, node, at = row[fresh], node[fresh], at[fresh]
            # a node reached twice in one step is kept once: the last stamp written wins
            mark = np.arange(stamp, stamp + len(node), dtype=np.int32)
            seen[at, node] = mark
            once = seen[at, node] == mark
            stamp += len(mark)
            row, node, at = row[once], node[once], at[once]
            if not len(node):
                continue
            sim = np.einsum("kd,kd->k", y[node], q[at])
            # only what beats the present worst is merged
            better = sim > sims[at].min(1) if ef > 1 else sim > sims[at, 0]
            row, node, sim = row[better], node[better], sim[better]
            if not len(node):
                continue
            count = np.bincount(row, minlength=len(live))
            most = int(count.max())
            slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            new_ids = np.full((len(live), most), -1, np.int32)
            new_sims = np.full((len(live), most), -2, np.float32)
            new_ids[row, slot], new_sims[row, slot] = node, sim
            all_sims = np.concatenate([sims[live], new_sims], 1)
            best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            sims[live] = np.take_along_axis(all_sims, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], new_ids], 1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], new_ids < 0], 1), best, 1)
        return ids, sims

    def _choose(self, ids: np.ndarray, sims: np.ndarray, count: int) -> np.ndarray:
        """Of each row's candidates (best first) those nearer to the row's point than to any chosen before: a mask."""
        b, c = ids.shape
        vectors = self.y[np.maximum(ids, 0)]
        gram = vectors @ vectors.transpose(0, 2, 1)
        chosen = np.zeros((b, c), bool)
        taken = np.zeros(b, np.int64)
        for j in range(c):
            blocked = ((gram[:, j, :] > sims[:, j, None]) & chosen).any(1)
            ok = (ids[:, j] >= 0) & ~blocked & (taken < count)
            chosen[:, j] = ok
            taken += ok
        return chosen

    def _link(self, layer: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Connect ``new`` both ways to the chosen ones of their candidates; full lists are thinned."""
        adj, used = self.adj[layer], self.used[layer]
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        chosen = self._choose(ids, sims, self.keep)
        row, col = np.nonzero(chosen)
        src = np.concatenate([new[row], ids[row, col]])
        dst = np.concatenate([ids[row, col], new[row]])
        key = np.unique(src.astype(np.int64) * self.n + dst)
        src, dst = key // self.n, (key % self.n).astype(np.int32)
        count = np.bincount(src, minlength=len(adj))
        full = np.flatnonzero((used + count > adj.shape[1]) & (count > 0))
        if len(full):
            self._thin(layer, full, src, dst)
            rest = ~np.isin(src, full)
            src, dst = src[rest], dst[rest]
            count[full] = 0
        slot = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count) + used[src]
        adj[src, slot] = dst
        used += count.astype(np.int32)

    def _thin(self, layer: int, nodes: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        adj, used = self.adj[layer], self.used[layer]
        part = np.isin(src, nodes)
        src, dst = np.searchsorted(nodes, src[part]), dst[part]
        count = np.bincount(src, minlength=len(nodes))
        slot = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
        extra = np.full((len(nodes), int(count.max())), -1, np.int32)
        extra[src, slot] = dst
        ids = np.concatenate([adj[nodes], extra], 1)
        sims = np.einsum("bkd,bd->bk", self.y[np.maximum(ids, 0)], self.y[nodes])
        sims[ids < 0] = -2
        best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * self.keep + 8]
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        chosen = self._choose(ids, sims, self.keep)
        # the chosen first, the slots behind them free
        front = np.argsort(~chosen, axis=1, kind="stable")[:, : adj.shape[1]]
        kept = np.take_along_axis(np.where(chosen, ids, -1), front, 1)
        adj[nodes] = -1
        adj[nodes, : kept.shape[1]] = kept
        used[nodes] = chosen.sum(1)

    def _build(self) -> None:
        start = 1
        while start < self.n:
            stop = min(self.n, start + max(1, min(self.batch, start)))
            new = np.arange(start, stop)
            q = self.y[start:stop]
            inner = q @ q.T
            entry = np.zeros((len(new), 1), np.int32)
            level = self.level[self.order[start:stop]]
            for layer in range(len(self.adj) - 1, -1, -1):
                here = level >= layer
                if start >= self.size[layer] and not here.any() and layer:
                    entry, _ = self._search(q, entry, layer, 4)
                    entry = np.where(entry < 0, entry.max(1, keepdims=True), entry)
                    continue
                ids, sims = self._search(q, entry, layer, self.ef)
                if here.any():
                    # the batch's own points are candidates as well
                    mine = np.where(here[None, :] & ~np.eye(len(new), dtype=bool), inner, -2)
                    k = min(len(new), 8)
                    near = np.argpartition(-mine, k - 1, axis=1)[:, :k]
                    near_sims = np.take_along_axis(mine, near, 1)
                    near_ids = np.where(near_sims > -2, new[near], -1).astype(np.int32)
                    all_ids, all_sims = np.concatenate([ids, near_ids], 1), np.concatenate([sims, near_sims], 1).astype(np.float32)
                    self._link(layer, new[here], all_ids[here], all_sims[here])
                    if layer == 0:
                        row, col = np.nonzero(all_ids >= 0)
                        self.pairs.append((new[row], all_ids[row, col], all_sims[row, col]))
                entry = np.take_along_axis(ids, np.argsort(-sims, axis=1)[:, :4], 1)
                entry = np.where(entry < 0, entry.max(1, keepdims=True), entry)
            start = stop

    def search(self, q: np.ndarray, k: int, ef: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors ``q`` the ``k`` most similar nodes found (numbers of ``x``, -1 where there are fewer) and
        their similarities, best first."""
        q = np.ascontiguousarray(q, np.float32)
        if not self.n:
            return np.full((len(q), k), -1), np.full((len(q), k), -2, np.float32)
        out_ids, out_sims = [], []
        for at in range(0, len(q), self.batch):
            part = q[at : at + self.batch]
            entry = np.zeros((len(part), 1), np.int32)
            for layer in range(len(self.adj) - 1, -1, -1):
                ids, sims = self._search(part, entry, layer, max(k, ef or self.ef) if layer == 0 else 4)
                entry = np.where(ids < 0, ids.max(1, keepdims=True), ids)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            out_ids.append(np.where(ids >= 0, self.order[ids], -1))
            out_sims.append(sims)
        return np.concatenate(out_ids), np.concatenate(out_sims)

    def neighbours(self, k: int, least: float = -2.0, wide: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every node the ``k`` best of the nodes that it met, or that met it, while the graph was built, and of the
        ``wide`` best of each of its own ``wide`` best: node, other, similarity, ordered by node and similarity. Nodes whose
        best is below ``least`` aren't looked at again."""
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        a, b, s = (np.concatenate(x) for x in zip(*self.pairs))
        src, dst, sim = np.concatenate([a, b]), np.concatenate([b, a]).astype(np.int64), np.concatenate([s, s])
        _, once = np.unique(src.astype(np.int64) * self.n + dst, return_index=True)
        src, dst, sim = src[once], dst[once], sim[once]
        order = np.lexsort((dst, -sim, src))
        src, dst, sim = src[order], dst[order], sim[order]
        first = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
        place = np.arange(len(src)) - np.repeat(first, np.diff(np.append(first, len(src))))
        wide = max(wide, k)
        ok = place < wide
        near = np.full((self.n, wide), -1, np.int64)
        near[src[ok], place[ok]] = dst[ok]
        best = np.full(self.n, -2, np.float32)
        best[src[first]] = sim[first]
        out = []
        nodes = np.flatnonzero(best >= least)
        for at in range(0, len(nodes), self.batch):
            rows = nodes[at : at + self.batch]
            own = near[rows]
            more = np.where(own[:, :, None] >= 0, near[own], -1).reshape(len(rows), -1)
            cand = np.sort(np.concatenate([own, more], 1), axis=1)
            bad = (cand < 0) | (cand == rows[:, None])
            bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
            sims = np.einsum("bkd,bd->bk", self.y[cand], self.y[rows])
            sims[bad] = -2
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            sims, cand = np.take_along_axis(sims, top, 1), np.take_along_axis(cand, top, 1)
            row, col = np.nonzero(sims > -2)
            out.append((rows[row], cand[row, col], sims[row, col]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        src, dst, sim = (np.concatenate(x) for x in zip(*out))
        return self.order[src], self.order[dst], sim


def read_vector(text: str | None, dimension: int | None) -> np.ndarray | None:
    """The unit vector of a JSON list of ``dimension`` finite numbers, not all zero; else None."""
    if not text or not dimension:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, list) or len(value) != dimension or not set(map(type, value)) <= {int, float}:
        return None
    try:
        x = np.array(value, np.float64)
    except OverflowError:
        return None
    scale = np.abs(x).max()
    if not np.isfinite(scale) or not scale:
        return None
    x /= scale
    return (x / np.sqrt(x @ x)).astype(np.float32)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [read_vector(t, d) for t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        unit = pa.array([None if r is None else r.tobytes() for r in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], unit], [*batch.schema.names[1:], "unit"])


KEY = ["provider", "model", "dimension", "path"]
GROUP = ["provider", "model", "dimension"]


def usable_vectors(df: DataFrame) -> DataFrame:
    """vec_id, provider, model, dimension, unit (float32 bytes): of each natural key the row last written (ties: the
    greatest vec_id), if its vector can be used and it has a vec_id. NULL parts of a key are values like others."""
    read = df.select("vector_json", "dimension", "provider", "model", "path", "vec_id", "written_at").mapInArrow(
        _read, "dimension int, provider string, model string, path string, vec_id bigint, written_at timestamp, unit binary"
    )
    last = read.groupBy(*KEY).agg(F.max(F.struct("written_at", "vec_id", "unit")).alias("last"))
    return last.select("last.vec_id", *GROUP, "last.unit").where(F.col("unit").isNotNull() & F.col("vec_id").isNotNull())


def _as_matrix(column: pa.Array) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(data.to_pylist()), np.float32).reshape(len(data), -1)


def fit(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` unit vectors in the middle of the sample's clusters, by Lloyd's rounds from its first ``k`` vectors."""
    middle = sample[:k].copy()
    for _ in range(rounds):
        label = np.concatenate([(sample[i : i + 4096] @ middle.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(middle)
        np.add.at(sums, label, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), middle).astype(np.float32)
    return middle


def pivots(rows: DataFrame, shard: int = SHARD, limit: int | None = None) -> dict[str, np.ndarray]:
    """Pivots of each space larger than a shard, one for each ``shard`` places, no more than ``limit`` (``PIVOTS``) in all, shared out in
    proportion. They are fitted to a fixed random sample (by hash) of 32 vectors for each, at most ``SAMPLE`` in all: that is
    all that reaches the driver. Every vector is indexed, whether in the sample or not."""
    limit = limit or PIVOTS
    sizes = {r.space: r.n for r in rows.groupBy("space").agg(F.count("*").alias("n")).where(F.col("n") > shard).orderBy(F.desc("n")).limit(limit // 2).collect()}
    want = {s: -(-n * 3 // (2 * shard)) for s, n in sizes.items()}
    scale = min(1.0, limit / max(1, sum(want.values())))
    want = {s: max(2, int(k * scale)) for s, k in want.items()}
    if not want:
        return {}
    each = min(32.0, SAMPLE / sum(want.values()))
    table = rows.sparkSession.createDataFrame([(s, (each * k + 20) / sizes[s]) for s, k in want.items()], "space string, part double")
    share = (F.xxhash64("unit", F.lit(3)).cast("double") / F.lit(2.0**64)) + 0.5
    some = rows.join(F.broadcast(table), "space").where(share < F.col("part")).select("space", "unit").distinct()
    found: dict[str, list] = {}
    for r in some.orderBy("space", F.xxhash64("unit", F.lit(3))).collect():
        found.setdefault(r.space, []).append(np.frombuffer(r.unit, np.float32))
    return {s: fit(np.stack(v), min(want[s], len(v))) for s, v in found.items()}


def _assign(pivot: dict[str, np.ndarray], margin: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            take, shard = [], []
            by: dict[str, list[int]] = {}
            for i, s in enumerate(batch.column(0).to_pylist()):
                by.setdefault(s, []).append(i)
            for s, at in by.items():
                p = pivot.get(s)
                if p is None:
                    take.append(np.array(at))
                    shard.append(np.zeros(len(at), np.int32))
                    continue
                sims = _as_matrix(batch.column(2).take(pa.array(at))) @ p.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, :most]
                sims = np.take_along_axis(sims, best, 1)
                row, col = np.nonzero(sims >= sims[:, :1] - margin)
                take.append(np.array(at)[row])
                shard.append(best[row, col].astype(np.int32))
            out = batch.take(pa.array(np.concatenate(take)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(shard), pa.int32())], [*batch.schema.names, "shard"])

    return run


_PLACED = "space string, node bigint, unit binary, shard int"


def _split_cells(shard: int, margin: float, most: int):
    """Rows (cell, n, probe, node, unit) in order of the cell, the sample (probe 1) first: each cell's own pivots are fitted to its
    sample, and its rows go to their shards below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sample, place = None, [], None
        for batch in batches:
            names, sizes = batch.column("cell").to_pylist(), batch.column("n").to_pylist()
            probe = batch.column("probe").to_numpy()
            start = 0
            while start < len(names):
                stop = start
                while stop < len(names) and names[stop] == names[start] and probe[stop] == probe[start]:
                    stop += 1
                if names[start] != name:
                    name, sample, place = names[start], [], None
                part = batch.slice(start, stop - start)
                if probe[start]:
                    sample.append(_as_matrix(part.column("unit")))
                else:
                    if place is None:
                        found = np.concatenate(sample) if sample else np.zeros((0, 1), np.float32)
                        k = min(len(found), max(2, -(-sizes[start] * 3 // (2 * shard))))
                        place = _assign({name: fit(found, k)} if k > 1 else {}, margin, most)
                    rows = pa.RecordBatch.from_arrays([part.column("cell"), part.column("node"), part.column("unit")], ["space", "node", "unit"])
                    yield from place(iter([rows]))
                start = stop

    return run


def split_large(placed: DataFrame, shard: int, margin: float, most: int) -> DataFrame:
    """Shards over the limit split by pivots of their own, level by level, so that a shard's size doesn't grow with the number of
    vectors. No level's pivots leave the tasks that need them. A cell is spread over as many tasks as its rows need, each of which
    fits the same pivots to the same sample (by hash, at most ``CELL_SAMPLE`` vectors)."""
    for _ in range(DEPTH):
        counts = placed.groupBy("space", "shard").agg(F.count("*").alias("n")).where(F.col("n") > max(SHARD_LIMIT, 2 * shard))
        if not counts.take(1):
            break
        placed, counts = materialise(placed), materialise(counts)
        large = placed.join(counts, ["space", "shard"]).select(F.to_json(F.struct("space", "shard")).alias("cell"), "n", "node", "unit")
        tasks = F.ceil(F.col("n") / CELL_ROWS).cast("int")
        hashed = F.xxhash64("unit", F.lit(5)).cast("double") / F.lit(2.0**64) + 0.5
        own = large.select("cell", F.pmod(F.xxhash64("node"), tasks).cast("int").alias("task"), "n", F.lit(0).alias("probe"), "node", "unit")
        some = large.where(hashed < F.least(F.lit(48.0 / shard), F.lit(float(CELL_SAMPLE)) / F.col("n")) + F.lit(64.0) / F.col("n"))
        probes = some.select("cell", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), "n", F.lit(1).alias("probe"), "node", "unit")
        ordered = own.unionByName(probes).repartition("cell", "task").sortWithinPartitions("cell", "task", F.desc("probe"), "node")
        split = ordered.select("cell", "n", "probe", "node", "unit").mapInArrow(_split_cells(shard, margin, most), _PLACED)
        # a vector near a border was in several cells and may now be in several of their shards
        placed = placed.join(counts, ["space", "shard"], "left_anti").unionByName(split)
    return placed


_FOUND = "a bigint, b bigint, similarity float"


def _graphs(k: int, ef: int, least: float, search: bool = False):
    def answer(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("node").to_numpy()
        x = _as_matrix(table.column("unit"))
        inside = table.column("inside").to_numpy(zero_copy_only=False).astype(bool)
        at = np.flatnonzero(inside)
        graph = Graph(x[at], ef=ef)
        a, b, s = graph.neighbours(k, least)
        a, b = ids[at[a]], ids[at[b]]
        if search:
            found, sims = graph.search(x[at], k + 1)
            row, col = np.nonzero(found >= 0)
            a, b = np.concatenate([a, ids[at[row]]]), np.concatenate([b, ids[at[found[row, col]]]])
            s = np.concatenate([s, sims[row, col]])
        guests = np.flatnonzero(~inside)
        if len(guests):
            found, sims = graph.search(x[guests], k)
            row, col = np.nonzero(found >= 0)
            a, b = np.concatenate([a, ids[guests[row]]]), np.concatenate([b, ids[at[found[row, col]]]])
            s = np.concatenate([s, sims[row, col]])
        ok = (s >= least) & (a != b)
        return pa.RecordBatch.from_arrays([pa.array(a[ok], pa.int64()), pa.array(b[ok], pa.int64()), pa.array(s[ok], pa.float32())], ["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in order of the shard; one shard is held at a time
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            names = batch.column("home").to_pylist()
            start = 0
            while start < len(names):
                stop = start
                while stop < len(names) and names[stop] == names[start]:
                    stop += 1
                if held and names[start] != name:
                    yield answer(pa.Table.from_batches(held))
                    held = []
                name = names[start]
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield answer(pa.Table.from_batches(held))

    return run


def nearest(df: DataFrame, space: list[str], k: int = 3, least: float = -1.0, ef: int = 24, margin: float = 0.08, most: int = 4, shard: int = SHARD, search: bool = False) -> DataFrame:
    """For each row of (vec_id, unit, ``space`` columns) the ``k`` most similar other rows of the same space that the graphs
    find: vec_id_a, vec_id_b, similarity (rows below ``least`` left out). Ties go to the smaller vec_id.

    ``ef`` is the breadth of the graph search; a vector goes to the shard of its most similar pivot and to those whose
    pivots are less similar by at most ``margin``, ``most`` in all; ``shard`` is about their mean size. More of each means
    better recall, and so does ``search``: every vector is then searched for in its shards' finished graphs besides. Vectors that are exact copies are one node; the copies of a node answer for
    each other first, so a node of m copies gives at most ``k`` rows for each copy and no pairs within it beyond that.

    Cases: a space of one vector gives no rows; NULL in a space column is a value; an empty input gives no rows."""
    rows = materialise(df.select("vec_id", F.to_json(F.struct(*space), {"ignoreNullFields": "false"}).alias("space"), "unit"))
    copies = rows.groupBy("space", F.md5("unit").alias("digest")).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    members = materialise(rows.select("space", F.md5("unit").alias("digest"), "vec_id").join(copies, ["space", "digest"]).select("node", "vec_id"))
    nodes = rows.join(members.where(F.col("node") != F.col("vec_id")).select("vec_id"), "vec_id", "left_anti").withColumnRenamed("vec_id", "node")
    pivot = pivots(nodes, shard)
    placed = nodes.select("space", "node", "unit").mapInArrow(_assign(pivot, margin, most), _PLACED)
    placed = split_large(placed, shard, margin, most)
    # shards that are over the limit even so, whose vectors pivots don't tell apart, are cut: each piece has its own graph, which the rows of the other pieces search as well
    counts = placed.groupBy("space", "shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_LIMIT)
    pieces = counts.select("space", "shard", F.ceil(F.col("n") / SHARD_LIMIT * 2).cast("int").alias("pieces"))
    home = F.coalesce("pieces", F.lit(1))
    own = F.pmod(F.xxhash64("node"), home).cast("int")
    spread = placed.join(pieces, ["space", "shard"], "left").withColumn("own", own).withColumn("piece", F.explode(F.sequence(F.lit(0), home - 1)))
    tasks = spread.select(F.xxhash64("space", "shard", "piece").alias("home"), "node", "unit", (F.col("piece") == F.col("own")).alias("inside"))
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(len(p) for p in pivot.values()))
    pairs = tasks.repartition(width, "home").sortWithinPartitions("home", "node").mapInArrow(_graphs(k, ef, least, search), _FOUND)
    # shards' answers merged: what another shard saw from the other side counts for both
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "similarity")
    best = materialise(both.groupBy("p.a", "p.b").agg(F.max("similarity").alias("similarity")))
    best = best.withColumn("at", F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("at") <= k).drop("at")
    return _with_copies(members, best, k)


def _with_copies(members: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Answers of nodes turned into answers of rows. ``members`` has node and vec_id of all vectors that have exact
    copies. Of a node's copies the ``k + 1`` smallest ids can be answers; they are found without gathering the
    copies: the smallest of each of many parts first."""
    part = members.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    lead = part.withColumn("at", F.row_number().over(W.partitionBy("node", "part").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    lead = lead.withColumn("at", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    heads = lead.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("heads"))
    others = best.join(heads.withColumnRenamed("node", "b"), "b", "left").select("a", "similarity", F.explode(F.slice(F.coalesce("heads", F.array("b")), 1, k)).alias("id"))
    listed = others.groupBy("a").agg(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "id")).alias("others"))
    # every copy answers as its node does, after its fellow copies; nodes without copies answer for themselves
    alone = listed.join(heads, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("vec_id"), F.lit(None).cast("array<bigint>").alias("heads"), "others")
    copied = members.join(heads, "node").join(listed, F.col("node") == F.col("a"), "left").select("vec_id", "heads", "others")
    full = alone.unionByName(copied)
    fellows = F.transform(F.filter(F.coalesce("heads", F.array()), lambda h: h != F.col("vec_id")), lambda h: F.struct(F.lit(-1.0).cast("float").alias("d"), h.alias("id")))
    ranked = F.slice(F.sort_array(F.concat(fellows, F.coalesce("others", F.array().cast("array<struct<d:float,id:bigint>>")))), 1, k)
    return full.select(F.col("vec_id").alias("vec_id_a"), F.explode(ranked).alias("r")).select("vec_id_a", F.col("r.id").alias("vec_id_b"), (-F.col("r.d")).alias("similarity"))


def unordered_pairs(answers: DataFrame) -> DataFrame:
    """vec_id_a < vec_id_b, each pair once, where one of the two is among the answers of the other."""
    low, high = F.least("vec_id_a", "vec_id_b"), F.greatest("vec_id_a", "vec_id_b")
    return answers.select(low.alias("vec_id_a"), high.alias("vec_id_b")).distinct()
