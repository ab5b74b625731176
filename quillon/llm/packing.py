"""Items into containers of fixed capacity with little unused space.

Sizes are whole numbers up to the capacity, so an instance is a table of how many items there are of each size: at most
``capacity`` numbers, whatever the data's size. On it the driver finds the patterns of containers and how often each is
used; the items are then placed by their number among those of their size, in parallel.

``reduce_dominated`` fixes sets by Martello and Toth's dominance: a set of the largest item with others may be fixed for good
if in any solution the item's companions could be exchanged for those of the set without needing more containers. The
rest is filled best fit first, largest items first; equal items and equal containers are handled in one step.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import materialise

CAPACITY = 2048


@dataclass
class Pattern:
    """``repeat`` containers of the same content: (size, how many) in order of place."""

    repeat: int
    content: list[tuple[int, int]] = field(default_factory=list)

    @property
    def used(self) -> int:
        return sum(s * m for s, m in self.content)


def _smallest(sizes: list[int], count: dict[int, int], without: int, k: int) -> list[int]:
    """The ``k`` smallest items besides one of size ``without``."""
    out: list[int] = []
    for s in sizes:
        n = count[s] - (s == without)
        out += [s] * min(n, k - len(out))
        if len(out) == k:
            break
    return out


def _best_pair(sizes: list[int], count: dict[int, int], without: int, room: int) -> int:
    """The largest sum of two items that fits in ``room``, besides one of size ``without``; 0 if none does."""
    best, lo, hi = 0, 0, len(sizes) - 1
    left = lambda s: count[s] - (s == without)
    while lo <= hi:
        a, b = sizes[lo], sizes[hi]
        if a + b > room or left(b) < 1:
            hi -= 1
        elif left(a) < 1 or (lo == hi and left(a) < 2):
            lo += 1
        else:
            best = max(best, a + b)
            lo += 1
    return best


def reduce_dominated(count: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Containers that dominance fixes, and the counts left. For the item of size s, largest first, with ``room``
    left beside it and k the largest item that fits there, {s} is fixed if nothing fits, {s, k} if it is full, if no two
    items fit beside s, or if no three do and no two of them are larger together than k."""
    count = {s: n for s, n in count.items() if n > 0}
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for s in sorted(count, reverse=True):
            while count.get(s):
                sizes = sorted(x for x in count if count[x])
                room = capacity - s
                at = bisect.bisect_right(sizes, room) - 1
                while at >= 0 and count[sizes[at]] - (sizes[at] == s) < 1:
                    at -= 1
                if at < 0:
                    fixed.append(Pattern(count.pop(s), [(s, 1)]))
                    again = True
                    break
                k = sizes[at]
                if k != room:
                    low = _smallest(sizes, count, s, 3)
                    two = len(low) > 1 and low[0] + low[1] <= room
                    three = len(low) > 2 and sum(low) <= room
                    if two and (three or _best_pair(sizes, count, s, room) > k):
                        break
                n = count[s] // 2 if k == s else min(count[s], count[k])
                if k != room and k != s:
                    # the verdict may change when one of the small items is used up
                    n = max(1, min(n, count[k] - 1)) if count[k] > 1 else 1
                fixed.append(Pattern(n, [(s, 2)] if k == s else [(s, 1), (k, 1)]))
                for x, m in ((s, n), (k, n)):
                    count[x] -= m
                    if not count[x]:
                        del count[x]
                again = True
    return fixed, count


def best_fit(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit with decreasing sizes: every item goes to the fullest container that has room for it."""
    by: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(p: Pattern, room: int) -> None:
        if room not in by:
            by[room] = []
            bisect.insort(rooms, room)
        by[room].append(p)

    for s in sorted(count, reverse=True):
        left = count[s]
        while left:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                each = capacity // s
                whole, rest = divmod(left, each)
                if whole:
                    put(Pattern(whole, [(s, each)]), capacity - each * s)
                if rest:
                    put(Pattern(1, [(s, rest)]), capacity - rest * s)
                break
            room = rooms[at]
            p = by[room].pop()
            if not by[room]:
                del by[room]
                rooms.pop(at)
            each = room // s
            whole = min(p.repeat, left // each)
            if whole:
                put(Pattern(whole, [*p.content, (s, each)]), room - each * s)
                left -= whole * each
            others = p.repeat - whole
            if others and left and left < each:
                put(Pattern(1, [*p.content, (s, left)]), room - left * s)
                others, left = others - 1, 0
            if others:
                put(Pattern(others, p.content), room)
    return [p for group in by.values() for p in group]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold exactly the items of ``count`` (size to number, sizes from 1 to ``capacity``)."""
    if any(s < 1 or s > capacity for s in count):
        raise ValueError("sizes must lie between 1 and the capacity")
    fixed, rest = reduce_dominated(count, capacity)
    return sorted([*fixed, *best_fit(rest, capacity)], key=lambda p: [(-s, -m) for s, m in p.content])


def segments(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each size rows (first item, items in each container, first container, place, offset): where the items of that
    size go by their number."""
    out: dict[int, list] = {}
    cursor: dict[int, int] = {}
    base = 0
    for p in patterns:
        place = offset = 0
        for s, m in p.content:
            start = cursor.get(s, 0)
            out.setdefault(s, []).append((start, m, base, place, offset))
            cursor[s] = start + m * p.repeat
            place, offset = place + m, offset + m * s
        base += p.repeat
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def _place(table: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = batch.column("size").to_numpy(), batch.column("number").to_numpy()
            out = np.zeros((len(size), 3), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                s = int(size[at[0]])
                rows = table[s]
                first, each, base, place, offset = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1].T
                turn, inner = np.divmod(number[at] - first, each)
                out[at] = np.stack([base + turn, place + inner, offset + inner * s], 1)
            columns = [batch.column(c) for c in ("doc_id", "piece", "piece_start", "size")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(out[:, i]) for i in range(3))], ["doc_id", "piece", "piece_start", "n_tokens", "container", "place", "container_start"])

    return run


def pieces(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, piece_start, size: items longer than the capacity are cut into full pieces and a rest, others are one
    piece; items of size 0 or NULL are one piece of size 0."""
    n = F.coalesce("n_tokens", F.lit(0))
    last = F.greatest(F.lit(0), F.floor((n - 1) / capacity)).cast("bigint")
    out = df.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * F.lit(capacity)
    return out.select("doc_id", "piece", start.alias("piece_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - start).alias("size"))


def pack(df: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 100_000) -> DataFrame:
    """Places of all items of (doc_id, n_tokens): doc_id, piece, piece_start, n_tokens, container, place, container_start.

    Containers are numbered from 0, places and starts within a container as well. Pieces without tokens take no place and
    have NULL there. Rows that repeat are items of their own. An empty input gives no rows."""
    items = materialise(pieces(df, capacity))
    full = items.where(F.col("size") > 0)
    total = full.count()
    # items of a size are numbered in buckets, so that no size, however frequent, is gathered
    buckets = int(min(4096, max(4, -(-total // rows_per_bucket))))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    full = full.withColumn("bucket", bucket)
    counts = full.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    of_size = counts.groupBy("size").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    table = segments(plan({r["size"]: r["n"] for r in of_size}, capacity))
    before = W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = F.row_number().over(W.partitionBy("size", "bucket").orderBy("doc_id", "piece")) - 1
    numbered = full.withColumn("inner", inner).join(offsets, ["size", "bucket"]).withColumn("number", F.col("before") + F.col("inner"))
    schema = "doc_id bigint, piece bigint, piece_start bigint, n_tokens bigint, container bigint, place bigint, container_start bigint"
    placed = numbered.select("doc_id", "piece", "piece_start", "size", "number").mapInArrow(_place(table), schema)
    none = F.lit(None).cast("bigint")
    empty = items.where(F.col("size") <= 0).select("doc_id", "piece", "piece_start", F.col("size").alias("n_tokens"), none.alias("container"), none.alias("place"), none.alias("container_start"))
    return placed.unionByName(empty)
