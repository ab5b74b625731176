"""Percentiles of very large columns from mergeable rank-interval summaries.

A summary of n values is a list of tuples (value, g, delta) in order of value: the smallest rank of a tuple's value is the
sum of the ``g`` up to it, the largest that sum plus ``delta`` (Greenwald and Khanna's form). Summaries are made inside
the partitions, compressed to the permitted uncertainty, and merged: a merged ``delta`` grows by what the other summaries
leave open, so ``err``, the greatest ``g + delta`` of a summary, is its rank error as it really accumulated, and bounds
follow from the tuples themselves whatever was merged, days or partitions.

The permitted error ``eps * n`` is shared out over the levels of merging. A summary made of values has level 0, one made of
summaries a level above the highest of them. At level l stretches of ``eps * n / 2 ** (l + 2)`` ranks are drawn together,
which adds at most twice that to the error; a merge of any number of summaries in one pass adds nothing beyond the sum of
their errors. So ``err <= eps * n`` however many summaries are merged in however many levels. All summaries of a group are
merged in one pass, or, beyond ``HELD`` tuples, in as few levels as hold them.

Runs of equal values are two tuples, the first value and the rest, so that ties cause no error. Groups of fewer than
``4 / eps`` values are kept whole and are exact. A summary has at most about ``8 * 2 ** level / eps`` tuples.

Merging and compressing handle all groups of a batch at once with array operations; no group's values are gathered.

Cases: NULL and NaN values don't count; NULL keys are groups of their own; a group of one value has that value at all
percentiles; an empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise

SUMMARY = "n bigint, err bigint, level int, v array<double>, g array<bigint>, d array<bigint>"
#: Tuples of one group that are held before they are merged.
HELD = 4_000_000


def summarise(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Exact summaries of (group, value) pairs: group, value, g, delta, in order, runs of equal values as two tuples."""
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    last = np.append(new[1:], True)
    at = np.flatnonzero(new | last)
    return group[at], value[at], np.diff(np.append(-1, at)), np.zeros(len(at), np.int64)


def merge(group: np.ndarray, part: np.ndarray, value: np.ndarray, g: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge the summaries of each group; ``part`` numbers the summaries (unique over all groups); the tuples of each come in
    order. A tuple's delta gains, from each other summary of its group, ``g + delta - 1`` of that summary's
    next tuple."""
    # the next tuple of the own summary
    own = np.lexsort((value, part))
    nxt = np.zeros(len(value), np.int64)
    weight = g + delta - 1
    inner = part[own][1:] == part[own][:-1]
    nxt[own[:-1][inner]] = weight[own[1:][inner]]
    order = np.lexsort((part, value, group))
    group, value, g, delta, weight, nxt = (x[order] for x in (group, value, g, delta, weight, nxt))
    # sum over the group's summaries of the weight of their first tuple after this one: each tuple passed on
    # the way from the right puts its own weight in the place of its successor's
    step = weight - nxt
    right = np.cumsum(step[::-1])[::-1]
    after = np.append(right[1:], 0)
    last = np.append(group[1:] != group[:-1], True)
    ends = np.flatnonzero(last)
    base = after[ends][np.searchsorted(ends, np.arange(len(group)))]
    return group, value, g, delta + (after - base) - nxt


def compress(group: np.ndarray, value: np.ndarray, g: np.ndarray, delta: np.ndarray, eps: float | np.ndarray) -> tuple[np.ndarray, ...]:
    """Keep of each stretch of ``eps * n`` ranks (``eps``: of each group, in order) the last tuple, with the ranks of those
    before it; tuples of more ranks than that, and the first and last tuple of every group, stay as they are."""
    start = np.append(True, group[1:] != group[:-1])
    first = np.flatnonzero(start)
    which = np.cumsum(start) - 1
    total = np.cumsum(g)
    before = np.append(0, total)[first]
    n = np.append(before[1:], total[-1]) - before
    width = np.maximum(1, np.floor(eps * n)).astype(np.int64)[which]
    slot = (total - before[which] - 1) // width
    keep = np.append((slot[1:] != slot[:-1]) | start[1:], True)
    keep |= start | (g > width)
    at = np.flatnonzero(keep)
    ranks = total[at] - np.append(0, total[at][:-1])
    return group[at], value[at], ranks, delta[at]


def errors(group: np.ndarray, value: np.ndarray, g: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """The rank error at each tuple: what lies between it and a smaller value before it. Between equal values there is none,
    and none in a tuple of one rank."""
    same = np.append(False, (group[1:] == group[:-1]) & (value[1:] == value[:-1]))
    return np.where(same, 0, g + delta - 1)


def _pack(group: np.ndarray, value: np.ndarray, g: np.ndarray, delta: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """One row for each group: the group, and the columns of ``SUMMARY``."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    offsets = pa.array(np.append(first, len(group)), pa.int32())
    n = np.add.reduceat(g, first)
    err = np.maximum.reduceat(errors(group, value, g, delta), first)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((value, pa.float64()), (g, pa.int64()), (delta, pa.int64()))]
    return group[first], [pa.array(n, pa.int64()), pa.array(err, pa.int64()), pa.array(level, pa.int32()), *lists]


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct combination, and the first row of each."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        coded = c.dictionary_encode(null_encoding="encode")
        values, inner = np.unique(coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        code = code * len(values) + inner
        _, code = np.unique(code, return_inverse=True)
    _, first = np.unique(code, return_index=True)
    return code.astype(np.int64), first


_NAMES = ["n", "err", "level", "v", "g", "d"]


def _summaries_of(names: list[str], eps: float):
    held = 4_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(kept)
            keys = [table.column(i).combine_chunks() for i in range(len(names))]
            code, first = _codes(keys)
            tuples = compress(*summarise(code, table.column(len(names)).to_numpy()), eps / 4)
            group, columns = _pack(*tuples, np.zeros(len(first), np.int32))
            return pa.RecordBatch.from_arrays([*(k.take(pa.array(first[group])) for k in keys), *columns], [*names, *_NAMES])

        kept, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                rows += batch.num_rows
            if rows >= held:
                yield out(kept)
                kept, rows = [], 0
        if kept:
            yield out(kept)

    return run


def _merge_of(names: list[str], eps: float):
    """Merges the summaries of each group; rows come in order of the group."""

    def codes(table: pa.Table) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        keys = [table.column(i).combine_chunks() for i in range(len(names))]
        return (keys, *_codes(keys)) if keys else (keys, np.zeros(len(table), np.int64), np.zeros(1, np.int64))

    def out(table: pa.Table) -> pa.RecordBatch:
        keys, code, first = codes(table)
        lists = [table.column(c).combine_chunks() for c in ("v", "g", "d")]
        sizes = np.diff(lists[0].offsets.to_numpy())
        part = np.repeat(np.arange(len(code)), sizes)
        value, g, delta = (x.flatten().to_numpy() for x in lists)
        level = np.zeros(len(first), np.int64)
        np.maximum.at(level, code, table.column("level").to_numpy())
        # a summary that is alone in its group stays what it is
        several = np.bincount(code, minlength=len(first)) > 1
        level += several
        width = np.where(several, eps / 2.0 ** (level + 2), 0.0)
        group, columns = _pack(*compress(*merge(code[part], part, value, g, delta), width), level)
        return pa.RecordBatch.from_arrays([*(k.take(pa.array(first[group])) for k in keys), *columns], [*names, *_NAMES])

    def fold(table: pa.Table) -> pa.Table:
        """Of one group's summaries those of the lowest level as one of the next; if there is one of it, all."""
        level = table.column("level").to_numpy()
        low = level == level.min()
        low = low if low.sum() > 1 else np.ones(len(low), bool)
        folded = pa.Table.from_batches([out(table.filter(pa.array(low)))], table.schema)
        return pa.concat_tables([table.filter(pa.array(~low)), folded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        limit = HELD
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held.cast(table.schema), table])
            _, code, _ = codes(table)
            others = np.flatnonzero(code != code[-1])
            start = int(others[-1]) + 1 if len(others) else 0
            if start:
                yield out(table.slice(0, start))
            held = table.slice(start)
            limit = HELD if start else limit
            if len(held) > 1 and _tuples(held) > limit:
                # what is left may be large: the next fold waits until as much again has come, which keeps the levels few
                held = fold(held)
                limit = max(limit, 2 * _tuples(held))
        if held is not None:
            yield out(held)

    return run


def _tuples(table: pa.Table) -> int:
    return pc.sum(pc.list_value_length(table.column("v"))).as_py()


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names) + ", " + SUMMARY


def sketch(df: DataFrame, groups: list[str], value: str, eps: float = 0.002) -> DataFrame:
    """Summaries of ``value`` for each partition and group, of level 0; each has a rank error of at most ``eps / 2`` of its
    values."""
    rows = df.select(*groups, F.col(value).cast("double").alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    return rows.mapInArrow(_summaries_of(groups, eps), _schema(df, groups))


def merge_sketches(sketches: DataFrame, groups: list[str], eps: float = 0.002, fan_in: int = 64) -> DataFrame:
    """One summary for each group out of any number of summaries (of partitions, days, earlier merges). Up to ``fan_in``
    salted branches of a group are merged first, their results then once more; ``err`` is the accumulated error, at most
    ``eps * n``: a rank is known to within ``err``."""
    branch = F.pmod(F.xxhash64("v", "g", "n"), F.lit(fan_in)).cast("int")
    schema = _schema(sketches, groups)
    names = [*groups, *_NAMES]
    step = lambda df, by: df.repartition(*by).sortWithinPartitions(*by).select(*names).mapInArrow(_merge_of(groups, eps), schema)
    return step(step(sketches.withColumn("_branch", branch), [*groups, "_branch"]), groups)


def rank_of(q: float, n: Column | str = "n") -> Column:
    """The rank of the q-th percentile: the smallest r with r >= q * n / 100."""
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.lit(1), F.ceil((n * F.lit(q)) / F.lit(100)).cast("bigint"))


def bounds(sketches: DataFrame, percentiles: dict[str, float]) -> DataFrame:
    """Adds to each summary, for every named percentile, ``name_low`` and ``name_high``, between which the exact value
    lies, and ``name``, the summary's answer (the upper bound, a value that occurs)."""
    tuples = F.arrays_zip(F.col("v").alias("v"), F.col("g").alias("g"), F.col("d").alias("d"))
    start = F.struct(F.lit(0).cast("bigint").alias("r"), *[x for i in range(len(percentiles)) for x in (F.element_at("v", 1).alias(f"l{i}"), F.lit(None).cast("double").alias(f"h{i}"))])
    ranks = [rank_of(q) for q in percentiles.values()]

    def step(acc: Column, t: Column) -> Column:
        low = acc["r"] + t["g"]
        out = [low.alias("r")]
        for i, r in enumerate(ranks):
            out.append(F.when(low + t["d"] <= r, t["v"]).otherwise(acc[f"l{i}"]).alias(f"l{i}"))
            out.append(F.coalesce(acc[f"h{i}"], F.when(low >= r, t["v"])).alias(f"h{i}"))
        return F.struct(*out)

    df = sketches.withColumn("_b", F.aggregate(tuples, start, step))
    for i, name in enumerate(percentiles):
        df = df.withColumns({f"{name}_low": F.col(f"_b.l{i}"), f"{name}_high": F.col(f"_b.h{i}"), name: F.col(f"_b.h{i}")})
    return df.drop("_b")


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def last_finished(df: DataFrame) -> DataFrame:
    """Of the rows of one invocation_id the one last finished (ties by the other columns, greatest first); rows without
    an id stand for themselves. Re-recordings are combined inside the partitions first, so an id may repeat any number
    of times."""
    keep = ["repo_key", "profile_key", "stage_latency_json"]
    own = F.coalesce(F.concat(F.lit("i"), "invocation_id"), F.concat(F.lit("n"), F.md5(F.to_json(F.struct(*df.columns)))))
    last = df.groupBy(own.alias("_id")).agg(F.max(F.struct("finished_at", *keep)).alias("last"))
    return last.select("last.*")


def stage_values(df: DataFrame) -> DataFrame:
    """repo_key, profile_key ('' for NULL), stage_name, elapsed_ms of the valid stage times: numbers, also written as
    text, that aren't negative. Both layouts are read; rows without repo_key or stage name don't count."""
    text = F.col("stage_latency_json")
    listed = F.from_json(text, "array<struct<stage_name:string,elapsed_ms:string>>")
    keyed = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("stage_name"), e["value"].alias("elapsed_ms")))
    stages = F.when(text.rlike(r"^\s*\["), listed).when(text.rlike(r"^\s*\{"), keyed)
    rows = df.where(F.col("repo_key").isNotNull()).select("repo_key", F.coalesce("profile_key", F.lit("")).alias("profile_key"), F.explode(stages).alias("s"))
    ms = F.when(F.col("s.elapsed_ms").rlike(NUMBER), F.trim("s.elapsed_ms").try_cast("double"))
    out = rows.select("repo_key", "profile_key", F.col("s.stage_name").alias("stage_name"), ms.alias("elapsed_ms"))
    return out.where((F.col("elapsed_ms") >= 0) & F.col("stage_name").isNotNull() & (F.col("elapsed_ms") < float("inf")))


GROUPS = ["repo_key", "profile_key", "stage_name"]


def slow_tails(values: DataFrame, eps: float = 0.002, tail: float = 1000.0, middle: float = 200.0) -> DataFrame:
    """For each group whether its 95th percentile is at least ``tail`` and its median at most ``middle``, as far as the
    summaries' bounds tell: verdict 1 yes, 0 no, -1 open."""
    merged = bounds(merge_sketches(sketch(values, GROUPS, "elapsed_ms", eps), GROUPS, eps), {"p50": 50, "p95": 95})
    surely = (F.col("p95_low") >= tail) & (F.col("p50_high") <= middle)
    never = (F.col("p95_high") < tail) | (F.col("p50_low") > middle)
    return merged.select(*GROUPS, "n", F.when(surely, F.lit(1)).when(never, F.lit(0)).otherwise(F.lit(-1)).alias("verdict"))


def decide(verdict: DataFrame, values: DataFrame, tail: float = 1000.0, middle: float = 200.0) -> DataFrame:
    """The groups found by ``slow_tails``. Only if it leaves some open are the values read again, to settle those by counting
    the values on either side of the two limits."""
    verdict = materialise(verdict.where(F.col("verdict") != 0))
    found, open_groups = verdict.where(F.col("verdict") == 1).select(*GROUPS), verdict.where(F.col("verdict") == -1).select(*GROUPS)
    if not open_groups.take(1):
        return found
    counts = values.join(open_groups, GROUPS, "left_semi").groupBy(*GROUPS).agg(F.count("*").alias("n"), F.count_if(F.col("elapsed_ms") < tail).alias("under"), F.count_if(F.col("elapsed_ms") <= middle).alias("within"))
    return found.unionByName(counts.where((F.col("under") < rank_of(95)) & (F.col("within") >= rank_of(50))).select(*GROUPS))
