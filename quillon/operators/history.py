"""History of changing attributes: snapshots compared by Merkle trees, versions with their periods.

Keys are hashed to leaf buckets, about ``PER_LEAF`` rows in each however large the table; a leaf's digest is the XOR of its
rows' hashes and every inner node's digest is made of its children's. Comparing two snapshots starts at the top and descends
only where digests differ; rows are compared in changed leaves alone. ``Snapshot`` tables are sorted by leaf inside
directories of the tree's first level, so that the rows of unchanged branches aren't read from disk.

``statement_history`` takes daily snapshots of dated statements: the first is taken over whole, of each later one the log gains
what its comparison with the day before finds, and the versions are those of the first with the log laid over it.

Versions need no entity in one task: rows are put in order of entity and time over all partitions, runs are drawn together
within each, and one row from each end of each partition tells how runs go on in the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.functions.times import format_seconds, parse_micros
from quillon.session import materialise, shared_path

#: Rows of a leaf in the mean, and bits of a level of the tree.
PER_LEAF, LEVEL_BITS = 64, 4
DAY = 86_400 * 1_000_000
#: Changed leaves up to which a snapshot is read by their list, which the scan uses to skip; beyond it they are joined.
LISTED = 2_000


def levels_for(rows: int) -> tuple[int, ...]:
    """Bits of each level of a tree whose leaves have about ``PER_LEAF`` rows; at least one level, at most ten."""
    bits = math.ceil(math.log2(max(1, rows / PER_LEAF)))
    return (LEVEL_BITS,) * min(10, max(1, math.ceil(bits / LEVEL_BITS)))


def _leaf(keys: list[str], levels: tuple[int, ...]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - sum(levels)).cast("bigint")


def _digested(df: DataFrame, keys: list[str], levels: tuple[int, ...]) -> DataFrame:
    row = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return df.withColumns({"_leaf": _leaf(keys, levels), "_row": row})


def _leaf_digests(df: DataFrame) -> DataFrame:
    return df.groupBy("_leaf").agg(F.bit_xor(F.xxhash64("_row")).alias("digest"), F.count("*").alias("n"))


def descend(pairs: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """_leaf of the leaves whose digests differ: pairs (_leaf, old, new) with NULL for a side without rows. Every level keeps only
    the children of nodes that differ."""
    open_nodes = None
    for depth in range(1, len(levels) + 1):
        shift = sum(levels) - sum(levels[:depth])
        node, below = F.shiftright("_leaf", shift), pairs
        if open_nodes is not None:
            below = below.withColumn("node", F.shiftright("_leaf", shift + levels[depth - 1])).join(open_nodes, "node", "left_semi")
        # XOR ignores NULL, so a side without rows is told apart by its count
        nodes = below.groupBy(node.alias("node")).agg(F.bit_xor("old").alias("o"), F.bit_xor("new").alias("w"), F.count("old").alias("no"), F.count("new").alias("nw"))
        open_nodes = nodes.where(~(F.col("o").eqNullSafe(F.col("w")) & (F.col("no") == F.col("nw")))).select("node")
    return open_nodes.withColumnRenamed("node", "_leaf")


def _paired(before: DataFrame, after: DataFrame) -> DataFrame:
    side = lambda s: F.max(F.when(F.col("side") == s, F.xxhash64("_leaf", "digest", "n")))
    leaves = before.select("_leaf", "digest", "n", F.lit(0).alias("side")).unionByName(after.select("_leaf", "digest", "n", F.lit(1).alias("side")))
    return materialise(leaves.groupBy("_leaf").agg(side(0).alias("old"), side(1).alias("new")))


def changed_leaves(before: DataFrame, after: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """Leaf numbers that differ between two digested tables. The leaves' digests are written once; all levels are made of
    them."""
    return descend(_paired(_leaf_digests(before), _leaf_digests(after)), levels)


def merkle_changes(before: DataFrame, after: DataFrame, keys: list[str], levels: tuple[int, ...] | None = None) -> DataFrame:
    """Rows that only one of two tables of the same columns has, with ``change``: 'new' for those of ``after``, 'gone' for those of
    ``before`` whose key ``after`` doesn't have any more. Equal rows count once; NULLs are values like others; empty tables
    are fine."""
    columns = after.columns
    levels = levels or levels_for(after.count())
    old, new = _digested(before.select(columns), keys, levels), _digested(after, keys, levels)
    leaves = materialise(changed_leaves(old, new, levels))
    return _row_changes(old.join(leaves, "_leaf", "left_semi"), new.join(leaves, "_leaf", "left_semi"), keys, columns)


def _row_changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    fresh = new.join(old, ["_leaf", "_row"], "left_anti").dropDuplicates(["_leaf", "_row"]).withColumn("change", F.lit("new"))
    kept = new.select("_leaf", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    gone = old.alias("o").join(kept.alias("n"), (F.col("o._leaf") == F.col("n._leaf")) & same, "left_anti").dropDuplicates(["_leaf", "_row"]).withColumn("change", F.lit("gone"))
    return fresh.select(*columns, "change").unionByName(gone.select(*columns, "change"))


class Snapshot:
    """A snapshot written for comparison: rows in directories of the tree's first level, sorted by leaf, and the leaves' digests.
    Snapshots to be compared have the same ``levels``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], levels: tuple[int, ...]):
        self.keys, self.levels = keys, levels
        self.rows, self.digests = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/digests")

    @classmethod
    def write(cls, df: DataFrame, keys: list[str], levels: tuple[int, ...] | None = None, path: str | None = None) -> Snapshot:
        levels = levels or levels_for(df.count())
        path = path or shared_path(df.sparkSession, "snapshot")
        rows = _digested(df, keys, levels).withColumn("_branch", F.shiftright("_leaf", sum(levels) - levels[0]).cast("int"))
        rows.repartitionByRange("_leaf", F.xxhash64("_row")).sortWithinPartitions("_leaf").write.partitionBy("_branch").parquet(f"{path}/rows")
        _leaf_digests(df.sparkSession.read.parquet(f"{path}/rows")).write.parquet(f"{path}/digests")
        return cls(df.sparkSession, path, keys, levels)

    def at(self, leaves: DataFrame) -> DataFrame:
        """The rows of some leaves: their branches' directories alone are read, and of these, for up to ``LISTED`` leaves, the pages
        that hold them."""
        shift = sum(self.levels) - self.levels[0]
        branches = [r.b for r in leaves.select(F.shiftright("_leaf", shift).cast("int").alias("b")).distinct().collect()]  # at most 16
        rows = self.rows.where(F.col("_branch").isin(branches)) if branches else self.rows.where(F.lit(False))
        some = [r._leaf for r in leaves.select("_leaf").limit(LISTED + 1).collect()]
        return rows.where(F.col("_leaf").isin(some)) if len(some) <= LISTED else rows.join(leaves, "_leaf", "left_semi")

    def changes(self, after: Snapshot) -> DataFrame:
        """As ``merkle_changes``, reading changed leaves alone."""
        leaves = materialise(descend(_paired(self.digests, after.digests), self.levels))
        columns = [c for c in after.rows.columns if c not in ("_leaf", "_row", "_branch")]
        return _row_changes(self.at(leaves), after.at(leaves), self.keys, columns)


def snapshot_states(rows: DataFrame, keys: list[str], observed: str, moments: list[int]) -> DataFrame:
    """For each distinct ``keys`` the row last observed before each of the moments (microseconds; after the last of them all rows
    count), as struct columns ``s1..sN`` (NULL before its first observation). Rows without an observation time are there
    from the first snapshot and lose against all others; ties are broken by the row's other columns."""
    state = F.struct(F.col(observed), *[c for c in rows.columns if c not in (*keys, observed)])
    known = [F.col(observed).isNull() | (F.col(observed) < F.lit(m)) for m in moments] + [F.lit(True)]
    return rows.groupBy(*keys).agg(*[F.max(F.when(k, state)).alias(f"s{i + 1}") for i, k in enumerate(known)])


def daily_moments(df: DataFrame, observed: Column, snapshots: int) -> list[int]:
    """The starts of the last ``snapshots - 1`` days observed, which are the ends of the snapshots before the last."""
    last = df.agg(F.max(observed).alias("m")).first().m or 0
    return [(last // DAY - i) * DAY for i in reversed(range(snapshots - 1))]


def snapshot_log(states: DataFrame, keys: list[str], snapshots: int, levels: tuple[int, ...]) -> DataFrame:
    """keys, state, snapshot: all of the first snapshot, and of each later one the states that a Merkle comparison with the one
    before finds new or changed. ``states`` is a stored table whose files are sorted by ``_leaf``. The digests of all
    snapshots come from one reading; after that only the pages of changed leaves are read."""
    digest = lambda i: F.bit_xor(F.when(F.col(f"s{i}").isNotNull(), F.xxhash64(*keys, f"s{i}")))
    sides = materialise(states.groupBy("_leaf").agg(*[digest(i).alias(f"d{i}") for i in range(1, snapshots + 1)], *[F.count(f"s{i}").alias(f"n{i}") for i in range(1, snapshots + 1)]))
    log = states.where(F.col("s1").isNotNull()).select(*keys, F.col("s1").alias("state"), F.lit(1).alias("snapshot"))
    for i in range(2, snapshots + 1):
        of = lambda j: F.when(F.col(f"n{j}") > 0, F.xxhash64("_leaf", f"d{j}", f"n{j}"))
        leaves = materialise(descend(sides.select("_leaf", of(i - 1).alias("old"), of(i).alias("new")), levels))
        some = [r._leaf for r in leaves.limit(LISTED + 1).collect()]
        near = states.where(F.col("_leaf").isin(some)) if len(some) <= LISTED else states.join(leaves, "_leaf", "left_semi")
        new = near.where(F.col(f"s{i}").isNotNull() & ~F.col(f"s{i}").eqNullSafe(F.col(f"s{i - 1}")))
        log = log.unionByName(new.select(*keys, F.col(f"s{i}").alias("state"), F.lit(i).alias("snapshot")))
    return log


def laid_over(log: DataFrame, keys: list[str]) -> DataFrame:
    """The first snapshot with the later ones' appended states over it: keys and state."""
    later = materialise(log.where(F.col("snapshot") > 1).groupBy(*keys).agg(F.max_by("state", "snapshot").alias("state")))
    first = log.where(F.col("snapshot") == 1).select(*keys, "state")
    other = later.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return first.join(other, same, "left_anti").unionByName(later)


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Equality with NULL equal to NULL."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


_OPEN = np.iinfo(np.int64).max


def _runs_of(entity: list[str], schema: pa.Schema):
    width = len(entity)

    def runs(table: pa.Table) -> pa.Table:
        """The runs of a sorted table, each as its first row with the run's end."""
        at = table.column(width).combine_chunks().to_numpy()
        stop = pc.fill_null(table.column(width + 1).combine_chunks(), _OPEN).to_numpy()
        stop = np.where(stop > at, stop, _OPEN)
        n = len(at)
        pair = np.ones(n - 1, bool)
        for c in range(width):
            x = table.column(c).combine_chunks()
            pair &= _same(x.slice(0, n - 1), x.slice(1))
        value = table.column(width + 2).combine_chunks()
        until = stop.copy()
        until[:-1] = np.where(pair, np.minimum(stop[:-1], at[1:]), stop[:-1])
        joined = pair & _same(value.slice(0, n - 1), value.slice(1)) & (until[:-1] == at[1:])
        first = np.flatnonzero(np.append(True, ~joined))
        last = np.append(first[1:], n) - 1
        rows = table.take(pa.array(first))
        end = until[last]
        return rows.set_column(width + 1, schema.field(width + 1), pa.array(end, pa.int64(), mask=end == _OPEN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: pa.Table | None = None
        head = True

        def out(rows: pa.Table, tail: bool) -> Iterator[pa.RecordBatch]:
            nonlocal head
            n = len(rows)
            flags = np.zeros((2, n), bool)
            flags[0, 0], flags[1, -1] = head, tail
            head = False
            full = pa.table([*rows.columns, pa.array(np.full(n, part)), pa.array(flags[0]), pa.array(flags[1])], schema=schema)
            yield from full.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            # a run that was open goes on as one row from its start to its present end
            table = table if held is None else pa.concat_tables([held, table.cast(held.schema)])
            done = runs(table)
            if len(done) > 1:
                yield from out(done.slice(0, len(done) - 1), False)
            held = done.slice(len(done) - 1).cast(table.schema)
        if held is not None:
            yield from out(held, True)

    return run


def versions(rows: DataFrame, entity: list[str], start: str, end: str, value: str) -> DataFrame:
    """Periods of equal ``value`` (text): a row holds from ``start`` (bigint, unique within the entity) until the next row's start or
    its own ``end`` if that is earlier; an ``end`` that is NULL or not after the start is ignored; adjoining rows of the
    same value are one version. Gives entity, start, end (NULL: open) and value."""
    fields = [StructField(e, StringType()) for e in entity] + [StructField("_at", LongType()), StructField("_stop", LongType()), StructField("_value", StringType())]
    out = StructType([*fields, StructField("_part", LongType()), *StructType.fromDDL("_head boolean, _tail boolean").fields])
    arrow = pa.schema([pa.field(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in out.fields])
    sorted_ = rows.select(*entity, F.col(start).alias("_at"), F.col(end).alias("_stop"), F.col(value).alias("_value")).repartitionByRange(*entity, "_at").sortWithinPartitions(*entity, "_at")
    runs = materialise(sorted_.mapInArrow(_runs_of(entity, arrow), out))
    fixed = _across(runs, entity)
    if fixed:
        spark = rows.sparkSession
        table = F.broadcast(spark.createDataFrame(fixed, "_p bigint, _h boolean, _drop boolean, _until bigint"))
        edge = runs.where(F.col("_head") | F.col("_tail")).join(table, (F.col("_part") == F.col("_p")) & (F.col("_head") == F.col("_h")), "left")
        edge = edge.where(~F.coalesce("_drop", F.lit(False))).withColumn("_stop", F.when(F.col("_drop").isNotNull(), F.col("_until")).otherwise(F.col("_stop")))
        runs = runs.where(~F.col("_head") & ~F.col("_tail")).unionByName(edge.select(*runs.columns))
    return runs.select(*entity, F.col("_at").alias(start), F.col("_stop").alias(end), F.col("_value").alias(value))


def _across(runs: DataFrame, entity: list[str]) -> list[tuple[int, bool, bool, int | None]]:
    """What becomes of the first and last run of each partition: (part, whether it is the first, dropped, end). What is collected is two rows for
    each partition, whatever the data's size."""
    ends = runs.where(F.col("_head") | F.col("_tail")).select(*entity, "_at", "_stop", "_value", "_part", "_head", "_tail").collect()
    ends.sort(key=lambda r: (r._part, not r._head))
    out: dict[tuple[int, bool], tuple[bool, int | None]] = {}
    before, until, home = None, None, None  # the run that may go on: its row, its end, and where it began
    for r in ends:
        stop = r._stop
        if before is not None and r._head and all(before[e] == r[e] for e in entity):
            limit = r._at if until is None else min(until, r._at)
            if limit == r._at and before._value == r._value:
                # it goes on: this run is part of it
                out[r._part, r._head] = True, None
                out[home] = False, stop
                before, until = r, stop
                if not r._tail:
                    before = None
                continue
            out[home] = False, limit
        before, until, home = (r, stop, (r._part, r._head)) if r._tail else (None, None, None)
    return [(p, h, d, u) for (p, h), (d, u) in out.items()]


def read_statements(df: DataFrame) -> DataFrame:
    """Statements with times in microseconds; those without a readable valid_from or as_of are dropped."""
    return df.select(
        "subject",
        "predicate",
        F.coalesce(parse_micros(F.col("valid_from")), parse_micros(F.col("as_of"))).alias("start"),
        parse_micros(F.col("observed_at")).alias("observed"),
        parse_micros(F.col("valid_to")).alias("stop"),
        "object_value",
    ).where(F.col("start").isNotNull())


_STATEMENT = ["subject", "predicate", "start"]


def statement_log(df: DataFrame, snapshots: int = 2) -> DataFrame:
    """The append log of statements over the last ``snapshots`` daily snapshots by observed_at: subject, predicate, start, state,
    snapshot. A statement's leaf follows from its subject, predicate and start, so no entity makes a leaf large."""
    moments = daily_moments(df, parse_micros(F.col("observed_at")), snapshots)
    states = snapshot_states(read_statements(df), _STATEMENT, "observed", moments)
    levels = levels_for(df.count())
    stored = materialise(states.withColumn("_leaf", _leaf(_STATEMENT, levels)).sortWithinPartitions("_leaf"))
    return snapshot_log(stored, _STATEMENT, snapshots, levels)


def statement_history(df: DataFrame, snapshots: int = 2) -> DataFrame:
    """Versions of each subject and predicate: subject, predicate, valid_from, valid_to, object_value, all text, times
    to the second in UTC, ``''`` for an open end. The result is the same for any number of snapshots; more of them make
    the log finer."""
    current = laid_over(statement_log(df, snapshots), _STATEMENT).select(*_STATEMENT, "state.stop", "state.object_value")
    out = versions(current, ["subject", "predicate"], "start", "stop", "object_value")
    return out.select(
        "subject", "predicate", format_seconds(F.col("start")).alias("valid_from"), F.coalesce(format_seconds(F.col("stop")), F.lit("")).alias("valid_to"), "object_value"
    )


def as_of(history: DataFrame, moment: Column) -> DataFrame:
    """The versions of a history that hold at ``moment`` (text in the same form); the end is exclusive."""
    return history.where((F.col("valid_from") <= moment) & ((F.col("valid_to") == "") | (F.col("valid_to") > moment)))
