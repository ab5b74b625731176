"""Schemas that drift between files: tagged-union inference, one table of constant columns, a report of changes.

Every file's layout is a set of paths, each with the alternative types its values take (string, number, boolean,
array). Fusing the files' layouts keeps all alternatives of a path; ``union_table`` gives each of them a typed branch
column and every path a canonical text column; ``file_changes`` reports what differs between successive files.

Cases: documents that are NULL, unreadable or no objects count for nothing; NULL values don't hold a path; objects count
by what they hold, so an empty object holds nothing; lists aren't entered; a file without a readable document has no
paths; a file is compared only if the file numbered one lower is there; an empty input gives empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.nested import Shape, infer_shape, kind_of, parsed, read_object
from quillon.session import materialise

TYPES = ("string", "number", "boolean", "array")
BRANCHES = ("string", "integer", "number", "boolean", "array")
#: Values kept for each path, those with the smallest hashes: a bottom-k sketch, which merges exactly.
SKETCH = 64


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Dotted paths to non-null values that aren't objects."""
    for name, item in value.items():
        path = f"{prefix}.{name}" if prefix else name
        if isinstance(item, dict):
            yield from leaves(item, path)
        elif item is not None:
            yield path, item


_PROFILE = "producer string, file_seq int, source_file string, path string, objects bigint, string bigint, number bigint, boolean bigint, array bigint"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files: dict[tuple, list] = {}
    for batch in batches:
        for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
            state = files.setdefault(tuple(key), [0, {}])
            value = read_object(text)
            if value is None:
                continue
            state[0] += 1
            paths = state[1]
            for path, item in leaves(value):
                at = path, kind_of(item)
                paths[at] = paths.get(at, 0) + 1
    rows: list[tuple] = []
    for key, (objects, paths) in files.items():
        rows.append((*key, None, objects, 0, 0, 0, 0))
        merged: dict[str, Counter] = {}
        for (path, kind), n in paths.items():
            merged.setdefault(path, Counter())[kind] += n
        rows += [(*key, path, 0, *(kinds[t] for t in TYPES)) for path, kinds in merged.items()]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5]
    columns = list(zip(*rows)) if rows else [()] * len(types)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in _PROFILE.split(", ")])


def file_profiles(df: DataFrame) -> DataFrame:
    """Per file and path the number of values of each type, counted inside the partitions before they are added up;
    a row with NULL path carries the file's number of objects."""
    parts = df.select("producer", "file_seq", "source_file", "payload").mapInArrow(_profiles, _PROFILE)
    sums = parts.groupBy("producer", "file_seq", "source_file", "path").agg(*[F.sum(c).alias(c) for c in ("objects", *TYPES)])
    of_file = W.partitionBy("producer", "file_seq", "source_file")
    return materialise(sums.withColumn("objects", F.max("objects").over(of_file)))


def _held(profiles: DataFrame, share: float) -> DataFrame:
    """Paths that files have, with their type; of equally frequent types the first of ``TYPES``."""
    n = sum((F.col(t) for t in TYPES), F.lit(0))
    top = F.greatest(*TYPES)
    kind = F.coalesce(*[F.when(F.col(t) == top, F.lit(t)) for t in TYPES])
    return profiles.where(F.col("path").isNotNull() & (n >= F.col("objects") * F.lit(share))).select("producer", "file_seq", "path", kind.alias("type"), (n / F.col("objects")).alias("held"))


def layout_changes(profiles: DataFrame, share: float = 0.2) -> DataFrame:
    """producer, file_seq, source_file, path, old_type, new_type, old_held, new_held of each path that differs from
    the producer's file before; the type is NULL where the path isn't held."""
    files = profiles.where(F.col("path").isNull()).select("producer", "file_seq", "source_file")
    before = files.select(F.col("producer").alias("p"), (F.col("file_seq") + 1).alias("s"))
    pairs = files.join(before, F.col("producer").eqNullSafe(F.col("p")) & (F.col("file_seq") == F.col("s")), "left_semi")
    held = _held(profiles, share)
    new = held.select("producer", "file_seq", "path", F.col("type").alias("new_type"), F.col("held").alias("new_held"), F.lit(None).cast("string").alias("old_type"), F.lit(None).cast("double").alias("old_held"))
    old = held.select("producer", (F.col("file_seq") + 1).alias("file_seq"), "path", F.lit(None).cast("string").alias("new_type"), F.lit(None).cast("double").alias("new_held"), F.col("type").alias("old_type"), F.col("held").alias("old_held"))
    both = new.unionByName(old).groupBy("producer", "file_seq", "path").agg(*[F.max(c).alias(c) for c in ("old_type", "new_type", "old_held", "new_held")])
    return pairs.join(both, ["producer", "file_seq"]).where(~F.col("old_type").eqNullSafe(F.col("new_type")))


def _sort(text: str) -> str:
    """The sort of a text: numbers by magnitude, others by their pattern of words, digits and marks."""
    if re.fullmatch(r"[+-]?\d+(\.\d+)?", text):
        return "number " + _bin(float(text)) + ("." if "." in text else "")
    shape = re.sub(r"[^\W\d_]+", "a", text)
    shape = re.sub(r"\d+", "9", shape)
    shape = re.sub(r"(?:a9|9a)[a9]*", "x", shape)
    words = shape.split()
    return shape if len(words) < 3 else "words"


def _bin(x: float) -> str:
    """Half a decade of a number's size, with its sign; numbers up to 1 and up to 100 are one bin each."""
    if not math.isfinite(x):
        return "?"
    if abs(x) <= 1:
        return "0"
    sign = "-" if x < 0 else ""
    return sign + ("2" if abs(x) <= 100 else str(math.floor(math.log10(abs(x)) * 2) / 2))


def features(value: object) -> list[str]:
    """What is compared of a value: ``s`` its sort, ``v`` itself."""
    kind = kind_of(value)
    if kind == "boolean":
        return [f"s{value}"]
    if kind == "number":
        whole = isinstance(value, int) or value.is_integer()
        return [f"s{_bin(float(value) if abs(value) < 1e300 else math.inf)}{'' if whole else '.'}"]
    if kind == "array":
        inner = sorted({x if isinstance(x, str) else "\0" + kind_of(x) for x in value}) or ["\0null"]
        sorts = sorted({x[1:] if x[0:1] == "\0" else _sort(x) for x in inner})
        return ["s" + x for x in sorts] + ["v" + x.lstrip("\0") for x in inner]
    return ["s" + _sort(value), "v" + value]


_SKETCH = "producer string, file_seq int, path string, kind string, feature bigint, n bigint"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    # by path and kind of feature, hash to count. What isn't among the smallest hashes now never will be again, so it can be
    # dropped whenever there are too many
    held: dict[tuple, dict[int, int]] = {}
    for batch in batches:
        for producer, seq, paths, text in zip(*(c.to_pylist() for c in batch.columns)):
            value = read_object(text)
            wanted = {(p, t) for p, t in (x.split("\0") for x in paths)}
            for path, item in leaves(value) if value is not None else ():
                if (path, kind_of(item)) in wanted:
                    for f in features(item):
                        at = (producer, seq, path, f[0])
                        counts = held.setdefault(at, {})
                        h = xxhash.xxh64_intdigest(f) - (1 << 63)
                        counts[h] = counts.get(h, 0) + 1
                        if len(counts) > 8 * SKETCH:
                            held[at] = dict(sorted(counts.items())[:SKETCH])
    rows = [(*key, h, n) for key, counts in held.items() for h, n in sorted(counts.items())[:SKETCH]]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * len(types)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in _SKETCH.split(", ")])


def value_sketches(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """For the (producer, file_seq, path, type) of ``wanted`` the share of each sort and of each sampled value, and
    how many of the sampled values are distinct: producer, file_seq, path, kind, feature, share, distinct."""
    paths = wanted.groupBy("producer", "file_seq").agg(F.collect_set(F.concat("path", F.lit("\0"), "type")).alias("paths"))
    rows = df.select("producer", "file_seq", "payload").join(paths, ["producer", "file_seq"]).select("producer", "file_seq", "paths", "payload")
    sums = rows.mapInArrow(_sketches, _SKETCH).groupBy("producer", "file_seq", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    of_path = W.partitionBy("producer", "file_seq", "path", "kind")
    least = sums.withColumn("at", F.row_number().over(of_path.orderBy("feature"))).where(F.col("at") <= SKETCH)
    total = F.sum("n").over(of_path)
    return materialise(least.select("producer", "file_seq", "path", "kind", "feature", (F.col("n") / total).alias("share"), (F.count("*").over(of_path) / total).alias("distinct")))


def rename_scores(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Each pair of a path that went and one of the same type that came in the same file, with the likeness of their
    values from 0 to 1: that of the values themselves where they repeat within a file, else that of their sorts."""
    went = changes.where(F.col("new_type").isNull()).select("producer", "file_seq", F.col("path").alias("old_path"), F.col("old_type").alias("type"), "old_held")
    came = changes.where(F.col("old_type").isNull()).select("producer", "file_seq", F.col("path").alias("new_path"), F.col("new_type").alias("type"), "new_held")
    pairs = went.join(came, ["producer", "file_seq", "type"])
    wanted = pairs.select("producer", (F.col("file_seq") - 1).alias("file_seq"), F.col("old_path").alias("path"), "type").unionByName(
        pairs.select("producer", "file_seq", F.col("new_path").alias("path"), "type")
    )
    sketches = value_sketches(df, wanted)
    at = ["producer", "file_seq"]
    old = sketches.select("producer", (F.col("file_seq") + 1).alias("file_seq"), F.col("path").alias("old_path"), "kind", "feature", F.col("share").alias("a"), F.lit(0.0).alias("b"), F.col("distinct").alias("da"), F.lit(None).cast("double").alias("db"))
    new = sketches.select("producer", "file_seq", F.col("path").alias("new_path"), "kind", "feature", F.lit(0.0).alias("a"), F.col("share").alias("b"), F.lit(None).cast("double").alias("da"), F.col("distinct").alias("db"))
    both = pairs.join(old, [*at, "old_path"]).unionByName(pairs.join(new, [*at, "new_path"]))
    keys = [*at, "type", "old_path", "new_path", "old_held", "new_held"]
    sums = both.groupBy(*keys, "kind", "feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("da").alias("da"), F.max("db").alias("db"))
    of = lambda kind, x: F.max(F.when(F.col("kind") == kind, x))
    like = sums.groupBy(*keys, "kind").agg(F.sum(F.least("a", "b")).alias("like"), F.max("da").alias("da"), F.max("db").alias("db"))
    out = like.groupBy(*keys).agg(of("s", F.col("like")).alias("sorts"), of("v", F.col("like")).alias("values"), of("v", F.least("da", "db")).alias("distinct"))
    return out.withColumn("likeness", F.when(F.col("distinct") < 0.5, F.col("values")).otherwise(F.col("sorts")))


def _name_likeness(a: Column, b: Column) -> Column:
    words = lambda p: F.filter(F.split(F.lower(F.regexp_replace(p, r"([a-z])([A-Z])", "$1_$2")), r"[^a-z0-9]+"), lambda w: w != "")
    return F.size(F.array_intersect(words(a), words(b))) / F.size(F.array_union(words(a), words(b)))


def match_renames(scores: DataFrame, least: float = 0.3) -> DataFrame:
    """One-to-one pairs of at least the likeness ``least``, best first; names and the share of documents that hold the
    path decide between likely pairs. A file's pairs are few: they are folded in one expression."""
    rank = F.col("likeness") + 0.3 * _name_likeness(F.col("old_path"), F.col("new_path")) - 0.3 * F.abs(F.col("old_held") - F.col("new_held"))
    pair = F.struct((-rank).alias("rank"), F.col("old_path").alias("old"), F.col("new_path").alias("new"))
    listed = scores.where(F.col("likeness") >= least).groupBy("producer", "file_seq").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    none = F.array().cast("array<struct<rank:double,old:string,new:string>>")
    taken = F.aggregate(
        "pairs", none, lambda out, p: F.when(F.exists(out, lambda o: (o["old"] == p["old"]) | (o["new"] == p["new"])), out).otherwise(F.concat(out, F.array(p)))
    )
    return listed.select("producer", "file_seq", F.explode(taken).alias("p")).select("producer", "file_seq", F.col("p.old").alias("old_path"), F.col("p.new").alias("new_path"))


def file_changes(df: DataFrame, share: float = 0.2, least: float = 0.3) -> DataFrame:
    """source_file, change_kind (added, removed, retyped, renamed), old_path, new_path: each change of a file's layout
    from the producer's file numbered one lower. ``share`` is the part of a file's objects that must hold a path,
    ``least`` the likeness from which a removed and an added path count as one renamed."""
    # a producer that is NULL is one like others, so the joins below take its JSON
    df = df.withColumn("producer", F.to_json(F.struct("producer")))
    changes = materialise(layout_changes(file_profiles(df), share))
    renamed = materialise(match_renames(rename_scores(df, changes), least))
    at = ["producer", "file_seq"]
    both = F.col("old_type").isNotNull() & F.col("new_type").isNotNull()
    files = changes.groupBy(*at).agg(F.max("source_file").alias("source_file"))
    went = changes.join(renamed.select(*at, F.col("old_path").alias("path")), [*at, "path"], "left_anti").where(F.col("new_type").isNull())
    came = changes.join(renamed.select(*at, F.col("new_path").alias("path")), [*at, "path"], "left_anti").where(F.col("old_type").isNull())
    row = lambda kind, a, b: ("source_file", F.lit(kind).alias("change_kind"), a.alias("old_path"), b.alias("new_path"))
    path, none = F.col("path"), F.lit("")
    return (
        changes.where(both).select(*row("retyped", path, path))
        .unionByName(went.select(*row("removed", path, none)))
        .unionByName(came.select(*row("added", none, path)))
        .unionByName(renamed.join(files, at).select(*row("renamed", F.col("old_path"), F.col("new_path"))))
    )


def alternatives(df: DataFrame) -> DataFrame:
    """For each path and type the first file of each producer in which a value of that type appears, and how many
    values there are: the report of appearing alternatives."""
    counts = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("n")) for t in TYPES])).alias("x")
    long = file_profiles(df).where(F.col("path").isNotNull()).select("producer", "file_seq", "path", counts).where(F.col("x.n") > 0)
    return long.groupBy("producer", "path", F.col("x.type").alias("type")).agg(F.min("file_seq").alias("first_file_seq"), F.sum("x.n").alias("n_values"))


def _open(shape: Shape, prefix: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Shape]]:
    for name, child in sorted(shape.fields.items()):
        path = (*prefix, name)
        if child.kinds & set(BRANCHES):
            yield path, child
        yield from _open(child, path)


def union_table(df: DataFrame, column: str, keys: list[str], shape: Shape | None = None) -> DataFrame:
    """One row for each readable document: ``keys``, then for each path a canonical text column named as the path and,
    where a path has more than one type, a branch column ``path:type`` for each. Integers are
    bigints, other numbers doubles; lists are JSON text. A document without the path, or with another type, has NULL in the branch. Keys must not be named as paths."""
    shape = shape or infer_shape(df, column)
    some = df.select(*dict.fromkeys([*keys, column])).where(F.col(column).rlike(r"^\s*\{") & F.col(column).rlike(r"\}\s*$"))
    rows = parsed(some, column).where(F.col("_doc").isNotNull())
    out: list[Column] = []
    for path, child in _open(shape):
        value = F.col("_doc")
        for name in path:
            value = F.try_variant_get(value, "$", "map<string,variant>").getItem(name) if not re.fullmatch(r"[A-Za-z_]\w*", name) else F.try_variant_get(value, f"$.{name}", "variant")
        of = F.schema_of_variant(value)
        kinds = [t for t in BRANCHES if t in child.kinds]
        known = {
            "string": (of == "STRING", "string"),
            "integer": (of == "BIGINT", "bigint"),
            "number": (((of == "BIGINT") & F.lit("integer" not in kinds)) | (of == "DOUBLE") | F.startswith(of, F.lit("DECIMAL")), "double"),
            "boolean": (of == "BOOLEAN", "boolean"),
            "array": (F.startswith(of, F.lit("ARRAY")), "string"),
        }
        leaf = ~F.startswith(of, F.lit("OBJECT")) if "object" in child.kinds else F.lit(True)
        out.append(F.when(leaf, F.try_variant_get(value, "$", "string")).alias(".".join(path)))
        if len(kinds) > 1:
            out += [F.when(known[k][0], F.try_variant_get(value, "$", known[k][1])).alias(f"{'.'.join(path)}:{k}") for k in kinds]
    return rows.select(*keys, *out)


__all__ = ["TYPES", "alternatives", "features", "file_changes", "file_profiles", "layout_changes", "leaves", "match_renames", "rename_scores", "union_table", "value_sketches"]
