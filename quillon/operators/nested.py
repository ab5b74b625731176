"""Nested records to flat, linked tables.

``infer_shape`` merges the layouts of all JSON documents of a column in one distributed pass; ``flatten_json`` and
``flatten_columns`` then open one level of arrays after another. Every array path becomes a child table

    _root    struct of the caller's key columns
    _key     surrogate key of the row, ``_parent`` that of the row that holds the array
    _pos     place in the array, from 0, null elements counted
    value    struct of the scalar leaves, one field for each path and kind

Only the tables asked for are ever computed. All data sit in ``value``, so no field name can clash with a link column.

Numbers are kept as they are: integers of 64 bits are bigints, others doubles, and a path with both has a branch for each.
A key that an object repeats counts with its last value. Documents that can't be read are reported by ``rejected``.

Cases: NULL, unreadable (also with NaN or Infinity) and non-object documents give no rows; null elements keep their place but give no row; an object
found where other records have a list counts as a list of one; equal documents under equal keys are one record;
an empty input gives empty tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALARS = ("string", "integer", "number", "boolean")


@dataclass
class Shape:
    """A node of a merged schema: the kinds seen here, the fields of its objects, the merged element of its arrays."""

    kinds: set[str] = field(default_factory=set)
    fields: dict[str, Shape] = field(default_factory=dict)
    element: Shape | None = None

    def at(self, steps: tuple[str | None, ...]) -> Shape:
        node = self
        for step in steps:
            if step is None:
                node.element = node.element or Shape()
                node = node.element
            else:
                node = node.fields.setdefault(step, Shape())
        return node


def kind_of(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def _not_json(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def read_object(text: str | None) -> dict | None:
    """The JSON object in ``text``, or None. NaN and Infinity are no JSON, as for Spark's parser."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_not_json)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _walk(value: object, steps: tuple, seen: set) -> None:
    kind = kind_of(value)
    seen.add((steps, "integer" if kind == "number" and isinstance(value, int) and -(2**63) <= value < 2**63 else kind))
    if kind == "object":
        for k, v in value.items():
            _walk(v, (*steps, k), seen)
    elif kind == "array":
        inner = (*steps, None)
        for v in value:
            _walk(v, inner, seen)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            value = read_object(text)
            if value is not None:
                _walk(value, (), seen)
    rows = [(json.dumps(s), k) for s, k in seen]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["steps", "kind"])


def infer_shape(df: DataFrame, column: str, max_paths: int = 100_000) -> Shape:
    """Merge the layouts of all documents. What reaches the driver is the set of distinct (path, kind) pairs, which
    grows with the schema and not with the rows; more than ``max_paths`` of them (data used as keys) is an error."""
    found = df.select(column).mapInArrow(_shapes, "steps string, kind string").distinct().limit(max_paths + 1).collect()
    if len(found) > max_paths:
        raise ValueError(f"more than {max_paths} distinct paths in {column}: keys look like data")
    root = Shape()
    for row in sorted(found):
        root.at(tuple(json.loads(row.steps))).kinds.add(row.kind)
    return root


def shape_of(kind: T.DataType) -> Shape:
    """The shape of a Spark type."""
    if isinstance(kind, T.StructType):
        return Shape({"object"}, {f.name: shape_of(f.dataType) for f in kind.fields})
    if isinstance(kind, T.ArrayType):
        return Shape({"array"}, element=shape_of(kind.elementType))
    if isinstance(kind, T.IntegralType):
        return Shape({"integer"})
    if isinstance(kind, T.NumericType):
        return Shape({"number"})
    return Shape({"boolean" if isinstance(kind, T.BooleanType) else "string"})


class Tables:
    """The tables of a flattened column, by dotted array path; ``""`` is the root."""

    def __init__(self, root: DataFrame, shape: Shape, variant: bool):
        self._base, self.shape, self._variant = root, shape, variant
        self.paths = [""]
        self._list(shape, "")

    def _list(self, shape: Shape, prefix: str) -> None:
        for name, child in shape.fields.items():
            path = f"{prefix}.{name}" if prefix else name
            if child.element is not None:
                self.paths.append(path + "[]")
                self._list_element(child.element, path + "[]")
            else:
                self._list(child, path)

    def _list_element(self, shape: Shape, path: str) -> None:
        if shape.element is not None:
            self.paths.append(path + "[]")
            self._list_element(shape.element, path + "[]")
        self._list(shape, path)

    def _field(self, node: Column, names: list[str]) -> Column:
        """The value under ``names``: a variant stays a variant."""
        if not self._variant:
            for name in names:
                node = node.getField(name)
            return node
        if all(re.fullmatch(r"[A-Za-z_]\w*", n) for n in names):
            return F.try_variant_get(node, "$" + "".join(f".{n}" for n in names), "variant") if names else node
        for name in names:
            node = F.try_variant_get(node, "$", "map<string,variant>").getItem(name)
        return node

    def _kind(self, value: Column) -> Column:
        return F.schema_of_variant(value)

    def _elements(self, value: Column, shape: Shape) -> Column:
        if not self._variant:
            return value
        listed = F.try_variant_get(value, "$", "array<variant>")
        if "object" in shape.kinds:
            return F.coalesce(listed, F.when(F.startswith(self._kind(value), F.lit("OBJECT")), F.array(value)))
        return listed

    def _leaves(self, node: Column, shape: Shape, prefix: list[str], out: list[Column]) -> None:
        kinds = [k for k in SCALARS if k in shape.kinds]
        value = self._field(node, prefix)
        for kind in kinds:
            name = ".".join(prefix) or "item"
            if not self._variant:
                out.append(value.alias(name))
                continue
            name = name if len(kinds) == 1 else f"{name}:{kind}"
            of = self._kind(value)
            if kind == "string":
                out.append(F.when(of == "STRING", F.try_variant_get(value, "$", "string")).alias(name))
            elif kind == "boolean":
                out.append(F.when(of == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).alias(name))
            elif kind == "integer":
                out.append(F.when(of == "BIGINT", F.try_variant_get(value, "$", "bigint")).alias(name))
            elif "integer" in kinds:
                out.append(F.when((of == "DOUBLE") | F.startswith(of, F.lit("DECIMAL")), F.try_variant_get(value, "$", "double")).alias(name))
            else:
                out.append(F.when((of == "BIGINT") | (of == "DOUBLE") | F.startswith(of, F.lit("DECIMAL")), F.try_variant_get(value, "$", "double")).alias(name))
        for name, child in shape.fields.items():
            # below a path that is a list in some record, objects go to the child table with the lists
            self._leaves(node, child if child.element is None else Shape(child.kinds), [*prefix, name], out)

    def _nodes(self, path: str) -> tuple[DataFrame, Shape]:
        """Rows of ``path`` with the unopened ``_node``, and the shape of the node."""
        if path == "":
            return self._base, self.shape
        outer, _, last = path[:-2].rpartition("[]")
        outer = outer + "[]" if outer or path.startswith("[]") else ""
        names = [n for n in last.lstrip(".").split(".") if n]
        rows, shape = self._nodes(outer)
        for name in names:
            shape = shape.fields.get(name, Shape())
        value = self._elements(self._field(F.col("_node"), names), shape)
        opened = rows.select("_root", F.col("_key").alias("_parent"), "_pos", F.posexplode(value).alias("_at", "_node"))
        opened = opened.where(~F.is_variant_null("_node") if self._variant else F.col("_node").isNotNull())
        key = F.concat_ws("/", "_parent", F.lit(path), F.col("_at").cast("string"))
        return opened.select("_root", "_parent", key.alias("_key"), F.concat("_pos", F.array("_at")).alias("_pos"), "_node"), shape.element or Shape()

    def table(self, path: str = "") -> DataFrame:
        """The flat table of an array path as listed in ``paths``; a path that no document has gives an empty table.
        ``_pos`` is the place in its own array, ``_above`` the places of the arrays around it, outermost first."""
        rows, shape = self._nodes(path)
        leaves: list[Column] = []
        self._leaves(F.col("_node"), shape, [], leaves)
        value = F.struct(*leaves) if leaves else F.struct(F.lit(None).cast("string").alias("item"))
        if path == "":
            return rows.select("_root", "_key", value.alias("value"))
        return rows.select("_root", "_parent", "_key", F.element_at("_pos", -1).alias("_pos"), F.slice("_pos", F.lit(1), F.size("_pos") - 1).alias("_above"), value.alias("value"))


def parsed(df: DataFrame, column: str) -> DataFrame:
    """Adds ``_doc``, the variant of a JSON text, NULL if it can't be read; of a key that an object repeats the last value counts, as it does when the
    schema is inferred."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = df.sparkSession.conf.get(name, "false")
    df.sparkSession.conf.set(name, "true")
    try:
        # the setting is part of the expression once it is analysed
        return df.select("*", F.try_parse_json(F.col(column)).alias("_doc"))
    finally:
        df.sparkSession.conf.set(name, before)


def rejected(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys and reason of the documents that give no rows: 'null', 'not an object' or 'unreadable'."""
    doc = parsed(df.select(*keys, F.col(column).alias("_text")), "_text")
    is_object = F.startswith(F.schema_of_variant("_doc"), F.lit("OBJECT"))
    reason = F.when(F.col("_text").isNull(), "null").when(F.col("_doc").isNull(), "unreadable").when(~is_object, "not an object")
    return doc.select(*keys, reason.alias("reason")).where(F.col("reason").isNotNull())


def flatten_json(df: DataFrame, column: str, keys: list[str], shape: Shape | None = None, distinct: bool = True) -> Tables:
    """Flatten the JSON objects of a text column by their merged schema; ``keys`` name the columns kept as ``_root``. With ``distinct``
    equal documents under equal keys are one record, so that ``_key`` is unique; without it they are not looked for."""
    shape = shape or infer_shape(df, column)
    some = df.select(*dict.fromkeys([*keys, column])).where(F.col(column).rlike(r"^\s*\{") & F.col(column).rlike(r"\}\s*$"))
    some = some.withColumn("_key", F.md5(F.to_json(F.struct(*some.columns), {"ignoreNullFields": "false"})))
    some = parsed(some.dropDuplicates(["_key"]) if distinct else some, column)
    rows = some.select(F.struct(*keys).alias("_root"), "_key", F.array().cast("array<int>").alias("_pos"), F.col("_doc").alias("_node"))
    return Tables(rows.where(F.col("_node").isNotNull()), shape, variant=True)


def flatten_columns(df: DataFrame, columns: list[str], keys: list[str], distinct: bool = True) -> Tables:
    """Flatten struct and array columns; ``keys`` name the columns kept as ``_root``; ``distinct`` as for ``flatten_json``."""
    node = F.struct(*columns)
    rows = df.select(F.struct(*keys).alias("_root"), F.md5(F.to_json(F.struct(*dict.fromkeys([*keys, *columns])), {"ignoreNullFields": "false"})).alias("_key"), F.array().cast("array<int>").alias("_pos"), node.alias("_node"))
    return Tables(rows.dropDuplicates(["_key"]) if distinct else rows, shape_of(T.StructType([df.schema[c] for c in columns])), variant=False)


def plan_children(plans: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for each step file, candidate file and evidence source of the two plan tables, each row once:
    plan_id, child_kind, pos, sub_pos, child_value. Null and empty values give no row; a table in whose documents
    none of the paths occurs gives none either."""
    raw = flatten_json(plans, "payload", ["plan_id"], distinct=False)
    nested = flatten_columns(evidence, ["candidate_chunks", "candidate_files"], ["plan_id"], distinct=False)

    def rows(tables: Tables, path: str, kind: str, value: list[str], nested_in: bool = False) -> list[DataFrame]:
        if path not in tables.paths:
            return []
        df = tables.table(path)
        have = df.schema["value"].dataType.names
        texts = [F.col("value").getField(n) for n in value if n in have]
        if not texts:
            return []
        outer, inner = (F.element_at("_above", 1), F.col("_pos")) if nested_in else (F.col("_pos"), F.lit(0))
        return [df.select(F.col("_root.plan_id").alias("plan_id"), F.lit(kind).alias("child_kind"), outer.alias("pos"), inner.alias("sub_pos"), F.coalesce(*texts).alias("child_value"))]

    text = lambda name: [f"{name}:string", name]
    parts = [
        *rows(raw, "source_plan.steps[]", "step", text("file")),
        *rows(raw, "source_plan.candidate_files[]", "candidate_file", [*text("item"), *text("path")]),
        *rows(nested, "candidate_files[]", "candidate_file", ["path"]),
        *rows(nested, "candidate_chunks[].evidence.sources[]", "source", ["item"], nested_in=True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("child_value") != "").distinct()
