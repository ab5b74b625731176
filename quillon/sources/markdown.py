"""Markdown texts as sections, and tables of their tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import text, words


def sections(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, section, level, heading, line, body: the text before the first heading is section 0 without a heading; lines that
    look like headings inside code fences are body. A text's lines stay in one row's window; NULL texts give no rows."""
    lines = df.where(F.col(column).isNotNull()).select(key, F.posexplode(F.split(text(column), "\r?\n")).alias("line", "x"))
    w = W.partitionBy(key).orderBy("line")
    fence = F.col("x").rlike(r"^\s*```")
    inside = F.sum(fence.cast("int")).over(w) % 2 == 1
    heading = F.col("x").rlike(r"^#{1,6}\s+\S") & ~inside
    marked = lines.withColumn("_h", heading).withColumn("section", F.sum(F.col("_h").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line", "x")))), lambda s: s["x"]), "\n")
    head = F.max(F.when(F.col("_h"), F.col("x")))
    out = marked.groupBy(key, "section").agg(head.alias("_x"), F.min("line").alias("line"), body.alias("body"))
    return out.select(key, "section", F.length(F.regexp_extract(F.coalesce("_x", F.lit("")), r"^(#+)", 1)).alias("level"), F.regexp_replace(F.coalesce("_x", F.lit("")), r"^#+\s+", "").alias("heading"), "line", "body")


def heading_paths(df: DataFrame, key: str) -> DataFrame:
    """Adds ``path``: the headings above each section, outermost first, joined by `` > ``: of every level the last one seen
    since a heading of a smaller level."""
    w = W.partitionBy(key).orderBy("section").rowsBetween(W.unboundedPreceding, 0)
    out = df
    for n in range(1, 7):
        last = F.max(F.when((F.col("level") > 0) & (F.col("level") <= n), F.struct("section", "level", "heading"))).over(w)
        out = out.withColumn(f"_l{n}", F.when((last["level"] == n) & (F.col("level") >= n), last["heading"]))
    return out.withColumn("path", F.concat_ws(" > ", *[f"_l{n}" for n in range(1, 7)])).drop(*[f"_l{n}" for n in range(1, 7)])


# How much a token counts in each field of a section.
FIELD_WEIGHTS = {"heading": 3.0, "path": 2.0, "body": 1.0}


def section_tokens(df: DataFrame, key: list[str], fields: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """key, token, tf: counts weighted by field."""
    each = [df.select(*key, F.explode(words(F.col(f))).alias("token"), F.lit(w).alias("w")) for f, w in fields.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.groupBy(*key, "token").agg(F.sum("w").alias("tf"))


def links(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, label, target of inline links."""
    found = F.explode(F.regexp_extract_all(text(column), F.lit(r"\[[^\]\n]*\]\([^)\s]+\)"), F.lit(0))).alias("x")
    return df.select(key, found).select(key, F.regexp_extract("x", r"^\[(.*)\]\(", 1).alias("label"), F.regexp_extract("x", r"\(([^)]*)\)$", 1).alias("target"))
