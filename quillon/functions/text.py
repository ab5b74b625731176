"""Tokenizers, overlaps, normalisers and small text rules as column expressions. NULL text counts as ''."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: how an identifier falls into camel-case parts.
CAMEL = r"[A-Z]+(?=[A-Z][a-z]|[0-9]|$)|[A-Z]?[a-z]+|[0-9]+"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z alone: the same in every engine and locale."""
    return F.translate(c, _UPPER, _LOWER)


def words(c: Column) -> Column:
    """All runs of letters, digits and underscores, lower-cased, in order, with repeats."""
    return F.regexp_extract_all(ascii_lower(text(c)), F.lit("[a-z0-9_]+"), F.lit(0))


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def code_tokens(c: Column, min_len: int = 2, limit: int | None = 64) -> Column:
    """Distinct lower-case tokens of code-like text in order: each part whole, then its camel-case fragments. The first
    ``limit``, which is meant for query strings; None: all."""
    parts = F.regexp_extract_all(text(c), F.lit("[a-zA-Z0-9_]+"), F.lit(0))
    both = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), F.regexp_extract_all(p, F.lit(CAMEL), F.lit(0)))))
    long = F.filter(F.transform(both, ascii_lower), lambda t: F.length(t) >= min_len)
    return F.array_distinct(long) if limit is None else F.slice(F.array_distinct(long), 1, limit)


def path_words(c: Column) -> Column:
    """Tokens of the evaluation: slashes and dots become blanks, then split at blanks."""
    return F.array_distinct(F.filter(F.split(ascii_lower(F.translate(text(c), "/.", "  ")), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b|, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(query: Column, field: Column) -> Column:
    """|q ∩ f| / |q|, 0 for an empty query."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, field)) / F.size(F.array_distinct(query)))


def normal_path(c: Column, strip_leading_slash: bool = False) -> Column:
    """Slashes instead of backslashes, no leading ``./``."""
    p = F.regexp_replace(F.translate(F.trim(text(c)), "\\", "/"), r"^(\./)+", "")
    return F.regexp_replace(p, "^/+", "") if strip_leading_slash else p


def tail_symbol(c: Column) -> Column:
    """The last non-empty part of a dotted or slashed name."""
    parts = F.filter(F.transform(F.split(F.translate(text(c), "/", "."), r"\."), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def signal(value: Column, top: Column, use_log: bool = False) -> Column:
    """value / top, or the ratio of their log1p, clamped to 0..1; 0 where either isn't positive."""
    ratio = F.log1p(value) / F.log1p(top) if use_log else value / top
    return F.when((value > 0) & (top > 0), F.least(F.lit(1.0), ratio)).otherwise(F.lit(0.0))


def estimate_tokens(c: Column) -> Column:
    """Number of blank-separated words."""
    return F.size(F.filter(F.split(F.trim(text(c)), r"\s+"), lambda t: t != ""))


def contains_marker(c: Column, marker: str) -> Column:
    """ASCII markers must stand as whole words, others anywhere."""
    low = ascii_lower(text(c))
    if marker.isascii():
        return low.rlike(r"(?<![a-z0-9_])" + re.escape(marker.lower()) + r"(?![a-z0-9_])")
    return F.contains(low, F.lit(marker.lower()))


def found_keywords(c: Column, keywords: list[str], min_len: int = 4) -> Column:
    """Keywords contained in the text, none for texts shorter than ``min_len``."""
    low = ascii_lower(text(c))
    hits = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(low, k))
    return F.when(F.length(F.trim(low)) >= min_len, hits).otherwise(F.array().cast("array<string>"))


def first_rule(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first rule one of whose keywords the text contains."""
    low = ascii_lower(text(c))
    out = F.lit(default)
    for name, keywords in reversed(rules):
        any_ = F.lit(False)
        for k in keywords:
            any_ = any_ | F.contains(low, F.lit(k))
        out = F.when(any_, F.lit(name)).otherwise(out)
    return out


def snippet(c: Column, query: list[str], limit: int = 240) -> Column:
    """The first non-empty line with a query token, else the first non-empty line, cut to ``limit`` characters."""
    lines = F.filter(F.transform(F.split(text(c), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    has = F.filter(lines, lambda x: F.exists(F.array(*[F.lit(q) for q in query]), lambda q: F.contains(ascii_lower(x), q)))
    return F.substring(F.coalesce(F.try_element_at(has, F.lit(1)), F.try_element_at(lines, F.lit(1)), F.lit("")), 1, limit)


def glob_regex(pattern: str) -> str:
    """A glob of paths as a regular expression: ``**`` crosses slashes, ``*`` and ``?`` don't; a pattern without a slash
    fits at any depth, one that ends in a slash fits everything below."""
    anchored = pattern.startswith("/")
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    start = "^" if anchored or "/" in body else "^(?:.*/)?"
    return start + out + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns exclude a path: the last that fits decides, ``!`` readmits, ``#`` lines are comments."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        keep = p.startswith("!")
        out = F.when(path.rlike(glob_regex(p.lstrip("!"))), F.lit(not keep)).otherwise(out)
    return out


def half_life(age_days: Column, half_life_days: float) -> Column:
    """0.5 ** (age / half-life); 1 for no half-life or no age."""
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.when(age_days <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age_days / F.lit(float(half_life_days))))


def days_between(later: Column | str, earlier: Column) -> Column:
    later = F.lit(later).cast("timestamp") if isinstance(later, str) else later
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400e6)


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end, 0 if either is missing or the end is earlier."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3_600e6)), F.lit(0.0))


def stable_handle(c: Column, metadata: Column) -> Column:
    """``sha256:`` of text and metadata, for rows without a handle of their own."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(text(c), F.lit("::"), F.coalesce(metadata, F.lit("{}"))), 256))


def fingerprint(names: Column, hashes: Column) -> Column:
    """An aggregate: sha256 of the sorted ``name:hash`` pairs."""
    return F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(names, F.lit(":"), hashes)))), 256)
