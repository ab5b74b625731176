"""Source files: scanning, parsing to index entries, incremental refresh, resilient batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import ascii_lower, ignored

# Languages by file suffix, and folders that hold no first-party code.
LANGUAGES = {"py": "python", "ts": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "md": "markdown", "sql": "sql"}
DEPENDENCY_FOLDERS = ("node_modules", "vendor", "third_party", "site-packages", ".venv")

ENTRY = (
    "path string, language string, module string, sha256 string, size_bytes bigint, parse_error string, "
    "symbols array<struct<name:string,qualified_name:string,kind:string,lineno:int,end_lineno:int>>, "
    "imports array<struct<type:string,module:string,name:string,alias:string,lineno:int,level:int>>, "
    "references array<struct<name:string,qualified_name:string,lineno:int,kind:string>>"
)


def language_of(path: Column) -> Column:
    suffix = F.element_at(F.split(ascii_lower(path), r"\."), -1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix)


def tier_of(path: Column) -> Column:
    return F.when(path.rlike("(^|/)(" + "|".join(map(re.escape, DEPENDENCY_FOLDERS)) + ")/"), "dependency").otherwise("first_party")


def is_generated(path: Column, content: Column) -> Column:
    """By the file's name, or by a marker in the first 32 lines."""
    head = F.array_join(F.slice(F.split(content, "\n"), 1, 32), "\n")
    return path.rlike(r"(_pb2\.py|\.pb\.go|\.g\.dart|\.generated\.\w+|_generated\.\w+)$") | F.lower(head).rlike("do not edit|auto-?generated|code generated by")


def scan(spark: SparkSession, root: str, patterns: list[str] = (), languages: list[str] | None = None) -> DataFrame:
    """path (below the root), language, tier, content, size_bytes, mtime of the source files under a folder; ignore patterns
    exclude, the last that fits decides."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").removeprefix("file://"))
    path = F.regexp_replace(F.col("path"), f"^(?:file:/*)?/?{base.lstrip('/')}/", "")
    df = raw.select(path.alias("path"), F.col("content"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")).withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull())
    df = df.where(~ignored(F.col("path"), list(patterns))) if patterns else df
    df = df.where(F.col("language").isin(languages)) if languages else df
    return df.select("path", "language", tier_of(F.col("path")).alias("tier"), F.decode("content", "UTF-8").alias("content"), "size_bytes", "mtime")


def _python(text: str) -> tuple[list, list, list]:
    symbols, imports, refs = [], [], []

    def visit(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            name = prefix
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}.{child.name}" if prefix else child.name
                symbols.append((child.name, name, "class" if isinstance(child, ast.ClassDef) else "function", child.lineno, child.end_lineno))
            elif isinstance(child, ast.Import):
                imports.extend(("import", a.name, None, a.asname, child.lineno, 0) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.extend(("from", child.module or "", a.name, a.asname, child.lineno, child.level) for a in child.names)
            elif isinstance(child, ast.Call):
                full = ast.unparse(child.func)
                refs.append((full.rsplit(".", 1)[-1], full, child.lineno, "call"))
            visit(child, name)

    visit(ast.parse(text), "")
    return symbols, imports, refs


_DEFINITION = re.compile(r"^\s*(?:export\s+|pub\s+|public\s+|private\s+|static\s+|async\s+)*(function|func|fn|fun|class|interface|struct|enum|trait)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")
_IMPORT = re.compile(r"^\s*(?:import|use|from)\s+[\"'{]?([\w./:@-]+)")


def _other(text: str) -> tuple[list, list, list]:
    symbols, imports = [], []
    for n, line in enumerate(text.split("\n"), 1):
        if m := _DEFINITION.match(line):
            symbols.append((m[2], m[2], "class" if m[1] in ("class", "interface", "struct", "enum", "trait") else "function", n, n))
        elif m := _IMPORT.match(line):
            imports.append(("import", m[1], None, None, n, 0))
    return symbols, imports, []


def _markdown(text: str) -> tuple[list, list, list]:
    symbols, refs, stack, fenced = [], [], [], False
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else re.match(r"^(#{1,6})\s+(.+?)\s*$", line)
        if m:
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                symbols[stack.pop()[1]][4] = n - 1
            path = "/".join([symbols[i][0] for _, i in stack] + [m[2]])
            stack.append((level, len(symbols)))
            symbols.append([m[2], path, "section", n, len(lines)])
        refs += [(t, t, n, "doc_link") for t in re.findall(r"\[[^\]]*\]\(([^)\s]+)\)", line)]
    return [tuple(s) for s in symbols] or [("Document", "Document", "section", 1, len(lines))], [], refs


PARSERS = {"python": _python, "markdown": _markdown}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    names = [("name", "qualified_name", "kind", "lineno", "end_lineno"), ("type", "module", "name", "alias", "lineno", "level"), ("name", "qualified_name", "lineno", "kind")]
    for batch in batches:
        rows = []
        for path, language, content, size in batch[["path", "language", "content", "size_bytes"]].itertuples(index=False):
            content, error, found = content or "", None, ([], [], [])
            try:
                found = PARSERS.get(language, _other)(content)
            except Exception as e:  # a file that can't be parsed is a row with its error
                error = f"{type(e).__name__}: {e}"[:200]
            module = re.sub(r"\.\w+$", "", path).replace("/", ".")
            rows.append((path, language, module, hashlib.sha256(content.encode("utf-8", "replace")).hexdigest(), size, error, *[[dict(zip(n, r)) for r in part] for n, part in zip(names, found)]))
        yield pd.DataFrame(rows, columns=["path", "language", "module", "sha256", "size_bytes", "parse_error", "symbols", "imports", "references"])


def parse(scanned: DataFrame) -> DataFrame:
    """Index entries of scanned files. Python by its syntax tree, Markdown by headings and links, other languages by
    declarations; what can't be parsed keeps its row with ``parse_error``."""
    return scanned.select("path", "language", "content", "size_bytes").mapInPandas(_parse, ENTRY)


def build_index(spark: SparkSession, root: str, **options) -> DataFrame:
    return parse(scan(spark, root, **options))


def update_index(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """Entries of unchanged files kept, changed and new ones parsed, deleted ones dropped. A file is unchanged if its path and
    size and content hash are."""
    now = scanned.withColumn("sha256", F.sha2(F.encode("content", "UTF-8"), 256))
    kept = existing.join(now.select("path", "sha256"), ["path", "sha256"], "left_semi")
    changed = now.join(existing.select("path", "sha256"), ["path", "sha256"], "left_anti")
    return kept.select(*existing.columns).unionByName(parse(changed).select(*existing.columns))


def refresh_mode(existing: DataFrame | None, head: str | None, known_head: str | None, ignore_hash: str, known_ignore_hash: str | None) -> str:
    """load, incremental or full: a missing index or changed ignore rules need a full build."""
    if existing is None or ignore_hash != known_ignore_hash:
        return "full"
    return "load" if head is not None and head == known_head else "incremental"


def index_stream(spark: SparkSession, root: str, out: str, checkpoint: str):
    """Files indexed in resumable batches: a file stream whose checkpoint is the journal; each batch is appended to ``out``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 500).load(root)
    files = raw.select("path", language_of(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size_bytes")).where(F.col("language").isNotNull())

    def write(batch: DataFrame, _: int) -> None:
        parse(batch).write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_docs(scanned: DataFrame, limit: int) -> DataFrame:
    """Markdown below docs/ by path, then the root's, ``limit`` in all."""
    docs = scanned.where((F.col("language") == "markdown") & (F.col("path").startswith("docs/") | ~F.contains(F.col("path"), F.lit("/"))))
    return docs.orderBy(F.when(F.col("path").startswith("docs/"), 0).otherwise(1), "path").limit(limit)
