"""Writers: indexes, mirrors, logs, results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import fingerprint


def write_table(df: DataFrame, path: str) -> str:
    """A table written whole; readers see the old files until the new ones are complete."""
    df.write.mode("overwrite").parquet(path)
    return path


# Times with all six digits of a second; Spark's default would cut three of them.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def append_log(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    df.write.options(**_TIMES).mode("append").json(path)


def stream_log(df: DataFrame, path: str, checkpoint: str):
    """A stream appended as JSON lines, exactly once by its checkpoint."""
    return df.writeStream.format("json").options(**_TIMES).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def table_fingerprint(df: DataFrame, name: str, digest: str) -> str:
    """sha256 over the sorted pairs of one small table (a file list)."""
    return df.agg(fingerprint(F.col(name), F.col(digest)).alias("f")).first().f


def refresh_mirror(df: DataFrame, path: str, mark: str, known: str | None) -> bool:
    """Writes a mirror if its fingerprint changed; tells whether it did."""
    if mark == known:
        return False
    write_table(df.withColumn("_mark", F.lit(mark)), path)
    return True


def merge_vectors(stored: DataFrame, batch: DataFrame, batch_id: str) -> DataFrame:
    """Vectors by (provider, model, dimension, path): the batch replaces rows of the same key, and rows of the same provider,
    model and dimension that the batch doesn't have are stale and go."""
    key, space = ["provider", "model", "dimension", "path"], ["provider", "model", "dimension"]
    others = stored.join(batch.select(*space).distinct(), space, "left_anti")
    fresh = batch.dropDuplicates(key).withColumn("batch_id", F.lit(batch_id))
    return others.unionByName(fresh.select(*others.columns))


def merge_facts(stored: DataFrame, new: DataFrame, handle: str, ts: str) -> DataFrame:
    """Shared facts by handle, the newer one wins; of equals the new one."""
    rows = stored.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    others = [c for c in stored.columns if c != handle]
    return rows.groupBy(handle).agg(F.max_by(F.struct(*others), F.struct(ts, "_n")).alias("_r")).select(handle, "_r.*").select(*stored.columns)


def write_results(metrics: DataFrame, cases: DataFrame, folder: str) -> dict[str, str]:
    """Case rows and metrics of an evaluation as JSON."""
    out = {"metrics": f"{folder}/metrics", "cases": f"{folder}/cases"}
    metrics.coalesce(1).write.mode("overwrite").json(out["metrics"])
    cases.write.mode("overwrite").json(out["cases"])
    return out


def ranking_markdown(df: DataFrame, key: str, limit: int = 50) -> str:
    """The first rows of a ranking as Markdown."""
    rows = df.orderBy(F.desc("score"), key).limit(limit).collect()
    return "\n".join(f"{i}. `{r[key]}` ({r['score']:.4f})" for i, r in enumerate(rows, 1))


def spans(stages: DataFrame) -> DataFrame:
    """Trace spans of stages (trace_id, stage, place, elapsed_ms, started_at): each with its start and end."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("elapsed_ms").over(W.partitionBy("trace_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    start = F.unix_micros("started_at") + (before * 1000).cast("bigint")
    return stages.select("trace_id", F.substring(F.sha2(F.concat_ws(":", "trace_id", "stage", "place"), 256), 1, 16).alias("span_id"), F.col("stage").alias("name"), start.alias("start_us"), (start + (F.col("elapsed_ms") * 1000).cast("bigint")).alias("end_us"))
