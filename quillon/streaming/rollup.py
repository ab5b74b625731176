"""Telemetry as a stream: de-duplication and roll-ups kept by Structured Streaming, and schedules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """A stream of parquet files; zone-less times mean UTC."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def event_rollup(events: DataFrame, delay: str = "2 days", width: str = "1 day") -> DataFrame:
    """Counters by day and kind. An event recorded again within the watermark counts once."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    day = F.window("ts", width)
    return once.groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what is there and stop: the state of ``complete`` replaces the table at ``out``."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def cron_matches(spec: str, moment: datetime) -> bool:
    """Whether a five-field schedule (minute, hour, day, month, weekday with Sunday 0) includes the moment; fields are *,
    numbers, ranges, lists and steps."""

    def fits(field: str, value: int, low: int, high: int) -> bool:
        for part in field.split(","):
            span, _, step = part.partition("/")
            if span == "*":
                a, b = low, high
            elif "-" in span:
                a, b = map(int, span.split("-"))
            else:
                a = int(span)
                b = high if step else a
            if a <= value <= b and (value - a) % int(step or 1) == 0:
                return True
        return False

    minute, hour, day, month, weekday = spec.split()
    return fits(minute, moment.minute, 0, 59) and fits(hour, moment.hour, 0, 23) and fits(day, moment.day, 1, 31) and fits(month, moment.month, 1, 12) and (fits(weekday, moment.isoweekday() % 7, 0, 6) or (weekday.isdigit() and int(weekday) == 7 and moment.isoweekday() == 7))


def due(tasks: list[dict], now: datetime) -> list[str]:
    """Names of the tasks due at a tick: by ``cron`` at most once a minute, or ``every`` so many seconds since ``last``."""
    out = []
    for t in tasks:
        last = t.get("last")
        if "every" in t:
            ready = last is None or (now - last).total_seconds() >= t["every"]
        else:
            ready = cron_matches(t["cron"], now) and (last is None or last.replace(second=0, microsecond=0) < now.replace(second=0, microsecond=0))
        if ready:
            out.append(t["name"])
    return out
