"""Stages, hooks and providers: the extension surface. A stage turns a DataFrame into a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import shared_dir

Stage = Callable[[DataFrame], DataFrame]


class Pipeline:
    """Named stages in order, with hooks before and after each, and the schemas promised at their edges."""

    def __init__(self) -> None:
        self.stages: dict[str, Stage] = {}
        self.contracts: dict[str, T.StructType] = {}
        self.before: list[Callable[[str, DataFrame], DataFrame]] = []
        self.after: list[Callable[[str, DataFrame], DataFrame]] = []

    def stage(self, name: str, schema: str | None = None) -> Callable[[Stage], Stage]:
        def add(fn: Stage) -> Stage:
            if name in self.stages:
                raise ValueError(f"stage {name} is registered already")
            self.stages[name] = fn
            if schema:
                self.contracts[name] = T.StructType.fromDDL(schema)
            return fn

        return add

    def run(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        for name in names or self.stages:
            for hook in self.before:
                df = hook(name, df)
            df = self.stages[name](df)
            for hook in self.after:
                df = hook(name, df)
            if name in self.contracts:
                validate(df, self.contracts[name])
        return df


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame itself if it has the schema's columns with their types; else an error that names the first that differs."""
    have = {f.name: f.dataType for f in df.schema}
    for f in schema:
        if have.get(f.name) != f.dataType:
            raise ValueError(f"column {f.name}: {have.get(f.name)} instead of {f.dataType}")
    return df


class EmbeddingProvider(Protocol):
    """Texts of a batch to vectors."""

    dimension: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Ranker(Protocol):
    """Files and terms to (path, score)."""

    def __call__(self, files: DataFrame, terms: list[str], top_k: int) -> DataFrame: ...


def encode(df: DataFrame, column: str, provider: EmbeddingProvider, out: str = "vector") -> DataFrame:
    """Vectors of a text column by a provider, batch by batch."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(provider.encode(texts.fillna("").tolist()))

    return df.withColumn(out, run(F.col(column)))


class Channels:
    """Named readers of memories with aliases."""

    def __init__(self) -> None:
        self.readers: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, reader: Callable[[SparkSession], DataFrame], aliases: tuple[str, ...] = ()) -> None:
        for n in (name, *aliases):
            self.readers[n.strip().lower()] = reader

    def read(self, spark: SparkSession, *names: str) -> DataFrame:
        """The first channel of ``names`` that has rows; the last one if none has."""
        df = None
        for n in names:
            df = self.readers[n.strip().lower()](spark)
            if df.take(1):
                return df
        if df is None:
            raise ValueError("no channel given")
        return df


class ResultCache:
    """Results by a key of what they depend on, in the shared folder, so that all executors and later runs see them."""

    def __init__(self, spark: SparkSession, name: str = "results"):
        self.spark, self.folder = spark, f"{shared_dir(spark).rstrip('/')}/{name}"

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        import hashlib

        path = f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self.spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def agent_loop(run: Callable[[str], DataFrame], refine: Callable[[DataFrame], str | None], query: str, most: int = 3) -> DataFrame:
    """Runs a query, and again with what ``refine`` makes of the result, until it gives None or ``most`` runs are done."""
    result = run(query)
    for _ in range(most - 1):
        again = refine(result)
        if again is None or again == query:
            break
        query, result = again, run(again)
    return result
