"""Session building and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "quillon") -> SparkSession:
    """A session with UTC times, AQE and skew handling on; sizes are for one machine and meant to be overridden."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where a local session leaves it unset, a folder of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is removed when the driver's process ends, as far as it can be."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@atexit.register
def release() -> None:
    """Remove the tables that this process wrote to a shared folder that is mounted here."""
    while _WRITTEN:
        shutil.rmtree(_WRITTEN.pop().removeprefix("file://"), ignore_errors=True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there, and the files
    survive the loss of executors. They stay until the driver's process ends."""
    spark = df.sparkSession
    path = shared_path(spark, "quillon")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors' Python workers, once for each application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)
