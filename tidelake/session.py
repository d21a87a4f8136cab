"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution); ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a new local one is set for this session. That does
    for a single machine only, so on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs that start within give Python at most so many rows at once (None: as the session says). Whole texts in batches of the
    usual 10000 rows take some 100 MB a task, in the JVM and again in Python."""
    before = spark.conf.get(BATCH_ROWS)
    try:
        if rows:
            spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
        yield
    finally:
        if rows:
            spark.conf.set(BATCH_ROWS, before)


def stash(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: later jobs neither recompute it nor
    depend on the executors that made it. ``rows``: how many rows go to Python at once."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with batches_of(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
