"""Tables written into the folder that driver and executors share, to cut long lineages; and the length of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of this application where it is unset and the master is local."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        place = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return place.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for files that a query writes and reads again."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of this session hold ``rows`` rows at most: rows of whole texts are long, and either side of the pipe holds batches outside the heap.

    Plans are lazy and read the setting when they run, so it stays for the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
