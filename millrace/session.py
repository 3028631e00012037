"""The session that the engine expects."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings whose default would change results: names are case-sensitive, times are UTC.
SETTINGS = {"spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; sizes such as shuffle partitions are the cluster's."""
    builder = SparkSession.builder.config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; machines that have it need not be told."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    # Spark's file server reads the archive whenever an executor asks, so it stays as long as the driver
    path = f"{tempfile.mkdtemp(prefix='millrace-code-')}/{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see (``spark.checkpoint.dir``).

    Where none is named, on one machine, a temporary one is made for the session; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
