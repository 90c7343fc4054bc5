"""Session settings the library relies on, and the way it cuts lineage."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings; none of them changes what a cluster operator tunes (memory, cores,
# shuffle partitions).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Repeated keys in JSON-LD: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Pages can be large: an Arrow batch holds few of them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names (``spark.checkpoint.dir``).

    Only a session that runs in one process on one machine (``local[n]``), as in tests, gets
    a folder of its own when none is named; a cluster must name one that all its machines see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir names no shared folder; {master} needs one")
        named = tempfile.mkdtemp(prefix="gleanframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers of a session that was started without it.

    Not needed where the package is installed on the workers or on their ``PYTHONPATH``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="gleanframe-")  # on the driver, which hands the file out
    archive = shutil.make_archive(os.path.join(folder, "gleanframe"), "zip", root, "gleanframe")
    spark.sparkContext.addPyFile(archive)


def durable(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: lineage ends here.

    Lost executors lose nothing, later steps read only the columns they need, and the
    planner knows the real size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/gleanframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
