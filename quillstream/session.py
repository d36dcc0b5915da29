"""Sessions: the library's own modules on the workers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Spark's setting of an Arrow batch's bytes, of which each task's JVM and Python hold some batches at once; and the most here.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have ``BATCH_BYTES`` and a row at most, or fewer if it says so."""
    now = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(BATCH).lower())
    if not now or int(now[1]) << 10 * " kmgtp".index(now[2] or " ") > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application; where it is installed, that does no harm."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def run_folder(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``, for intermediate tables.

    Where that is unset, one machine may use a temporary folder of its own; a cluster may not.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillstream-{context.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the application's own."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of the application; to be called when its results have been read.

    Results that are still to be read need them: a frame is planned on the tables that its query has written.
    """
    name = f"quillstream_{uuid.uuid4().hex}"
    folder = run_folder(spark).replace("'", "\\'")
    spark.sql(f"create database {name} location '{folder}'")  # a database that is dropped takes its folder along
    spark.sql(f"drop database {name} cascade")
