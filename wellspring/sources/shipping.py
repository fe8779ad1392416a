"""Send this package to the executors."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


@functools.cache
def archive() -> str:
    """The package's sources in a zip file on the driver."""
    path = Path(tempfile.mkdtemp(prefix="wellspring-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    return str(path)


@functools.cache
def _ship(application: str, spark: SparkSession) -> None:
    spark.sparkContext.addPyFile(archive())


def ship(spark: SparkSession) -> SparkSession:
    """Python functions then import the package on any executor, installed there or not."""
    _ship(spark.sparkContext.applicationId, spark)
    return spark
