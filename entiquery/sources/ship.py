"""Send this package to the executors, for sessions that were not started with it on their Python path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Once for each Spark context; nothing to do if the package itself came in an archive."""
    sc = spark.sparkContext
    if getattr(sc, "_entiquery_sent", False) or not PACKAGE.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="entiquery-code-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, str(file.relative_to(PACKAGE.parent)))
    sc.addPyFile(str(path))
    sc._entiquery_sent = True
