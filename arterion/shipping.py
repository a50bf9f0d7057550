"""Makes the package importable on executors, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package's modules to the Spark context, once."""
    context = spark.sparkContext
    if getattr(context, "_arterion_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="arterion-")
    name = f"{folder}/arterion.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, f"{PACKAGE.name}/{path.relative_to(PACKAGE)}")
    context.addPyFile(name)
    context._arterion_shipped = True
