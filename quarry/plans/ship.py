"""Executors need the package: it is sent along where they cannot find it by themselves."""

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent


def _found_locally() -> bool:
    """Whether a Python started here finds the package: from this folder or through PYTHONPATH."""
    places = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    return any(Path(p, _PACKAGE.name).resolve() == _PACKAGE for p in places)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False) or context.master.startswith("local") and _found_locally():
        return
    path = Path(tempfile.mkdtemp(prefix="quarry-package-"), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(str(path))
    context._quarry_shipped = True
