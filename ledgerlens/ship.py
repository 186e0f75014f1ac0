"""The package's own code for the Python workers, as `--py-files` would send it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import ledgerlens

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the files that Spark hands to every executor, once for a session."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(ledgerlens.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="ledgerlens-")) / "ledgerlens.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for path in sorted(root.rglob("*.py")):
            packed.write(path, Path("ledgerlens") / path.relative_to(root))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)
