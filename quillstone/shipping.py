"""Ship this package to the executors, for sessions whose Python workers can't import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the Python path of the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    home = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="quillstone-")) / "quillstone.zip"
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(home.rglob("*.py")):
            archive.write(source, source.relative_to(home.parent))
    context.addPyFile(str(packed))
    _SENT.add(context.applicationId)
