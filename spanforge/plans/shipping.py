"""The package itself for the executors, where they cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package along, once an application, unless PYTHONPATH, which executors are given too, has its folder."""
    app = spark.sparkContext.applicationId
    on_path = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _shipped or _ROOT in on_path:
        return
    _shipped.add(app)
    name = Path(tempfile.mkdtemp(prefix="spanforge-")) / "spanforge.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted((_ROOT / "spanforge").rglob("*.py")):
            archive.write(source, source.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(name))
