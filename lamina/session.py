"""Getting the package to Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless they find it on the path they share with the driver."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or spark.sparkContext.applicationId in _shipped:
        return
    with tempfile.NamedTemporaryFile(prefix="lamina-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted((ROOT / "lamina").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(f.name)
    atexit.register(lambda: Path(f.name).unlink(missing_ok=True))  # executors fetch it from here as long as the session lives
    _shipped.add(spark.sparkContext.applicationId)
