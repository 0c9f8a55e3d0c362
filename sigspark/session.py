"""Makes this package importable in the Python workers of any session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the session's executors once (Spark's own file server; no shared folder needed)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="sigspark-pkg-")  # Spark reads it as long as the session lives
        path = os.path.join(folder, f"sigspark_{uuid.uuid4().hex[:12]}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
