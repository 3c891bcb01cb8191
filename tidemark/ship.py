"""Make this package importable on executors."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application; Python workers import it by name."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).parent
        tmp = tempfile.TemporaryDirectory(prefix="tidemark-ship-")
        atexit.register(tmp.cleanup)  # the driver serves the file while the application runs
        name = Path(tmp.name, f"{root.name}.zip")
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(name))
        _shipped.add(app)
    return spark
