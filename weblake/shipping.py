"""Getting this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> bool:
    """Sends the package to the executors, so that their Python can import it; once an application (true the first time)."""
    if spark.sparkContext.applicationId in _shipped:
        return False
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix=f"{package.name}-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(spark.sparkContext.applicationId)
    return True


def one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, as in tests."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")
