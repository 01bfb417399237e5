"""The package on the executors, however the session was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for a context.

    Python workers find it where the driver's path reaches them; on other
    machines, or from another folder, it comes as an archive that Spark sends.
    """
    context = spark.sparkContext
    if getattr(context, "_lexiarc_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lexiarc-")) / "lexiarc.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, Path(package.name) / path.relative_to(package))
    context.addPyFile(str(archive))
    context._lexiarc_shipped = True
