"""Session helpers: a local session, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{_ROOT.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(_ROOT.rglob("*.py")):
            archive.write(path, path.relative_to(_ROOT.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("LOCAL_DRIVER_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark
