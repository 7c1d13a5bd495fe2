"""Sends this package to the executors, whose Python path may not have it, and bounds what goes to Python at once."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a batch between the JVM and a Python worker; both sides hold a few of them for each task.
BATCH_BYTES = "8m"
_done: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each SparkContext."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context not in _done:
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="package-")) / f"{here.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        context.addPyFile(str(target))
        _done.add(context)
    return spark
