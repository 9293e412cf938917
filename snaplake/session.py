"""The session: this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows that go to a Python worker at once, where the session has Spark's default: rows here may hold long texts, and workers share an executor's memory.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Makes the package importable on executors that were started elsewhere, once for each application; keeps batches for Python workers small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="snaplake-ship-"), "snaplake.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for top, dirs, names in os.walk(here):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(top, n)
                    z.write(path, os.path.join("snaplake", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)
