"""Makes this package importable in the Python workers of any cluster, and keeps their batches small."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import weakref

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: Rows and bytes of a batch that a worker gets at once: texts are long, and a worker holds a batch several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

_done: weakref.WeakSet[SparkContext] = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark once per context; Spark's own file service brings it to the executors.

    The session's batches are made smaller, if they are larger than ``BATCH``.
    """
    for key, most in BATCH.items():
        now = spark.conf.get(key).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if context in _done:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    folder = tempfile.mkdtemp(prefix="code-")  # of the driver alone, which hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    base = os.path.join(folder, f"{name}-code")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), name))
    _done.add(context)
