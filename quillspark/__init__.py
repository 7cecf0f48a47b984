"""quillspark: queries over collections of Markdown notes, as Spark DataFrames."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to the session's Python workers, once for each application.

    Needed where the package is imported from a source tree that the executors lack.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))  # whole texts can be long: Arrow batches by size, not by rows alone
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(suffix=".zip", prefix=f"{root.name}-")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(path)
        atexit.register(Path(path).unlink, missing_ok=True)
    return spark
