"""Sending this package to executors, and the bytes of batches that Python workers get."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a batch that goes to a Python worker, unless the session says otherwise. Spark's own bound is 10,000 rows,
#: which of long texts or of shingle sets is memory without limit, in the worker and in its executor.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that Python workers can import it.

    A session that doesn't set the bytes of Arrow batches gets BATCH_BYTES.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    if top.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="lodestrata-"), "lodestrata.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(str(archive))
    context._lodestrata_shipped = True
