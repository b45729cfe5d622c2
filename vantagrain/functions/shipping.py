"""What Python workers need: this package, and batches of bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
#: Rows hold whole texts; a batch of rows on its way to a worker, and what the
#: worker makes of it, should take no more than a few times this.
BATCH_BYTES = 1 << 22
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send a zip of this package to the workers, once for an application, and
    limit Arrow batches to BATCH_BYTES unless the session's limit is lower.

    Only on one machine, whose workers inherit PYTHONPATH, is nothing sent where
    that holds the package.  The zip goes through Spark's own file server, so no
    shared folder is needed.
    """
    now = spark.conf.get(_LIMIT, str(1 << 26)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    context = spark.sparkContext
    alone = context.master == "local" or context.master.startswith("local[")
    if alone and str(_PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if getattr(context, "_vantagrain_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="vantagrain-zip-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    context._vantagrain_shipped = True
