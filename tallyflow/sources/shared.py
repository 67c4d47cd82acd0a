"""A place that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset (tests, one machine), below a
    temporary one that goes with the process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tallyflow-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        place = f"file://{_own[0]}"
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"
