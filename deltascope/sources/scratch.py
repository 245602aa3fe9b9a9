"""A shared place for what a query writes on its way: ``spark.checkpoint.dir``, or a local folder in tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: The folder of each application and place.
_own: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which goes when the application ends."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    key = (spark.sparkContext.applicationId, place or "")
    if key not in _own:
        if not place:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            place = "file://" + tempfile.mkdtemp(prefix="deltascope-")
        _own[key] = f"{place.rstrip('/')}/deltascope-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(_own[key])
        system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
    return f"{_own[key]}/{name}-{uuid.uuid4().hex}"
