"""Tables that one job derives once and reads several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back, so that what follows reads it
    from there as often as it needs, after the loss of an executor too.  Where that is unset
    on a single machine, as in tests, a temporary folder is used; a cluster has to name one."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """The path of a folder of its own, not made yet, where ``stored`` puts its tables."""
    global _own_folder
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own_folder = _own_folder or tempfile.mkdtemp(prefix="loomlog-")
    return f"{folder.rstrip('/')}/loomlog-{uuid.uuid4().hex}"
