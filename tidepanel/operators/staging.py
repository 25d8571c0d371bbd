"""Cut a lineage where one result feeds several passes."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame

SETTING = "spark.checkpoint.dir"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def folder(spark) -> str:
    """Shared folder named by the session.  Without the setting a single-machine session gets a folder of its own; a cluster must name one."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    return _own_folder()


def materialize(df: DataFrame) -> DataFrame:
    """Write once, read as a table: later passes prune columns and survive lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tidepanel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
