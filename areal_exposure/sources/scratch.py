"""A fresh folder on the storage all executors share, for tables written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_root: list[str] = []


def shared_folder(spark: SparkSession, purpose: str = "table") -> str:
    """A new path below the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of the machine; on a cluster a folder
    that other machines cannot see would lose data, so the setting is required there.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="areal-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str = "table") -> DataFrame:
    """The same rows, read back from a written table: computed once, and safe when executors are lost.

    The schema is known, so no job looks for it in the files.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
