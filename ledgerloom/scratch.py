"""Tables and files written between steps, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: what `folder` has named in this process
_WRITTEN: dict[str, None] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only on one machine, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _WRITTEN[path] = None
    return path


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it back."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes all that stands in folders of `folder`; for callers who have read their results to the end."""
    for name in list(_WRITTEN):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.pop(name)
