"""Tables written once in the cluster's shared folder and read back.

Iterative operators and operators that use one expensive result several times
cut their lineage here.  The folder is the one the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read, never a
recomputation of the whole chain.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    A local master without the setting gets a temporary folder (tests); any
    other master must name one, since executors do not share local disks.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="scorewright-")
    spark.conf.set(_SETTING, folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
