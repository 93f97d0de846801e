"""Intermediate tables, written into a folder that all machines share and read back."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of parked tables that this process wrote.
_PARKED: list[str] = []


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lintlake-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share; where none is set, and all is on one machine (tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = _own_dir()
    return at.rstrip("/")


def park(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/lintlake-{uuid.uuid4().hex}"
    _PARKED.append(folder)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def parked() -> int:
    """How many folders of parked tables there are: a mark for drop_parked."""
    return len(_PARKED)


def drop_parked(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables parked since a mark, but for the newest `keep`; to be called once what reads them is written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in _PARKED[since : len(_PARKED) - keep]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    del _PARKED[since : len(_PARKED) - keep]
