"""Tables written to the folder that all executors share, to be read again."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="papyra-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read back: its lineage is cut and lost executors cost no rerun."""
    path = f"{shared_dir(df.sparkSession)}/papyra-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The table itself if it is files as they are, else written."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().strip()
    return df if plan.startswith("Relation ") and "\n" not in plan else written(df, name)


def _files(df: DataFrame):
    """Name and status of each file behind a table."""
    spark = df.sparkSession
    for f in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        yield f, path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)


def size_of(df: DataFrame) -> int:
    """Bytes of the files behind a table."""
    return sum(status.getLen() for _, status in _files(df))


def fingerprint(df: DataFrame) -> str:
    """What tells the files behind a table: their names, sizes and times of change."""
    parts = [f"{f}:{s.getLen()}:{s.getModificationTime()}" for f, s in _files(df)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()
