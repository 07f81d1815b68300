"""Session settings of the engine and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Values of an IN that Parquet's readers compare one by one, by recursion; of longer ones they look at the range only.
IN_LENGTH = 100
#: Bytes of shuffled rows, and of a file, that a task is dealt at most, where the caller doesn't say less. Rows take many times as much in a task's hash tables, and a join makes more of them.
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20, "spark.sql.files.maxPartitionBytes": 16 << 20}
#: Wrap-around integers and lenient casts; times without zone; plans that adapt to sizes at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # scans of states get the hashes of touched keys in lists of this length at most
    "spark.sql.parquet.pushdown.inFilterThreshold": str(IN_LENGTH),
    # it fails on subqueries over a table of several inserts, which is a union; columns are pruned through unions without it
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PushProjectionThroughUnion",
}


def engine_session(spark: SparkSession) -> SparkSession:
    """A session of its own over the same context, with the engine's SQL semantics; the caller's stays as it is."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold"):
        session.conf.set(key, spark.conf.get(key))
    for key, most in TASK_BYTES.items():
        session.conf.set(key, str(min(most, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))))
    for key, value in SETTINGS.items():
        session.conf.set(key, value)
    return session


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where none is set and all run on one machine (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "rivulet-shared")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/rivulet/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back, so its lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """A path and the file system that it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file of shared storage, if it is there."""
    at, files = _at(spark, path)
    files.delete(at, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of shared storage; none if there is no such folder."""
    at, files = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    at, files = _at(spark, path)
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file that is there with all of its text or not at all."""
    at, files = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not files.rename(beside, at):
        raise OSError(f"{path} can't be written")
