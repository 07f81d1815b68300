"""Structured Streaming around step(): each micro-batch of files is a change of a table.

The trigger's checkpoint remembers which files were taken; the views' home holds the states
and, in its manifest, the number of the last batch that they have. A driver that takes over
goes on from both. A batch that was cut off before its states stood is taken again from the
states before it; one whose states stand is not taken again, and its changes are given to
the sink once more under the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators import zset
from rivulet.operators.incremental import Views
from rivulet.session import list_names, shared_path


def run_files(spark: SparkSession, views: Views, table: str, path: str, schema: T.StructType, sink: Callable[[int, dict[str, DataFrame]], None], checkpoint: str | None = None, files_a_step: int = 1, timeout: int | None = None, forget: bool = False) -> int:
    """Feeds the Parquet files under path to views as changes of table (weights in __w, or insertions); sink gets each step's number and view changes. Returns the number of steps, once all files are taken; after timeout seconds, if given, the stream is stopped and TimeoutError raised.

    A sink that writes by number has each change once, whatever fails. With forget the
    files of a change are deleted after the step that follows it: the sink keeps what it
    needs. A checkpoint that has taken batches goes only with the states that they made.
    """
    if checkpoint and list_names(spark, f"{checkpoint.rstrip('/')}/commits") and not views.steps:
        raise ValueError(f"{checkpoint} has taken files whose states aren't in {views.store.home}")
    done: list[int] = []
    last: dict[str, DataFrame] = {}

    def batch(df: DataFrame, number: int) -> None:
        out = views.step({table: zset.weighted(df)}, number)
        if forget and last:
            views.forget(last)
        last.clear()
        last.update(out)
        sink(number, out)
        done.append(number)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_step).parquet(path)
    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or shared_path(spark, "stream")).trigger(availableNow=True).start()
    if query.awaitTermination(timeout) is False:
        query.stop()
        raise TimeoutError(f"{len(done)} steps were done in {timeout} s, and files are left")
    if query.exception():
        raise query.exception()
    return len(done)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """ts as a TIMESTAMP, which watermarks and windows of streams need; values are taken as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumble(df: DataFrame, ts: str, size: str, *keys: str) -> DataFrame:
    """Rows with w, the window of fixed size that holds ts."""
    return df.withColumn("w", F.window(F.col(ts), size)).select(*keys, "w", *[c for c in df.columns if c not in keys])


def watched(df: DataFrame, ts: str, late: str, aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any aggregate over a stream's event times, with what comes later than late dropped. aggregate groups by a window of ts, or by ts itself."""
    return aggregate(event_time(df, ts).withWatermark(ts, late))


def windowed_counts(df: DataFrame, ts: str, size: str, late: str, slide: str | None = None, *keys: str) -> DataFrame:
    """Counts by event-time window on a stream; rows later than late are dropped."""
    return event_time(df, ts).withWatermark(ts, late).groupBy(F.window(ts, size, slide), *keys).agg(F.count("*").alias("n"))
