"""Append-only streams: file sources, resume, last write wins, running aggregates, stopping rules, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def append(stream: DataFrame, folder: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Writes what is there and stops; a restart goes on from the checkpoint, so every record is written once."""
    return stream.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)


def resume(prompts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no record yet."""
    return prompts.join(done.select(key).distinct(), key, "left_anti")


def compact(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key; combined before the shuffle."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def _versions(spark: SparkSession, table_path: str) -> dict[int, list[int]]:
    """By bucket the versions that are there, ascending. The table has at most two of each."""
    root = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for version in store.listStatus(root) if store.exists(root) else ():
        name = version.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(version.getPath(), "_SUCCESS")
        if name.startswith("v") and store.exists(done):
            for bucket in store.listStatus(version.getPath()):
                if bucket.getPath().getName().startswith("bucket="):
                    out.setdefault(int(bucket.getPath().getName()[7:]), []).append(int(name[1:]))
    return {k: sorted(v) for k, v in out.items()}


def current(spark: SparkSession, table_path: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of a compacted table: each bucket's newest version. Without any, an empty frame of the schema."""
    paths = [f"{table_path}/v{v[-1]}/bucket={k}" for k, v in sorted(_versions(spark, table_path).items())]
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def merged(batch: DataFrame, number: int, table_path: str, keys: list[str], order: str, buckets: int = 64) -> None:
    """Merges a batch into a table of last records: only the buckets that hold its keys are written anew.

    A bucket's newest version before the batch stays, so that a batch which is tried again finds what it began with; older
    ones go.
    """
    spark = batch.sparkSession
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in batch.select(at.alias("b")).distinct().collect())  # at most so many buckets
    before = {k: [v for v in own if v < number] for k, own in _versions(spark, table_path).items() if k in touched}
    paths = [f"{table_path}/v{v[-1]}/bucket={k}" for k, v in before.items() if v]
    rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*paths)) if paths else batch
    rest = [c for c in batch.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*batch.columns)
    last.withColumn("bucket", at).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table_path}/v{number}")
    root = spark._jvm.org.apache.hadoop.fs.Path
    store = root(table_path).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, own in before.items():
        for v in own[:-1]:
            store.delete(root(f"{table_path}/v{v}/bucket={k}"), True)


def compacting(stream: DataFrame, table_path: str, checkpoint: str, key: str, order: str, buckets: int = 64) -> StreamingQuery:
    """Keeps a table of last records, to be read by current()."""

    def merge(batch: DataFrame, number: int) -> None:
        merged(batch, number, table_path, [key], order, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running(stream: DataFrame, keys: list[str], aggregates: list, table_path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """The aggregate after each trigger, in a table to be read by current(): only the groups that a trigger changes are written.

    keys are columns of the stream, or a window's name. Nothing of it is held by the driver.
    """
    return updating(stream.groupBy(*keys).agg(*aggregates), keys, table_path, checkpoint, buckets)


def updating(grouped: DataFrame, keys: list[str], table_path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """The rows of a grouped stream as they stand after each trigger."""

    def merge(batch: DataFrame, number: int) -> None:
        merged(batch.withColumn("_trigger", F.lit(number).cast("long")), number, table_path, keys, "_trigger", buckets)

    return grouped.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], aggregates: list, late: str = "1 day") -> DataFrame:
    """Extension: event-time windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(*aggregates)


def sliding(events: DataFrame, ts: str, size: str, step: str, keys: list[str], aggregates: list, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, step), *keys).agg(*aggregates)


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*aggregates)


def distinct_within(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def every(rows: DataFrame, counter: str, n: int) -> DataFrame:
    """The rows of a periodic action."""
    return rows.where(F.col(counter) % n == 0)


class Progress(StreamingQueryListener):
    """Counts rows and keeps the last rate, for estimates of the time left."""

    def __init__(self, total: int | None = None):
        self.total, self.rows, self.rate = total, 0, 0.0

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.rate = event.progress.processedRowsPerSecond or self.rate

    def seconds_left(self) -> float | None:
        return None if self.total is None or not self.rate else max(0, self.total - self.rows) / self.rate


class EarlyStop(StatefulProcessor):
    """Best score so far and strikes in a row, by run; rows of a batch are taken in step order."""

    def __init__(self, points: float, patience: int):
        self.points, self.patience = points, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stop", "best double, strikes int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, strikes = self.state.get() if self.state.exists() else (float("-inf"), 0)
        for row in pd.concat(list(rows)).sort_values("step").itertuples():
            best = max(best, row.score)
            strikes = strikes + 1 if (best - row.score) * 100 >= self.points else 0
        self.state.update((float(best), int(strikes)))
        yield pd.DataFrame({"run": [key[0]], "best": [best], "strikes": [strikes], "stopped": [strikes >= self.patience]})

    def close(self) -> None:
        pass


def early_stop(stream: DataFrame, points: float, patience: int) -> DataFrame:
    """(run, best, strikes, stopped) after each trigger, from rows (run, step, score)."""
    return stream.groupBy("run").transformWithStateInPandas(EarlyStop(points, patience), "run string, best double, strikes int, stopped boolean", "update", "none")
