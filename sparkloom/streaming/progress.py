"""Progress logs as streams: resumable ingestion, the latest row of each key, running conversation state, incremental embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON-line files of a folder, as they come."""
    return spark.readStream.schema(schema).json(path)


def append_all(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what has come since the last run, exactly once, and ends."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(rows: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """A table with the latest row of each key under ``path``/v<batch>: each batch merges into the last version.

    A batch that is run again after a failure writes the same version anew from the same one before.
    The last two versions are kept. Each batch rewrites the table, so batches should be large.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch
        if epoch:
            new = spark.read.schema(batch.schema).parquet(f"{path}/v{epoch - 1}").unionByName(batch)
        columns = F.struct(*[F.col(c) for c in batch.columns])
        new.groupBy(key).agg(F.max_by(columns, order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/v{epoch}")
        if epoch > 1:  # the version before stays, in case this batch runs again
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{epoch - 2}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _rounds(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    turns, rounds, chars = state.get if state.exists else (0, 0, 0)
    for pdf in batches:
        turns += len(pdf)
        rounds += int((pdf.role == "assistant").sum())
        chars += int(pdf.text.fillna("").str.len().sum())
    state.update((turns, rounds, chars))
    yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "rounds": [rounds], "chars": [chars]})


def conversation_state(turns: DataFrame) -> DataFrame:
    """conv_id, turns, rounds, chars so far, given out for a conversation whenever turns of it come (update mode)."""
    return turns.groupBy("conv_id").applyInPandasWithState(_rounds, "conv_id long, turns long, rounds long, chars long", "turns long, rounds long, chars long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", step: str | None = None) -> DataFrame:
    """Events by type and time window, with a bound on lateness: start, event_type, n, value."""
    w = F.window("ts", size, step) if step else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def embed_new(items: DataFrame, cache_path: str, dim: int, checkpoint: str, provider: Callable | None = None) -> StreamingQuery:
    """Embeds streamed items (key, text) whose key the cache doesn't hold, and adds them to it, a folder a batch."""
    from ..operators.vectors import cache_split, embed

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        schema = "key string, vector array<float>"
        earlier = spark.createDataFrame([], schema)
        if epoch:  # one read of all folders; the filter prunes a later one of a batch that runs again
            earlier = spark.read.schema(f"{schema}, batch long").parquet(cache_path).where(F.col("batch") < epoch).select("key", "vector")
        _, misses = cache_split(batch, earlier, dim)
        embed(misses, dim, provider).write.mode("overwrite").parquet(f"{cache_path}/batch={epoch}")

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_until_complete(run: Callable[[], None], done: Callable[[], int], total: int, tries: int = 10) -> bool:
    """Runs again while rows are missing, ``tries`` times at most; whether all are there."""
    for _ in range(tries):
        if done() >= total:
            return True
        run()
    return done() >= total
