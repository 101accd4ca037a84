"""The running behaviours of the data plane, on Structured Streaming.

State is keyed and checkpointed in the shared folder, so a stream continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.storage import new_path


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's file or folder as a stream, with the schema that it has."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and return what it wrote."""
    spark = stream.sparkSession
    out, marks = new_path(spark, "stream"), new_path(spark, "stream_state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    else:  # each batch is the whole or the changed result; the last one stands
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
            .option("checkpointLocation", marks).trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def running_dedup(stream: DataFrame, *keys: str, time: str | None = None, within: str = "30 days") -> DataFrame:
    """The first row of each key.  With an event time, keys are forgotten after ``within``, so the state is bounded."""
    if time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def tumbling_counts(stream: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    """Counts by window and keys."""
    return stream.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def diversity_cap(stream: DataFrame, key: str, bucket: str, order: str, cap: float, warm_up: int) -> DataFrame:
    """(key, order, bucket) of rows accepted while no bucket takes more than ``cap`` of its key's accepted rows.

    After ``warm_up`` accepted rows, a row is accepted if (n_bucket + 1) / (n + 1) <= cap.  The rule is
    sequential within a key; rows of a key are taken in ``order`` within each batch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def accept(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = dict(zip(*state.get, strict=True)) if state.exists else {}
        total, kept = sum(counts.values()), []
        for r in pd.concat(list(frames)).sort_values(order).itertuples(index=False):
            b = str(getattr(r, bucket))
            if total < warm_up or (counts.get(b, 0) + 1) / (total + 1) <= cap:
                counts[b], total = counts.get(b, 0) + 1, total + 1
                kept.append((k[0], getattr(r, order), getattr(r, bucket)))
        state.update((list(counts), list(counts.values())))
        yield pd.DataFrame(kept, columns=[key, order, bucket])

    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{bucket}` {kinds[bucket]}"
    rows = stream.select(key, order, bucket)
    return rows.groupBy(key).applyInPandasWithState(accept, schema, "buckets array<string>, n array<long>", "append", GroupStateTimeout.NoTimeout)
