"""Structured Streaming forms of operators whose state grows with events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, folder: str, like: DataFrame, files: int | None = 1) -> DataFrame:
    """The rows of a folder's files, so many files in a micro-batch; with None, all that there are when it starts.

    Where the order of rows matters, that of the files shouldn't: files come by their time, whatever rows they have."""
    stream = spark.readStream.schema(like.schema)
    return (stream if files is None else stream.option("maxFilesPerTrigger", files)).parquet(folder)


def delivery_frequency(events: DataFrame, half_life: float = 30.0) -> DataFrame:
    """Per record: decayed frequency and last delivery, as of each batch, by whole days between two deliveries.

    A batch's events of a record are added in closed form.  This rule depends on the order: an event earlier than the state's last one is
    counted without decay, as it can't be put in its place (``calendar_frequency`` takes events in any order)."""
    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frequency, last, n = state.get if state.exists else (0.0, 0, 0)
        micros = np.sort(np.concatenate([p.micros.to_numpy() for p in pdfs]))
        so_far = np.maximum.accumulate(np.append(last if n else micros[0], micros))
        days = np.maximum(0, micros - so_far[:-1]) // 86_400_000_000
        passed = np.cumsum(days)
        frequency = frequency * 2.0 ** (-passed[-1] / half_life) + (2.0 ** ((passed - passed[-1]) / half_life)).sum()
        last, n = int(so_far[-1]), n + len(micros)
        state.update((float(frequency), last, n))
        yield pd.DataFrame({"user_id": [key[0]], "frequency": [frequency], "last_micros": [last], "deliveries": [n]})

    rows = events.select("user_id", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, frequency double, last_micros long, deliveries long", "frequency double, last_micros long, n long", "update", GroupStateTimeout.NoTimeout
    )


def calendar_frequency(events: DataFrame, half_life: float = 30.0, epoch: str = "2020-01-01") -> DataFrame:
    """Per record: decayed frequency at its last delivery, and deliveries, with days counted by the calendar (UTC).

    The sum of 2^(day / half-life) since ``epoch`` takes events in any order and however late, and merges; it is brought to the last day when read.  It
    differs from ``delivery_frequency`` by what whole days between two deliveries leave out: a day of decay for a delivery at most.
    The sum is a double, so days from some 1,000 half-lives before the epoch to as many after it are told apart.
    """
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    since = day - F.floor(F.unix_micros(F.lit(epoch).cast("timestamp")) / 86_400_000_000)
    sums = events.groupBy("user_id").agg(F.sum(F.pow(F.lit(2.0), since / half_life)).alias("_s"), F.max(since).alias("_d"), F.max("ts").alias("last_ts"), F.count("*").alias("deliveries"))
    return sums.select("user_id", (F.col("_s") / F.pow(F.lit(2.0), F.col("_d") / half_life)).alias("frequency"), "last_ts", "deliveries")


def counted_by_window(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events and sum of values by kind and tumbling window."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events that follow each other within ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_by_content(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first row of each content within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, mode: str, folder: str, keys: list[str] | None = None, latest: str | None = None) -> DataFrame:
    """All that is available now, through Parquet files in a new folder of ``folder``.

    A complete result is the last batch; of an update, the row of each of ``keys`` with the greatest ``latest``.  A batch that
    runs again overwrites its own files.
    """
    spark = stream.sparkSession
    base = f"{folder}/stream-{uuid.uuid4().hex}"
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        written.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    if not keys:
        return spark.read.schema(stream.schema).parquet(f"{base}/out/batch={written[-1]}")
    rows = spark.read.schema(stream.schema).parquet(*[f"{base}/out/batch={n}" for n in sorted(set(written))])
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), latest).alias("_r")).select(*keys, "_r.*")
