"""Keyed state that Structured Streaming keeps in RocksDB: conversation buffers, and contents that a store has."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class on_disk:
    """While a query starts: state is kept in RocksDB, which typed state needs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_):
        self.spark.conf.set(PROVIDER, self.before)


class ConversationBuffer(StatefulProcessor):
    """The newest exchanges of each conversation of a bucket.

    A user's turn waits for the reply that follows it; a reply completes an exchange.  Beyond ``most`` exchanges the oldest one is dropped.  When the
    buffer holds more than ``limit`` tokens, its oldest half (one at least) is popped, for a summary of the caller's making.  An exchange lacks a text or
    tokens, if one of its turns does; then it adds none.

    A conversation is an entry of its bucket's map: a batch asks for those of its own conversations, each once, and nothing if the bucket is new.
    """

    def __init__(self, most: int, limit: int, ttl_ms: int | None):
        self.most, self.limit, self.ttl_ms = most, limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = {} if self.ttl_ms is None else {"ttlDurationMs": self.ttl_ms}
        self.buffers = handle.getMapState("buffers", "conv_id long", "turns array<long>, tokens array<long>, texts array<string>, waiting boolean, turn long, n long, asked string", **kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat([r for r in rows if len(r)])[["conv_id", "turn", "role", "tokens", "text"]]
        new = new.astype(object).where(new.notna(), None)
        known = self.buffers.exists()
        out = []
        turns = sorted(zip(*(new[c].tolist() for c in new.columns)), key=itemgetter(0, 1))
        for conv, own in groupby(turns, itemgetter(0)):
            there = known and self.buffers.containsKey((conv,))
            held, waiting = self.held(conv) if there else ([], None)
            for _, turn, role, tokens, text in own:
                if role == "user":
                    waiting = (turn, None if tokens is None else int(tokens), text)
                elif role == "assistant" and waiting is not None:
                    first, n, asked = waiting
                    held.append((first, None if n is None or tokens is None else n + int(tokens), None if asked is None or text is None else f"{asked}\n{text}"))
                    waiting = None
                    dropped = [e[0] for e in held[: -self.most]]
                    held = held[-self.most :]
                    popped = held[: max(1, len(held) // 2)] if sum(e[1] or 0 for e in held) > self.limit else []
                    held = held[len(popped) :]
                    told = "\n".join(e[2] for e in popped if e[2] is not None)
                    out.append((conv, held[-1][0] if held else popped[-1][0], [e[0] for e in held], sum(e[1] or 0 for e in held), dropped, [e[0] for e in popped], told))
            if held or waiting is not None:
                self.buffers.updateValue((conv,), (*([e[k] for e in held] for k in range(3)), waiting is not None, *(waiting or (None, None, None))))
            elif there:
                self.buffers.removeKey((conv,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "held", "tokens", "dropped", "popped", "popped_text"])

    def held(self, conv: int) -> tuple[list, tuple | None]:
        turns, tokens, texts, waits, *waiting = self.buffers.getValue((conv,))
        return list(zip(turns, tokens, texts)), tuple(waiting) if waits else None

    def close(self) -> None:
        pass


BUFFERED = "conv_id long, turn long, held array<long>, tokens long, dropped array<long>, popped array<long>, popped_text string"


def conversation_buffers(turns: DataFrame, most: int = 20, limit: int = 1500, ttl_ms: int | None = None, buckets: int = 1024) -> DataFrame:
    """For each exchange of a stream of turns (conv_id, turn, role, tokens, text): the turns that the buffer holds after it and their tokens, those
    dropped, and those popped with their text.  With ``ttl_ms`` a conversation that stays silent as long is forgotten.

    Turns of a micro-batch are taken by number; a turn that comes in a later batch than its successor is taken when it comes.  Turns without a number
    or a conversation have no place and are left out.  Conversations are dealt to ``buckets`` by hash: what it costs to hand a group to Python and its
    rows back is then paid for a bucket, not for each conversation.
    """
    processor = ConversationBuffer(most, limit, ttl_ms)
    placed = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "tokens", "text")
    return placed.withColumn("_bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets))).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=BUFFERED, outputMode="append", timeMode="None" if ttl_ms is None else "processingTime"
    )


class KnownContents(StatefulProcessor):
    """The contents of a bucket that the store has; gives the first row of each that it hasn't."""

    def __init__(self, key: str, id_: str, columns: list[str]):
        self.key, self.id_, self.columns = key, id_, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "content string", "there boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for content in initialState[self.key]:
            self.known.updateValue((content,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat([r for r in rows if len(r)]).sort_values(self.id_).drop_duplicates(self.key)
        fresh = [not self.known.containsKey((content,)) for content in new[self.key]]
        new = new[fresh]
        for content in new[self.key]:
            self.known.updateValue((content,), (True,))
        yield new[self.columns]

    def close(self) -> None:
        pass


def ingest_keyed(stream: DataFrame, store: str, checkpoint: str, key: str, id_: str, buckets: int = 4096) -> None:
    """Append what is available now to a store (a folder of Parquet files), each content once: what the store has, or what came before, isn't written.

    Which contents are known is keyed state, a map for each of ``buckets`` hashes of them.  Only the first run with a checkpoint reads the store's
    contents, to fill it; a micro-batch then asks for its own contents alone, however large the store is.  A batch that runs again after a failure
    finds the state as it was before it and overwrites its own files.  The checkpoint belongs to one store.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    rows = stream.withColumn("_bucket", bucket)
    known = spark.read.option("recursiveFileLookup", True).parquet(store).select(F.col(key), bucket.alias("_bucket")).groupBy("_bucket")
    new = rows.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=KnownContents(key, id_, stream.columns), outputStructType=stream.schema, outputMode="append", timeMode="None", initialState=known
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    with on_disk(spark):
        query = new.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def run_appended(stream: DataFrame, folder: str, checkpoint: str | None = None) -> DataFrame:
    """All rows that an appending query with typed state gives now, through Parquet files; a batch that runs again overwrites its own."""
    spark = stream.sparkSession
    base = f"{folder}/stream-{uuid.uuid4().hex}"
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        numbers.append(number)

    with on_disk(spark):
        query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/{n}" for n in sorted(set(numbers))])
