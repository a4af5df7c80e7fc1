"""Streams with keyed state against loops, restarts included."""

import os
import random
import shutil

from pyspark.sql import functions as F

from palimpsest.streaming import buffers as B
from palimpsest.streaming import streams as X


def loop(turns, most, limit):
    held, waiting, out = {}, {}, []
    for conv, turn, role, tokens, _ in sorted(turns):
        if role == "user":
            waiting[conv] = (turn, tokens)
        elif role == "assistant" and conv in waiting:
            first, n = waiting.pop(conv)
            buffer = held.setdefault(conv, [])
            buffer.append((first, n + tokens))
            dropped = [e[0] for e in buffer[:-most]]
            del buffer[:-most]
            popped = []
            if sum(e[1] for e in buffer) > limit:
                n = max(1, len(buffer) // 2)
                popped, buffer[:] = buffer[:n], buffer[n:]
            out.append((conv, first, [e[0] for e in buffer], sum(e[1] for e in buffer), dropped, [e[0] for e in popped]))
    return sorted(out)


def test_buffers_pop_their_oldest_half(spark, tmp_path):
    rng = random.Random(2)
    turns = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.randint(1, 60), f"t{t}") for c in range(5) for t in range(60)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, tokens long, text string")
    folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/checkpoint"
    got = []
    # two runs with one checkpoint, the second after a restart with what came since
    for k, part in enumerate((df.where("turn < 33"), df.where("turn >= 33"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        os.makedirs(folder, exist_ok=True)
        for name in os.listdir(f"{tmp_path}/part{k}"):
            if name.endswith(".parquet"):
                shutil.copy(f"{tmp_path}/part{k}/{name}", f"{folder}/{k}-{name}")
        stream = B.conversation_buffers(X.file_stream(spark, folder, df), most=5, limit=250)
        got += B.run_appended(stream, str(tmp_path), checkpoint).collect()
    want = loop(turns, 5, 250)
    assert sorted((r.conv_id, r.turn if r.held else r.popped[-1], r.held, r.tokens, r.dropped, r.popped) for r in got) == want
    assert any(w[5] for w in want) and any(w[4] for w in want)


def test_contents_are_ingested_once_and_the_store_is_read_once(spark, tmp_path):
    store, moved, checkpoint, folder = (f"{tmp_path}/{n}" for n in ("store", "moved", "checkpoint", "in"))
    schema = "id long, content string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(store)
    first = spark.createDataFrame([(10, "b"), (11, "c"), (12, "c"), (13, "d")], schema)
    first.coalesce(1).write.parquet(folder)
    stream = X.file_stream(spark, folder, first)
    B.ingest_keyed(stream, store, checkpoint, "content", "id", buckets=3)
    read = lambda: sorted(tuple(r) for r in spark.read.option("recursiveFileLookup", True).parquet(store).select("id", "content").collect())
    assert read() == [(1, "a"), (2, "b"), (11, "c"), (13, "d")]
    # later batches know the contents from their state: the store is another, of one unknown row
    shutil.move(store, moved)
    spark.createDataFrame([(99, "z")], schema).write.parquet(store)
    spark.createDataFrame([(20, "a"), (21, "c"), (22, "e"), (23, "z")], schema).coalesce(1).write.mode("append").parquet(folder)
    B.ingest_keyed(X.file_stream(spark, folder, first), store, checkpoint, "content", "id", buckets=3)
    assert read() == [(22, "e"), (23, "z"), (99, "z")]
    B.ingest_keyed(X.file_stream(spark, folder, first), store, checkpoint, "content", "id", buckets=3)
    assert read() == [(22, "e"), (23, "z"), (99, "z")]


def test_calendar_frequency_takes_events_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 4), 1_700_000_000_000_000 + rng.randint(0, 90 * 86_400_000_000)) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, m long").select("event_id", "user_id", F.timestamp_micros("m").alias("ts"))
    want = {}
    for u in range(5):
        days = [m // 86_400_000_000 for _, user, m in rows if user == u]
        want[u] = (sum(2 ** (-(max(days) - d) / 30) for d in days), len(days))
    for seed in (1, 2):
        folder = f"{tmp_path}/in{seed}"
        df.orderBy(F.rand(seed)).repartition(4).write.parquet(folder)
        out = X.run_available(X.calendar_frequency(X.file_stream(spark, folder, df)), "update", str(tmp_path), ["user_id"], "deliveries")
        assert {r.user_id: (round(r.frequency, 9), r.deliveries) for r in out.collect()} == {u: (round(f, 9), n) for u, (f, n) in want.items()}
