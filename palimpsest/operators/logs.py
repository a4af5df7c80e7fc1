"""Append-only logs: latest versions, tombstones, sessions, current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that comes last in ``order``.  An aggregate, so partial results are combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    top = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_top")
    return log.groupBy(*keys).agg(top).select(*keys, *[F.col("_top").getField(c).alias(c) for c in rest])


def collapse_retries(turns: DataFrame, session: str, order: str, images: str | None = None) -> DataFrame:
    """Drop a user turn that the next turn, a user's too, repeats, with as many images."""
    w = Window.partitionBy(session).orderBy(order)
    again = (F.col("role") == "user") & (F.lead("role").over(w) == "user") & (F.lead("text").over(w) == F.col("text"))
    again = again & (F.lead(images).over(w) == F.col(images)) if images else again
    return turns.withColumn("_again", F.coalesce(again, F.lit(False))).where("NOT _again").drop("_again")


def newest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def list_sessions(turns: DataFrame, session: str, order: str) -> DataFrame:
    """Turn counts, user turns and last turn of each session."""
    user = F.sum(F.when(F.col("role") == "user", 1).otherwise(0))
    return turns.groupBy(session).agg(F.count("*").alias("turns"), user.alias("user_turns"), F.max(order).alias("last_turn"))


def resolved_ids(log: DataFrame, id_: str, original: str, resolved: Column) -> DataFrame:
    """Ids that are resolved by their own flag or that a later record points at."""
    own = log.where(resolved).select(F.col(id_).alias("id"))
    pointed = log.where(F.col(original).isNotNull()).select(F.col(original).alias("id"))
    return own.union(pointed).distinct()


def current_state(
    log: DataFrame, user: str, category: str, multi: tuple[str, ...], exempt: tuple[str, ...], as_of: Column, stale_days: int = 7, most: int = 5
) -> DataFrame:
    """Live records of each user: the newest of a single category, the newest ``most`` of a
    multiple one; tombstoned and stale ones are out (``exempt`` categories never go stale)."""
    fresh = F.col(category).isin(*exempt) | (F.unix_micros(as_of) - F.unix_micros("ts") <= stale_days * 86_400_000_000)
    gone = resolved_ids(log, "event_id", "original_id", F.col("resolved"))
    live = log.join(gone.withColumnRenamed("id", "event_id"), "event_id", "left_anti").where(fresh)
    w = Window.partitionBy(user, category).orderBy(F.desc("ts"), F.desc("event_id"))
    limit = F.when(F.col(category).isin(*multi), most).otherwise(1)
    return live.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def orphan_sessions(turns: DataFrame, session: str) -> DataFrame:
    """Sessions without a user's turn."""
    counts = turns.groupBy(session).pivot("role", ["user", "assistant"]).agg(F.count(F.lit(1)))
    counts = counts.select(session, F.coalesce("user", F.lit(0)).alias("user_turns"), F.coalesce("assistant", F.lit(0)).alias("assistant_turns"))
    return counts.where("user_turns = 0")


def sliced(rows: DataFrame, order: str, slices: int = 256) -> DataFrame:
    """``rows`` with ``_slice``, which rises with ``order``: slices are cut at quantiles, so a window over a key and a slice holds a small part of a key
    however large it is."""
    edges = rows.agg(F.percentile_approx(order, [k / slices for k in range(1, slices)], 10 * slices)).first()[0] or []
    cuts = F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast(f"array<{dict(rows.dtypes)[order]}>")
    return rows.withColumn("_slice", F.size(F.filter(cuts, lambda e: e <= F.col(order))))


def ranked(rows: DataFrame, key: str, order: str, name: str, slices: int = 256) -> DataFrame:
    """``rows`` with their number (from 1) in the order of their key, and ``_slice``.  Only counts by key and slice are summed up in order."""
    cut = sliced(rows, order, slices)
    counts = cut.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(order))
    return cut.join(counts, [key, "_slice"]).withColumn(name, F.col("_before") + place).drop("_before")


def increasing_times(rows: DataFrame, key: str, order: str, micros: Column, unit: int = 1) -> DataFrame:
    """Strictly increasing times of a burst: each is the later of its own and the last one plus ``unit``.

    In closed form: with a row's number i, its time is i * unit plus the greatest (time - number * unit) so far: within
    its slice by a window, before it by the slices' own greatest ones.
    """
    rows = ranked(rows.withColumn("_m", micros), key, order, "_i").withColumn("_m", F.col("_m") - F.col("_i") * unit)
    w = Window.partitionBy(key, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tops = rows.groupBy(key, "_slice").agg(F.max("_m").alias("_t"))
    earlier = F.max("_t").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(key, "_slice", earlier.alias("_earlier"))
    rows = rows.withColumn("_top", F.max("_m").over(w)).join(tops, [key, "_slice"])
    return rows.withColumn("stamped", F.greatest("_top", "_earlier") + F.col("_i") * unit).drop("_i", "_m", "_top", "_earlier", "_slice")


def exchange_pairs(turns: DataFrame, session: str, order: str) -> DataFrame:
    """Every user turn with the reply that follows it, or null if none does."""
    w = Window.partitionBy(session).orderBy(order)
    answered = F.when(F.lead("role").over(w) == "assistant", F.lead(order).over(w))
    return turns.withColumn("reply", answered).where("role = 'user'").select(session, order, "reply")


def buffered_tokens(turns: DataFrame, session: str, order: str, tokens: Column, limit: int, most: int) -> DataFrame:
    """The newest turns of each session that fit ``limit`` tokens, ``most`` at most."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    sums = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = turns.withColumn("tokens", tokens).withColumn("running", sums).withColumn("_n", F.row_number().over(w))
    return rows.where((F.col("running") <= limit) & (F.col("_n") <= most)).drop("_n")
