"""Decayed activation, heat and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import age_days, halved

# Half-lives in days; types that don't decay have none.
HALF_LIVES = {"profile": None, "reference": None, "ingested": None, "conversation": 15.0, "journal": 15.0, "session": 15.0, "decision": 15.0, "reflection": 122.0}
DEFAULT_HALF_LIFE = 52.0
HOT, WARM, CEILING = 0.5, 0.2, 10.0
RANKS = {"cold": 0, "warm": 1, "hot": 2}


def accumulated_frequency(deliveries: DataFrame, key: str, half_life: float = 30.0) -> DataFrame:
    """f = f * 2^(-days / h) + 1 over each record's deliveries, with whole days between two.

    In closed form: with D the running sum of whole-day gaps, f at the last delivery is the
    sum of 2^(-(D_last - D_i) / h).
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.floor((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 86_400_000_000)
    rows = deliveries.withColumn("_gap", F.coalesce(gap, F.lit(0)))
    rows = rows.withColumn("_d", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    every = Window.partitionBy(key)
    rows = rows.withColumn("_last", F.max("_d").over(every))
    return rows.groupBy(key).agg(
        F.sum(halved(F.col("_last") - F.col("_d"), half_life)).alias("frequency"), F.max("ts").alias("last_ts"), F.count("*").alias("deliveries")
    )


def recency(ts: Column, kind: Column, as_of: Column) -> Column:
    days = age_days(ts, as_of)
    out = F.when(ts.isNull(), 0.0)
    for name, half_life in HALF_LIVES.items():
        out = out.when(kind == name, F.lit(1.0) if half_life is None else halved(days, half_life))
    return out.otherwise(halved(days, DEFAULT_HALF_LIFE))


def heat(recent: Column, frequency: Column) -> Column:
    return recent * 0.625 + F.least(frequency * recent / CEILING, F.lit(1.0)) * 0.375


# Importance of kinds in the old model of heat.
OLD_IMPORTANCE = {"profile": 1.0, "state": 0.9, "reflection": 0.7, "journal": 0.6, "conversation": 0.4, "ingested": 0.3}


def old_heat(recent: Column, deliveries: Column, kind: Column) -> Column:
    """The old model: recency, the raw count of deliveries, and the importance of the kind."""
    importance = F.when(F.lit(False), 0.0)
    for name, value in OLD_IMPORTANCE.items():
        importance = importance.when(kind == name, value)
    return recent * 0.5 + F.least(deliveries / CEILING, F.lit(1.0)) * 0.3 + importance.otherwise(0.5) * 0.2


def settled_heat(heat_: Column, kind: Column) -> Column:
    """Profile and state records are hot at least."""
    return F.when(kind.isin("profile", "state"), F.greatest(heat_, F.lit(HOT))).otherwise(heat_)


def tier(heat_: Column, kind: Column) -> Column:
    return F.when(kind.isin("profile", "state") | (heat_ >= HOT), "hot").when(heat_ >= WARM, "warm").otherwise("cold")


def tier_rank(name: Column) -> Column:
    return F.when(name == "hot", 2).when(name == "warm", 1).otherwise(0)


def source_bound(tiers: DataFrame, edges: DataFrame) -> DataFrame:
    """Derived records are no hotter than their hottest source in ``tiers`` (id, tier);
    without any known source they are cold.  ``edges`` has derived and source."""
    sources = tiers.select(F.col("id").alias("source"), tier_rank(F.col("tier")).alias("_rank"))
    bound = edges.join(sources, "source", "left").groupBy(F.col("derived").alias("id")).agg(F.coalesce(F.max("_rank"), F.lit(0)).alias("bound"))
    names = F.array(*[F.lit(t) for t in RANKS])
    rows = tiers.join(bound, "id", "left")
    least = F.least(tier_rank(F.col("tier")), F.coalesce("bound", F.lit(2)))
    return rows.withColumn("tier", F.element_at(names, least + 1)).drop("bound")


def nightly_run(store: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """What a run gives each record: id, kind, old_tier, old_heat, tier, heat and ``written``.

    ``store``: id, kind, created, last_retrieved, frequency, tier, heat_score.  A record's age counts from its last delivery, or else its creation; a missing
    frequency is 0, a missing tier hot; a stored heat that is missing or 0 reads as 1.  Derived records (kind reflection) are bound by their sources' tiers
    *before* the run, all by the same snapshot (``edges``: derived, source).  A record is written when its tier changes or its heat moves by over 0.01.
    """
    recent = recency(F.coalesce("last_retrieved", "created"), F.col("kind"), as_of)
    hot = settled_heat(heat(recent, F.coalesce("frequency", F.lit(0.0))), F.col("kind"))
    old_heat = F.when(F.coalesce("heat_score", F.lit(0.0)) == 0, 1.0).otherwise(F.col("heat_score"))
    rows = store.select("id", "kind", F.coalesce("tier", F.lit("hot")).alias("old_tier"), old_heat.alias("old_heat"), hot.alias("heat")).withColumn("tier", tier(F.col("heat"), F.col("kind")))
    sources = rows.select(F.col("id").alias("source"), tier_rank(F.col("old_tier")).alias("_rank"))
    bound = edges.join(sources, "source", "left").groupBy(F.col("derived").alias("id")).agg(F.coalesce(F.max("_rank"), F.lit(0)).alias("_bound"))
    names = F.array(*[F.lit(t) for t in RANKS])
    bound = rows.where("kind = 'reflection'").join(bound, "id", "left").select("id", F.coalesce("_bound", F.lit(0)).alias("_bound"))
    rows = rows.join(bound, "id", "left").withColumn("tier", F.element_at(names, F.least(tier_rank(F.col("tier")), F.coalesce("_bound", F.lit(2))) + 1)).drop("_bound")
    return rows.withColumn("written", (F.col("tier") != F.col("old_tier")) | (F.abs(F.col("heat") - F.col("old_heat")) > 0.01))


def run_totals(run: DataFrame) -> DataFrame:
    """name and n: every transition that may be, unchanged, and total."""
    moved = F.col("tier") != F.col("old_tier")
    names = [(a, b) for a in ("hot", "warm", "cold") for b in ("hot", "warm", "cold") if a != b]
    counts = {f"{a}_to_{b}": F.count_if(moved & (F.col("old_tier") == a) & (F.col("tier") == b)) for a, b in names}
    counts |= {"unchanged": F.count_if(~moved), "total": F.count("*"), "written": F.count_if("written")}
    one = run.agg(*[c.alias(n) for n, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in counts])).alias("r")).select("r.*")


def tier_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """old, new, n and the least id of each move between two states (id, tier) of a store; a missing tier is told as (none), a record of one state alone as (absent)."""
    told = lambda c: F.coalesce(c, F.lit("(none)"))
    a, b = before.select("id", told(F.col("tier")).alias("old")), after.select("id", told(F.col("tier")).alias("new"))
    both = a.join(b, "id", "full").select("id", F.coalesce("old", F.lit("(absent)")).alias("old"), F.coalesce("new", F.lit("(absent)")).alias("new"))
    return both.groupBy("old", "new").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def tier_shares(before: DataFrame, after: DataFrame) -> DataFrame:
    """tier, and its records and their share before and after."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.coalesce("tier", F.lit("(none)")).alias("tier")).agg(F.count("*").alias(name))

    both = counted(before, "before").join(counted(after, "after"), "tier", "full").na.fill(0)
    totals = before.agg(F.count("*").alias("_b")).crossJoin(after.agg(F.count("*").alias("_a")))  # one row each
    return both.crossJoin(F.broadcast(totals)).select("tier", "before", "after", (F.col("before") / F.col("_b")).alias("share_before"), (F.col("after") / F.col("_a")).alias("share_after"))


def signal_counts(store: DataFrame) -> DataFrame:
    """Rows, those with a last delivery, and those with a frequency."""
    return store.agg(F.count("*").alias("rows"), F.count("last_retrieved").alias("with_last_retrieved"), F.count_if(F.coalesce("frequency", F.lit(0.0)) > 0).alias("with_frequency"))


def without_signal(store: DataFrame) -> DataFrame:
    """The store with its delivery history discarded."""
    return store.withColumn("last_retrieved", F.lit(None).cast(store.schema["last_retrieved"].dataType)).withColumn("frequency", F.lit(0.0))
