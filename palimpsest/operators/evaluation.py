"""Graded retrieval metrics, drift and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .logs import ranked


def _dcg(grade: Column, rank: Column) -> Column:
    return F.sum((F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1))


def ideal_gain(counts: DataFrame, k: int) -> DataFrame:
    """query_id and ideal: the discounted gain of the best k rows, from how many rows (``n``) of each ``grade`` a query has.

    At most k places of a query are written out, however many rows it has."""
    first = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    rows = counts.where("n > 0").withColumn("_first", first).where(F.col("_first") <= k)
    places = F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + F.col("n") - 1, F.lit(k))))
    return rows.select("query_id", "grade", places.alias("_r")).groupBy("query_id").agg(_dcg(F.col("grade"), F.col("_r")).alias("ideal"))


def _counted(grades: DataFrame) -> DataFrame:
    return grades.groupBy("query_id", "grade").agg(F.count("*").alias("n"))


def ndcg(ranked: DataFrame, grades: DataFrame, k: int, counts: DataFrame | None = None) -> DataFrame:
    """nDCG at k of each query; null where no grade is above 0.  ranked: query_id, id, rank; grades: query_id, id, grade.

    With ``counts`` (query_id, grade, n) of all graded rows, ``grades`` need only hold those of ranked rows.
    """
    got = ranked.where(F.col("rank") <= k).join(grades, ["query_id", "id"], "left")
    got = got.groupBy("query_id").agg(_dcg(F.coalesce("grade", F.lit(0)), F.col("rank")).alias("dcg"))
    ideal = ideal_gain(_counted(grades) if counts is None else counts, k)
    return got.join(ideal, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).alias("ndcg"))


def contamination(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """Share of each query's first k rows without a grade above 0."""
    got = ranked.where(F.col("rank") <= k).join(grades, ["query_id", "id"], "left")
    return got.groupBy("query_id").agg(F.avg((F.coalesce("grade", F.lit(0)) == 0).cast("double")).alias("contamination"))


def tie_bands(ranked: DataFrame, gap: float = 1e-6) -> DataFrame:
    """A new band begins where the score falls by ``gap`` or more; the size of each row's band."""
    w = Window.partitionBy("query_id").orderBy("rank")
    new = F.coalesce((F.lag("score").over(w) - F.col("score") >= gap).cast("int"), F.lit(1))
    rows = ranked.withColumn("_new", new).withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("band_size", F.count("*").over(Window.partitionBy("query_id", "band"))).drop("_new")


def selection_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of the id sets of two arms, for each query."""
    x = a.select("query_id", "id").distinct().withColumn("_a", F.lit(1))
    y = b.select("query_id", "id").distinct().withColumn("_b", F.lit(1))
    both = x.join(y, ["query_id", "id"], "full_outer")
    return both.groupBy("query_id").agg((F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)) / F.count("*")).alias("jaccard"))


def mean_pairwise_jaccard(rows: DataFrame) -> DataFrame:
    """Mean Jaccard over all pairs of queries that share an id, and their number (other pairs are 0)."""
    sizes = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    l, r = rows.select("id", F.col("query_id").alias("q1")), rows.select("id", F.col("query_id").alias("q2"))
    met = l.join(r, "id").where("q1 < q2").groupBy("q1", "q2").agg(F.count("*").alias("i"))
    met = met.join(sizes.select(F.col("query_id").alias("q1"), F.col("n").alias("n1")), "q1").join(sizes.select(F.col("query_id").alias("q2"), F.col("n").alias("n2")), "q2")
    shared = met.select(F.expr("i / (n1 + n2 - i)").alias("j"), F.lit(1).alias("sharing"), F.lit(0).alias("queries"))
    rows_ = shared.unionByName(sizes.select(F.lit(0.0).alias("j"), F.lit(0).alias("sharing"), F.lit(1).alias("queries")))
    n = F.sum("queries")
    return rows_.agg((F.sum("j") / (n * (n - 1) / 2)).alias("mean_jaccard"), F.sum("sharing").alias("sharing"))


def rank_displacement(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("query_id", "id", F.col("rank").alias("ra")).join(b.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"])
    return both.groupBy("query_id").agg(F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("displacement"), F.count("*").alias("common"))


def drift(series: DataFrame, key: str, order: str, value: str, window: int, threshold: float | None = None) -> DataFrame:
    """Mean of the last rows less mean of the first, the least-squares slope over the row number, and whether the fall is within the threshold.

    A series shorter than the window is its own window, and its change is 0.
    """
    rows = ranked(series, key, order, "_u")
    sizes = series.groupBy(key).agg(F.count("*").alias("_n"))
    rows = rows.join(F.broadcast(sizes), key)  # a row for each dimension
    change = F.avg(F.when(F.col("_u") > F.col("_n") - window, F.col(value))) - F.avg(F.when(F.col("_u") <= window, F.col(value)))
    out = rows.groupBy(key).agg(change.alias("change"), F.coalesce(F.regr_slope(F.col(value), F.col("_u").cast("double")), F.lit(0.0)).alias("slope"))
    return out if threshold is None else out.withColumn("passed", F.col("change") >= -threshold)


def baseline_gate(metrics: DataFrame, baseline: DataFrame, drop: float = 0.05) -> DataFrame:
    """metric, value, base and verdict of every metric of the run or the baseline: ``fail`` for a fall of more than ``drop``, ``new`` without
    a baseline, ``not_measured`` without a value; ``calibration`` for all where there is no baseline at all.  Names that begin with _ are left out."""
    named = ~F.startswith("metric", F.lit("_"))
    first = baseline.where(named).isEmpty()
    rows = metrics.where(named).join(baseline.where(named).withColumnRenamed("value", "base"), "metric", "full_outer")
    fell = F.when(F.col("base") - F.col("value") > drop, "fail").otherwise("pass")
    verdict = F.lit("calibration") if first else F.when(F.col("base").isNull(), "new").when(F.col("value").isNull(), "not_measured").otherwise(fell)
    return rows.withColumn("verdict", verdict)


def arm_summary(rows_: DataFrame, grades: DataFrame, reference: str, k: int, counts: DataFrame | None = None) -> DataFrame:
    """(``counts`` as in ``ndcg``.)  Per arm: mean nDCG at k over queries that have one, mean Jaccard with the reference arm's sets, and how many queries' sets differ."""
    got = rows_.where(F.col("rank") <= k)
    dcg = got.join(grades, ["query_id", "id"], "left").groupBy("arm", "query_id").agg(_dcg(F.coalesce("grade", F.lit(0)), F.col("rank")).alias("dcg"))
    ideal = ideal_gain(_counted(grades) if counts is None else counts, k)
    scored = dcg.join(ideal, "query_id", "left").select("arm", "query_id", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).alias("ndcg"))
    base = got.where(F.col("arm") == reference).select("query_id", "id", F.lit(1).alias("_b"))
    sizes = base.groupBy("query_id").agg(F.count("*").alias("_n"))
    both = got.join(base, ["query_id", "id"], "left").groupBy("arm", "query_id").agg(F.count("_b").alias("_i"), F.count("*").alias("_m")).join(sizes, "query_id", "left")
    union = F.col("_m") + F.coalesce("_n", F.lit(0)) - F.col("_i")
    both = both.select("arm", "query_id", (F.col("_i") / union).alias("jaccard"))
    rows = both.join(scored, ["arm", "query_id"], "left")
    return rows.groupBy("arm").agg(F.avg("ndcg").alias("ndcg"), F.avg("jaccard").alias("jaccard"), F.count_if(F.col("jaccard") < 1).alias("changed"))


def abstention(ranked: DataFrame, grades: DataFrame, abstain: DataFrame, k: int) -> DataFrame:
    """Of the queries that should get nothing: whether none of their first k rows has a grade above 0."""
    got = ranked.where(F.col("rank") <= k).join(grades, ["query_id", "id"], "left")
    bad = got.groupBy("query_id").agg(F.max(F.coalesce("grade", F.lit(0))).alias("_g"))
    return abstain.join(bad, "query_id", "left").select("query_id", (F.coalesce("_g", F.lit(0)) == 0).alias("correct"))


def leakage(ranked: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Distractors (id, distractor) of each class among the queries' first k rows."""
    return ranked.where(F.col("rank") <= k).join(classes, "id").groupBy("distractor").agg(F.count("*").alias("leaked"), F.countDistinct("query_id").alias("queries"))


def lever_attribution(ranked: DataFrame, grades: DataFrame, reference: str, bait: Column) -> DataFrame:
    """query_id, bait, lever and swing: the arm that separates a bait most from a relevant row (grade 2 or more) it outranks.

    A swing is how much further the bait than the row falls when the lever is off; equal swings go to the first arm by name.
    """
    scores = ranked.select("arm", "query_id", "id", "score")
    full = ranked.where(F.col("arm") == reference)
    baits = full.where(bait).select("query_id", F.col("id").alias("bait"), F.col("score").alias("bait_score"))
    good = full.join(grades.where("grade >= 2"), ["query_id", "id"]).select("query_id", F.col("id").alias("victim"), F.col("score").alias("victim_score"))
    pairs = baits.join(good, "query_id").where("bait <> victim AND bait_score > victim_score")
    off = scores.where(F.col("arm") != reference)
    pairs = pairs.join(off.select("query_id", "arm", F.col("id").alias("bait"), F.col("score").alias("bait_off")), ["query_id", "bait"])
    pairs = pairs.join(off.select("query_id", "arm", F.col("id").alias("victim"), F.col("score").alias("victim_off")), ["query_id", "arm", "victim"])
    swing = F.round((F.col("bait_score") - F.col("bait_off")) - (F.col("victim_score") - F.col("victim_off")), 9)
    best = pairs.groupBy("query_id", "bait", "arm").agg(F.max(swing).alias("swing"))
    w = Window.partitionBy("query_id", "bait").orderBy(F.desc("swing"), "arm")
    return best.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query_id", "bait", F.col("arm").alias("lever"), "swing")


def integrity(cases: DataFrame, delivered: DataFrame) -> DataFrame:
    """Cases (query_id, id, expect) with whether the tagged record is there, and PASS where that is as expected."""
    got = delivered.select("query_id", "id", F.lit(True).alias("present"))
    rows = cases.join(got, ["query_id", "id"], "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return rows.withColumn("verdict", F.when(F.col("present") == (F.col("expect") == "surface"), "PASS").otherwise("FAIL"))
