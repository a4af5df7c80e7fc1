"""Further queries of stores, gates, audits and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as ASM
from ..operators import logs as L
from ..operators import ranking as R
from ..sources import ingest as S
from ..streaming import streams as X
from ..sources.folders import shared_folder
from .retrieval_queries import _CAND, _HEAT, _LOG, _NEAR, _SCORED, _STATE, _candidates, _heated, _log, _neighbours, _scored, _state_log
from .tables import table
from .text_queries import NORM, _any


def s1_newest_by_type(spark, d):
    """The ten newest records of each type."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 10")
    return rows.select("event_type", "event_id", "n")


def s21_suppressed(spark, d):
    """The rows that a store keeps when the ids that labels mark as poor are taken out."""
    poor = table(spark, d, "labels").where("quality = 0").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(poor, "doc_id", "left_anti")


def repeats_of_ten_before(spark, d):
    """Documents whose stripped, lower-cased text equals one of the ten documents before them in the source."""
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(-10, -1)
    rows = table(spark, d, "documents").withColumn("key", F.md5(F.trim(F.lower("text")).cast("binary")))
    seen = F.array_contains(F.collect_list("key").over(w), F.col("key"))
    return rows.select("doc_id", seen.alias("skipped"))


def v3_floor(spark, d):
    return _neighbours(spark, d).where("cosine >= 0.25").groupBy("query_id").agg(F.count("*").alias("n"))


def v4_exclusions(spark, d):
    """Why a result is left out, by the first rule."""
    t = T.normalize(F.col("text"))
    reason = (
        F.when(t == "", "empty").when(F.length(t) < 40, "short").when(T.contains_any(t, S.META_MARKERS), "meta")
        .when(T.starts_any(t, ("{", "[")), "json").when(F.contains(t, F.lit("```")), "fence").otherwise("kept")
    )
    return table(spark, d, "documents").select(reason.alias("reason"), "lang").groupBy("reason", "lang").agg(F.count("*").alias("n"))


def v7_intent_adjustment(spark, d):
    c = table(spark, d, "conversations").withColumn("q", F.lower("text"))
    kind = F.when(F.col("conv_id") % 3 == 0, "conversation").when(F.col("conv_id") % 3 == 1, "reflection").otherwise("ingested")
    said = F.when(F.col("role") == "user", 0.10).when(F.col("role") == "assistant", -0.10).otherwise(0.0)
    reflective = F.when(kind == "conversation", 0.10).when(kind == "reflection", 0.08).otherwise(-0.03) + said
    work = F.when(kind == "ingested", 0.08).when(kind == "conversation", 0.03).otherwise(0.0)
    score = F.when(T.contains_any(F.col("q"), ASM.REFLECTIVE), reflective).when(T.contains_any(F.col("q"), ASM.WORK), work).otherwise(0.0)
    return c.select("conv_id", "turn", F.round(score, 9).alias("adjustment"))


def first_of_ten(spark, d):
    """Profile rows first, then the others, each vector's bucket of ten once for a query."""
    c = _candidates(spark, d).withColumn("key", F.floor(F.col("vec_id") / 10))
    order = [(F.col("kind") != "profile").cast("int"), F.desc("cosine"), "vec_id"]
    first = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order))
    return c.withColumn("n", first).where("n = 1").select("query_id", "vec_id", "kind")


def not_among_reflections(spark, d):
    """Rows whose key isn't among the query's reflections."""
    c = _candidates(spark, d).withColumn("key", F.col("vec_id") % 50)
    held = c.where("kind = 'reflection'").select("query_id", "key")
    return c.where("kind <> 'reflection'").join(held, ["query_id", "key"], "left_anti").select("query_id", "vec_id")


def p6_type_gate(spark, d):
    return _scored(spark, d).where("kind = 'profile' OR (kind IN ('conversation', 'ingested') AND score >= 0.25)").select("query_id", "vec_id", "kind")


def p7_role(spark, d):
    return table(spark, d, "conversations").where("role <> 'assistant'").groupBy("conv_id").agg(F.count("*").alias("turns"))


def p10_fallback(spark, d):
    """Filtered rows, or all of a query's where the filter leaves none."""
    kept = F.sum(F.when(F.col("cosine") >= 0.45, 1).otherwise(0)).over(Window.partitionBy("query_id"))
    return _candidates(spark, d).withColumn("kept", kept).where("kept = 0 OR cosine >= 0.45").select("query_id", "vec_id")


def r7_priorities(spark, d):
    """Orders of each customer by priority, the highest first."""
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    w = Window.partitionBy("o_custkey").orderBy(rank, F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_custkey", "o_orderkey", "place")


def r11_render_window(spark, d):
    """All profile rows, four others and one reflection of each query."""
    group = F.when(F.col("kind").isin("profile", "reflection"), F.col("kind")).otherwise("other")
    w = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "vec_id")
    rows = _scored(spark, d).withColumn("group", group).withColumn("n", F.row_number().over(w))
    return rows.where("group = 'profile' OR (group = 'reflection' AND n = 1) OR (group = 'other' AND n <= 4)").select("query_id", "vec_id", "group")


def t7_distribution(spark, d):
    return _heated(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("heat"), 8).alias("heat"), F.sum("deliveries").alias("deliveries"))


def tiers_by_raw_count(spark, d):
    """Tiers by decayed frequency against tiers by the raw count."""
    h = _heated(spark, d)
    raw = F.least(F.col("deliveries") / 100, F.lit(1.0))
    old = F.when(raw >= 0.5, "hot").when(raw >= 0.2, "warm").otherwise("cold")
    return h.select(old.alias("old"), F.col("tier").alias("new")).groupBy("old", "new").agg(F.count("*").alias("n"))


def confirmed_counts(spark, d):
    """Latest version of each record, split by whether its value confirms it."""
    rows = L.latest(_log(spark, d), ["user_id"], "version", "ts", "event_id")
    return rows.groupBy((F.col("value") >= 10).alias("confirmed")).agg(F.count("*").alias("n"))


def users_main_event(spark, d):
    """The kind that each user has most events of."""
    counts = _log(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = counts.groupBy("user_id").agg(F.max(F.struct("n", "event_type")).alias("t"))
    return top.select("user_id", "t.event_type", "t.n")


def l8_latest_unresolved(spark, d):
    log = _state_log(spark, d)
    gone = L.resolved_ids(log, "event_id", "original_id", F.col("resolved")).withColumnRenamed("id", "event_id")
    return L.latest(log.join(gone, "event_id", "left_anti"), ["event_type"], "ts", "event_id").select("event_type", "event_id")


def users_last_click(spark, d):
    """Users whose last event is a click, and how long ago it was."""
    rows = L.latest(_log(spark, d), ["user_id"], "ts", "event_id").where("event_type = 'click'")
    seconds = F.floor((F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros("ts")) / 1_000_000)
    return rows.select("user_id", "event_id", T.relative_age(seconds).alias("ago"))


def first_kind_of_source(spark, d):
    """Ids that records point at, looked up among the records of four kinds, the first kind first."""
    log = _state_log(spark, d)
    edges = log.where("original_id IS NOT NULL").select("event_id", F.col("original_id"))
    order = F.array_position(F.array(*[F.lit(k) for k in ("purchase", "signup", "view", "click")]), F.col("event_type"))
    found = log.where("event_type <> 'error'").select(F.col("event_id").alias("original_id"), "event_type", order.alias("o"))
    return edges.join(found, "original_id").groupBy("event_id").agg(F.min_by("event_type", "o").alias("kind"))


def turns_by_author(spark, d):
    c = table(spark, d, "conversations")
    label = F.when(F.col("role") == "user", "first_person").when(F.col("role") == "assistant", "mixed").otherwise("unknown")
    return c.groupBy(label.alias("authorship")).agg(F.count("*").alias("n"))


def length_mismatch(spark, d):
    """Documents whose stored length isn't their text's."""
    return table(spark, d, "documents").where(F.length("text") != F.col("n_chars")).groupBy("source").agg(F.count("*").alias("n"))


def a13_store_sizes(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.size("embedding")).alias("values"))


def e7_composition(spark, d):
    """Kinds and tiers of what each query gets."""
    rows = R.guaranteed_slots(_scored(spark, d), "query_id", [F.desc("score"), "vec_id"], F.lit(6))
    return rows.groupBy("kind").pivot("tier", ["hot", "warm", "cold"]).agg(F.count(F.lit(1))).na.fill(0)


def verdict_of_three(spark, d):
    """PASS, WARN or FAIL of each query's best row."""
    top = _scored(spark, d).groupBy("query_id").agg(F.max(F.struct("score", "kind", "tier")).alias("t"))
    flags = (F.col("t.score") >= 0.3).cast("int") + (F.col("t.kind") != "ingested").cast("int") + (F.col("t.tier") != "cold").cast("int")
    return top.select("query_id", F.when(flags == 3, "PASS").when(flags == 2, "WARN").otherwise("FAIL").alias("verdict"))


def e14_grounding(spark, d):
    """Share of a user's events that have a value of ten at least; without any the share is 1."""
    rows = table(spark, d, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.avg((F.col("value") >= 10).cast("double")).alias("s"))
    users = table(spark, d, "events").select("user_id").distinct()
    share = F.coalesce("s", F.lit(1.0))
    return users.join(rows, "user_id", "left").select("user_id", F.round(share, 9).alias("share"), (share >= 0.8).alias("passed"))


def interval_of_means(spark, d):
    """Percentile interval of the mean value of each kind of event over 100 Poisson resamples of all rows."""
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    draws = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(99))))
    u = F.xxhash64("event_id", "b").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    # the number of times that a row is drawn: Poisson of mean 1 by its distribution function
    times = sum((u >= p).cast("int") for p in (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317))
    means = draws.groupBy("event_type", "b").agg((F.sum(F.col("value") * times) / F.sum(times)).alias("m"))
    return means.groupBy("event_type").agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"))


def _events_stream(spark, d):
    events = X.file_stream(spark, f"{d}/events.parque[t]", spark.read.parquet(f"{d}/events.parquet"), files=None)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def x5_sessions(spark, d):
    rows = X.run_available(X.activity_sessions(_events_stream(spark, d), "6 hours"), "complete", shared_folder(spark))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (
    s1_newest_by_type, s21_suppressed, repeats_of_ten_before, v3_floor, v4_exclusions, v7_intent_adjustment, first_of_ten, not_among_reflections,
    p6_type_gate, p7_role, p10_fallback, r7_priorities, r11_render_window, t7_distribution, tiers_by_raw_count, confirmed_counts, users_main_event,
    l8_latest_unresolved, users_last_click, first_kind_of_source, turns_by_author, length_mismatch, a13_store_sizes, e7_composition, verdict_of_three, e14_grounding,
    interval_of_means, x5_sessions,
)}

_LOW = "lower(text)"
_RN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {1} ORDER BY {2}) AS n FROM {0}) WHERE n "
_AGO = "floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1000000)::BIGINT"
_PL = "(greatest(s // {0}, {2}) || ' {1}' || CASE WHEN greatest(s // {0}, {2}) = 1 THEN '' ELSE 's' END || ' ago')"

ORACLES = {
    "s1_newest_by_type": "SELECT event_type, event_id, n::INT AS n FROM (" + _RN.format("events", "event_type", "ts DESC, event_id DESC") + "<= 10)",
    "s21_suppressed": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "repeats_of_ten_before": "SELECT doc_id, coalesce(list_contains(before, k), false) AS skipped FROM (SELECT doc_id, k, list(k) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS before FROM (SELECT doc_id, source, md5(trim(lower(text))) AS k FROM documents))",
    "v3_floor": f"SELECT query_id, count(*) AS n FROM {_NEAR.format(20)} WHERE cosine >= 0.25 GROUP BY 1",
    "v4_exclusions": f"SELECT CASE WHEN s = '' THEN 'empty' WHEN length(s) < 40 THEN 'short' WHEN {_any('s', S.META_MARKERS)} THEN 'meta' WHEN s[1] IN ('{{', '[') THEN 'json' WHEN contains(s, '```') THEN 'fence' ELSE 'kept' END AS reason, lang, count(*) AS n FROM (SELECT lang, {NORM} AS s FROM documents) GROUP BY 1, 2",
    "v7_intent_adjustment": f"SELECT conv_id, turn, round(CASE WHEN {_any(_LOW, ASM.REFLECTIVE)} THEN CASE conv_id % 3 WHEN 0 THEN 0.10 WHEN 1 THEN 0.08 ELSE -0.03 END::DOUBLE + CASE role WHEN 'user' THEN 0.10 WHEN 'assistant' THEN -0.10 ELSE 0 END::DOUBLE WHEN {_any(_LOW, ASM.WORK)} THEN CASE conv_id % 3 WHEN 2 THEN 0.08 WHEN 0 THEN 0.03 ELSE 0 END::DOUBLE ELSE 0 END, 9) AS adjustment FROM conversations",
    "first_of_ten": "SELECT query_id, vec_id, kind FROM (" + _RN.format(_CAND, "query_id, vec_id // 10", "(kind <> 'profile')::INT, cosine DESC, vec_id") + "= 1)",
    "not_among_reflections": f"SELECT query_id, vec_id FROM {_CAND} c WHERE kind <> 'reflection' AND NOT EXISTS (SELECT 1 FROM {_CAND} r WHERE r.kind = 'reflection' AND r.query_id = c.query_id AND r.vec_id % 50 = c.vec_id % 50)",
    "p6_type_gate": f"SELECT query_id, vec_id, kind FROM {_SCORED} WHERE kind = 'profile' OR (kind IN ('conversation', 'ingested') AND score >= 0.25)",
    "p7_role": "SELECT conv_id, count(*) AS turns FROM conversations WHERE role <> 'assistant' GROUP BY conv_id",
    "p10_fallback": f"SELECT query_id, vec_id FROM (SELECT *, sum((cosine >= 0.45)::INT) OVER (PARTITION BY query_id) AS kept FROM {_CAND}) WHERE kept = 0 OR cosine >= 0.45",
    "r7_priorities": "SELECT o_custkey, o_orderkey, n::INT AS place FROM (" + _RN.format("orders", "o_custkey", "o_orderpriority[1]::INT, o_totalprice DESC, o_orderkey") + "<= 3)",
    "r11_render_window": f"SELECT query_id, vec_id, g AS \"group\" FROM (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY score DESC, vec_id) AS n FROM (SELECT *, CASE WHEN kind IN ('profile', 'reflection') THEN kind ELSE 'other' END AS g FROM {_SCORED})) WHERE g = 'profile' OR (g = 'reflection' AND n = 1) OR (g = 'other' AND n <= 4)",
    "t7_distribution": f"SELECT tier, count(*) AS n, round(avg(heat), 8) AS heat, sum(deliveries)::BIGINT AS deliveries FROM {_HEAT} GROUP BY tier",
    "tiers_by_raw_count": f"SELECT CASE WHEN deliveries >= 50 THEN 'hot' WHEN deliveries >= 20 THEN 'warm' ELSE 'cold' END AS old, tier AS new, count(*) AS n FROM {_HEAT} GROUP BY 1, 2",
    "confirmed_counts": "SELECT value >= 10 AS confirmed, count(*) AS n FROM (" + _RN.format(_LOG, "user_id", "version DESC, ts DESC, event_id DESC") + "= 1) GROUP BY 1",
    "users_main_event": "SELECT user_id, event_type, c AS n FROM (" + _RN.format("(SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2)", "user_id", "c DESC, event_type DESC") + "= 1)",
    "l8_latest_unresolved": "SELECT event_type, event_id FROM (" + _RN.format(f"(SELECT * FROM {_STATE} WHERE event_id NOT IN (SELECT event_id FROM {_STATE} WHERE resolved UNION SELECT original_id FROM {_STATE} WHERE original_id IS NOT NULL))", "event_type", "ts DESC, event_id DESC") + "= 1)",
    "users_last_click": f"SELECT user_id, event_id, CASE WHEN s < 3600 THEN {_PL.format(60, 'minute', 1)} WHEN s < 86400 THEN {_PL.format(3600, 'hour', 0)} WHEN s < 2592000 THEN {_PL.format(86400, 'day', 0)} ELSE {_PL.format(2592000, 'month', 0)} END AS ago FROM (SELECT *, {_AGO} AS s FROM (" + _RN.format("events", "user_id", "ts DESC, event_id DESC") + "= 1) WHERE event_type = 'click')",
    "first_kind_of_source": f"SELECT e.event_id, f.event_type AS kind FROM {_STATE} e JOIN {_STATE} f ON f.event_id = e.original_id WHERE f.event_type <> 'error'",
    "turns_by_author": "SELECT CASE role WHEN 'user' THEN 'first_person' WHEN 'assistant' THEN 'mixed' ELSE 'unknown' END AS authorship, count(*) AS n FROM conversations GROUP BY 1",
    "length_mismatch": "SELECT source, count(*) AS n FROM documents WHERE length(text) <> n_chars GROUP BY source",
    "a13_store_sizes": "SELECT label, count(*) AS rows, sum(len(embedding))::BIGINT AS \"values\" FROM embeddings GROUP BY label",
    "e7_composition": f"SELECT kind, count(*) FILTER (tier = 'hot') AS hot, count(*) FILTER (tier = 'warm') AS warm, count(*) FILTER (tier = 'cold') AS cold FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind = 'profile' ORDER BY score DESC, vec_id) AS n FROM {_SCORED}) WHERE kind = 'profile' OR n <= 6 GROUP BY kind",
    "verdict_of_three": "SELECT query_id, CASE (score >= 0.3)::INT + (kind <> 'ingested')::INT + (tier <> 'cold')::INT WHEN 3 THEN 'PASS' WHEN 2 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM (" + _RN.format(_SCORED, "query_id", "score DESC, kind DESC, tier DESC") + "= 1)",
    "e14_grounding": "SELECT user_id, round(coalesce(s, 1), 9) AS share, coalesce(s, 1) >= 0.8 AS passed FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, avg((value >= 10)::INT) AS s FROM events WHERE event_type <> 'error' GROUP BY 1) USING (user_id)",
    "x5_sessions": "SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000)::INT, 1) AS new FROM events)) GROUP BY 1, 2) GROUP BY user_id",
}
