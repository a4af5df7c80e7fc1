"""Records of the store: scans, versions, tasks, timers, declined topics, provenance, authorship and audits of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .logs import latest

# Sources whose reflections are in a person's own voice, and sources that tell who wrote a text.
OWN_REFLECTIONS = ("reflection_engine", "session_reflection")
SOURCE_AUTHORS = {
    "obsidian_export": "first_person", "journal": "first_person", "pdf": "unknown", "docx": "unknown", "book": "unknown", "epub": "unknown", "html": "unknown",
    "article": "unknown",
}
# Filler of assistants in what a search finds.
DEFAULT_FILLER = (
    "as an ai", "i don't have personal", "i'm here to help", "how can i assist", "i'd be happy to", "let me know if", "feel free to",
    "is there anything else",
)
# Intents whose replies state facts.
FACTUAL = ("web_search", "factual_recall", "recent", "status_state")


def scan(records: DataFrame, kind: str, ts: str, id_: str, most: int, quality: Column | None = None, session: Column | None = None) -> DataFrame:
    """The ``most`` newest records of each kind that aren't suppressed and, with ``session``, are of it; records without a time count as the oldest."""
    rows = records if quality is None else records.where(F.coalesce(quality, F.lit("ok")) != "suppressed")
    rows = rows if session is None else rows.where(session)
    w = Window.partitionBy(kind).orderBy(F.desc(F.coalesce(F.unix_micros(ts), F.lit(0))), F.desc(id_))
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def confirmed_versions(log: DataFrame, id_: str, version: str, written: str, confirmed: str) -> DataFrame:
    """The highest version of each id, the last written among equals, and whether it is ``active`` (confirmed) or ``proposed``, the last written first by ``place``."""
    rows = latest(log, [id_], version, written)
    place = F.row_number().over(Window.partitionBy("status").orderBy(F.desc(written), F.desc(id_)))
    return rows.withColumn("status", F.when(F.coalesce(confirmed, F.lit(False)), "active").otherwise("proposed")).withColumn("place", place)


def project_sessions(log: DataFrame, session: str, project: str, version: str, ts: str) -> DataFrame:
    """The projects of sessions' latest versions, their sessions, and whether a project is the one most used (the first by name among equals)."""
    counts = latest(log, [session], version, ts).where(F.col(project).isNotNull()).groupBy(project).agg(F.count("*").alias("sessions"))
    best = counts.agg(F.min(F.struct(-F.col("sessions"), F.lower(project), project)).getField(project).alias("top"))
    # one row
    return counts.crossJoin(F.broadcast(best)).select(project, "sessions", (F.col(project) == F.col("top")).alias("most_used"))


def running_timers(log: DataFrame, timer: str, ts: str, status: str, id_: str) -> DataFrame:
    """Timers whose latest record is running; records without a timer don't count."""
    return latest(log.where(F.col(timer).isNotNull()), [timer], ts, id_).where(F.col(status) == "running")


def decline_tombstones(log: DataFrame, topics: DataFrame, id_: str, user: str, text: str, resolved: Column, deleted: Column) -> DataFrame:
    """Resolutions of a user's open loops whose text holds a topic that the user declined.

    ``topics`` has the user and topic; those of fewer than three characters are none.  Loops that are resolved or deleted
    themselves stay.  One resolution for each loop: its text, marked, and the loop's id.
    """
    wanted = topics.where(F.length("topic") >= 3).groupBy(user).agg(F.collect_set(F.lower("topic")).alias("_topics"))
    live = log.where(~F.coalesce(resolved, F.lit(False)) & ~F.coalesce(deleted, F.lit(False))).join(wanted, user)
    hit = F.exists("_topics", lambda t: F.contains(F.lower(F.col(text)), t))
    return live.where(hit).select(user, F.col(id_).alias("original_id"), F.concat(F.lit("[Declined] "), F.col(text)).alias("text"), F.lit("user_declined").alias("resolution"))


def current_tasks(log: DataFrame, id_: str, ts: str, status: str, user: str, most: int = 10) -> DataFrame:
    """The ``most`` newest tasks of each user whose latest record is proposed or active."""
    rows = latest(log, [id_], ts).where(F.col(status).isin("proposed", "active"))
    w = Window.partitionBy(user).orderBy(F.desc(ts), F.desc(id_))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def deviations(records: DataFrame, ts: str, id_: str, most: int = 50, confirmed: Column | None = None, pattern: Column | None = None) -> DataFrame:
    """The ``most`` newest deviations, of those confirmed or of a pattern if asked."""
    rows = records if confirmed is None else records.where(confirmed)
    rows = rows if pattern is None else rows.where(pattern)
    return rows.orderBy(F.desc(ts), F.desc(id_)).limit(most)


def provenance(edges: DataFrame, records: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """derived, source and the kind of the record that the source's id is found as (the first of ``kinds`` that has it); ``state`` tells a
    reference to itself and one to a missing record."""
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    found = records.where(F.col("kind").isin(*kinds)).groupBy(F.col("id").alias("source")).agg(F.min_by("kind", order).alias("kind"))
    state = F.when(F.col("derived") == F.col("source"), "self").when(F.col("kind").isNull(), "missing").otherwise("found")
    return edges.select("derived", "source").distinct().join(found, "source", "left").withColumn("state", state)


def written_authorship(kind: Column, source: Column, role: Column) -> Column:
    """Author of a record as it is written."""
    spoken = F.when(role == "user", "first_person").when(role == "assistant", "mixed").otherwise("unknown")
    return (
        F.when(kind.isin("profile", "journal"), "first_person").when((kind == "reflection") & source.isin(*OWN_REFLECTIONS), "first_person")
        .when(kind == "conversation", spoken).otherwise("unknown")
    )


def rebuilt_authorship(source: Column, text: Column, role: Column, chat_source: str = "chatgpt_export") -> Column:
    """Author of an index row as a rebuild tells it: by its source, and for chat exports by the text's beginning, then the role."""
    low, src = F.lower(F.ltrim(F.coalesce(text, F.lit("")))), F.lower(F.coalesce(source, F.lit("")))
    chat = (
        F.when(F.startswith(low, F.lit("user:")), "first_person").when(F.startswith(low, F.lit("assistant:")), "mixed")
        .when(F.lower(role) == "user", "first_person").when(F.lower(role) == "assistant", "mixed").otherwise("unknown")
    )
    out = F.when(src == chat_source, chat)
    for name, author in SOURCE_AUTHORS.items():
        out = out.when(src == name, author)
    return out.otherwise("unknown")


def reclassified(rows: DataFrame, source: str, role: str, chat_source: str) -> DataFrame:
    """Rows (store, kind) of two stores with the store and kind they get: chat-export rows of users and assistants go from the
    ``ingested`` store to ``memory`` as conversations."""
    moves = (F.col("store") == "ingested") & (F.col(source) == chat_source) & F.coalesce(F.col(role).isin("user", "assistant"), F.lit(False))
    return rows.withColumn("new_store", F.when(moves, "memory").otherwise(F.col("store"))).withColumn("new_kind", F.when(moves, "conversation").otherwise(F.col("kind")))


def store_distribution(moved: DataFrame) -> DataFrame:
    """Rows of each store and kind before and after."""
    before = moved.groupBy("store", "kind").agg(F.count("*").alias("before"))
    after = moved.groupBy(F.col("new_store").alias("store"), F.col("new_kind").alias("kind")).agg(F.count("*").alias("after"))
    return before.join(after, ["store", "kind"], "full_outer").select("store", "kind", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def type_mismatches(records: DataFrame, folder: str, kind: str, exempt: str = "state") -> DataFrame:
    """Records whose kind isn't the folder they are in; records without a kind, and the exempt folder's, are none."""
    return records.where((F.col(folder) != exempt) & (F.coalesce(F.col(kind), F.lit("")) != "") & (F.col(kind) != F.col(folder)))


def health(junk_share: Column, missing: Column, mismatches: Column, duplicates: Column, errors: Column | None = None) -> Column:
    """RED, YELLOW or GREEN by the share of junk, missing fields, mismatches, duplicates and unreadable indexes."""
    bad = (junk_share > 0.20) | (missing > 50)
    bad = bad if errors is None else bad | (errors > 0)
    poor = (junk_share > 0.05) | (missing > 0) | (mismatches > 0) | (duplicates > 100)
    return F.when(bad, "RED").when(poor, "YELLOW").otherwise("GREEN")


def growth(records: DataFrame, kind: str, day: Column, size: Column, horizon: int = 30) -> DataFrame:
    """Bytes by kind, and for all (null): whole bytes a day over the span of days, and the bytes expected after ``horizon`` days."""
    rows = records.select(kind, day.alias("_day"), size.alias("_size"))
    out = rows.rollup(kind).agg(F.sum("_size").alias("bytes"), F.datediff(F.max("_day"), F.min("_day")).alias("span"), F.grouping(kind).alias("_all"))
    rate = F.floor(F.col("bytes") / F.greatest(F.col("span"), F.lit(1))).cast("long")
    whole = F.col("_all") == 1
    return out.select(F.when(~whole, F.col(kind)).alias(kind), "bytes", F.when(whole, rate).alias("per_day"), F.when(whole, F.col("bytes") + rate * horizon).alias("expected"))


def drift_report(plan: DataFrame) -> DataFrame:
    """Rows of a rebuild plan (class, kind, record_id) by class and kind."""
    return plan.groupBy("class", "kind").agg(F.count("*").alias("n"))


def shared_ids(records: DataFrame, id_: str, kind: str) -> DataFrame:
    """Ids that more than one record claims, how many do, and their kinds."""
    out = records.groupBy(id_).agg(F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))
    return out.where("records > 1")


def keyword_audit(reviews: DataFrame, keywords: tuple[str, ...], signal: str, least: int = 20, share: float = 0.95) -> DataFrame:
    """For each keyword: how often it fired with the signal, alone and with which outcomes and sources, and what to do with it.

    ``reviews``: triggered_by (array), outcome, user and draft (texts).  A keyword may go if it fired alone ``least`` times, never with a
    refusal and by ``share`` with an allowance.
    """
    fired = reviews.where(F.array_contains("triggered_by", signal))
    fired = fired.withColumn("solo", F.size("triggered_by") == 1).withColumn("u", F.lower(F.coalesce("user", F.lit("")))).withColumn("v", F.lower(F.coalesce("draft", F.lit(""))))
    tested = F.array(*[F.struct(F.lit(k).alias("keyword"), F.contains("u", F.lit(k.lower())).alias("in_user"), F.contains("v", F.lit(k.lower())).alias("in_draft")) for k in keywords])
    rows = fired.select("solo", "outcome", F.explode(F.filter(tested, lambda t: t["in_user"] | t["in_draft"])).alias("t")).select("solo", "outcome", "t.*")
    solo = lambda test: F.count_if(F.col("solo") & test)
    counts = rows.groupBy("keyword").agg(
        F.count("*").alias("fires"), F.count_if("solo").alias("solo_fires"), solo(F.col("outcome") == "allow").alias("allowed"),
        solo(F.col("outcome") == "revise").alias("revised"), solo(F.col("outcome") == "refuse_redirect").alias("refused"),
        solo(F.col("in_user") & F.col("in_draft")).alias("both"), solo(F.col("in_user") & ~F.col("in_draft")).alias("user_only"), solo(~F.col("in_user")).alias("draft_only"),
    )
    every = reviews.sparkSession.createDataFrame([(k,) for k in keywords], "keyword string")
    out = every.join(counts, "keyword", "left").na.fill(0)
    decision = F.when(F.col("solo_fires") < least, "inconclusive").when(F.col("refused") > 0, "keep").when(F.col("allowed") >= share * F.col("solo_fires"), "remove").otherwise("keep")
    return out.withColumn("decision", decision)


def intervention_audit(logs: DataFrame) -> DataFrame:
    """Interventions by stage, by intent and by pattern (``dimension`` and ``value``), and the false positives (factual intents) and useless second stages among all.

    ``logs``: stage, intent, patterns (array), changed.  A pattern counts as often as it occurs.
    """
    logs = logs.withColumn("intent", F.coalesce("intent", F.lit("unknown")))
    one = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))
    flags = F.filter(
        F.array(
            F.when(F.col("intent").isin(*FACTUAL), one("flag", F.lit("false_positive"))),
            F.when((F.col("stage") == 2) & ~F.coalesce("changed", F.lit(False)), one("flag", F.lit("wasted_stage_2"))),
        ),
        lambda x: x.isNotNull(),
    )
    patterns = F.transform(F.coalesce("patterns", F.array().cast("array<string>")), lambda p: one("pattern", p))
    rows = logs.select(F.explode(F.concat(F.array(one("stage", F.col("stage")), one("intent", F.col("intent"))), patterns, flags)).alias("d")).select("d.*")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def retrieval_verdict(kind: Column, score: Column, content: Column, filler: tuple[str, ...] = DEFAULT_FILLER) -> Column:
    """PASS, WARN or FAIL by how many of four criteria a query's best hit meets: a kind, a score over 0.3, 40 characters, no filler."""
    text = F.trim(F.coalesce(content, F.lit("")))
    clean = ~reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(f)) for f in filler])
    met = (F.coalesce(kind, F.lit("")) != "").cast("int") + F.coalesce(score > 0.3, F.lit(False)).cast("int") + (F.length(text) >= 40).cast("int") + clean.cast("int")
    return F.when(met == 4, "PASS").when(met == 3, "WARN").otherwise("FAIL")
