"""Signals in text: reflection candidates, patterns across sessions, replies that repeat."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written
from ..functions.text import contains_any, jaccard, response_words
from ..sources.ingest import QUESTION_MARKERS


def reflection_score(normalized: Column, role: Column, kind: Column, experience: Column) -> Column:
    n = F.length(normalized)
    return (
        F.lit(1.0)
        + F.when(role == "user", 0.5).when(role == "assistant", -0.4).when(role.isin("tool", "system"), -1.0).otherwise(0.0)
        + F.when(kind == "experience", 0.6).when(kind == "user_content", 0.2).when(kind == "question", -0.3).when(kind == "answer", -0.1).otherwise(0.0)
        + F.when((n > 100) & experience, 0.4).otherwise(0.0)
        + F.when(contains_any(normalized, QUESTION_MARKERS), -0.2).otherwise(0.0)
        + F.when(n < 40, -0.5).when(n > 1500, -0.2).otherwise(0.0)
        + F.when(n > 200, 0.15).otherwise(0.0)
    )


def novel_selection(rows: DataFrame, group: str, most: int = 8, alike: float = 0.3, pool: int = 400) -> DataFrame:
    """Up to ``most`` rows of each group by descending score, none more alike than ``alike`` to one before.

    rows: group, id, score, words (an array).  In rounds: every task cuts a group to its ``pool`` best rows, they meet, and picks are taken from
    the best ``pool`` of all.  A group that has fewer than ``most`` picks and more rows goes into the next round without the rows up to the
    last one seen and those too alike to a pick, so no task holds more than some pools of a group.
    """
    kind = dict(rows.dtypes)[group]
    out_schema = f"{group} {kind}, id long, score double, place int, words array<string>, last_score double, last_id long, seen int"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for pdf in batches:
            best = pdf if best is None else pd.concat([best, pdf])
            if len(best) > 4 * pool:
                best = best.sort_values(["score", "id"], ascending=[False, True]).groupby(group, sort=False, dropna=False).head(pool)
        if best is not None:
            yield best.sort_values(["score", "id"], ascending=[False, True]).groupby(group, sort=False, dropna=False).head(pool)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [set(w) for w in pdf["held"].iloc[0]] if pdf["held"].iloc[0] is not None else []
        before = len(held)
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).head(pool)
        out = []
        for row in pdf.itertuples():
            words = set(row.words)
            if len(held) < most and all(len(words & s) <= alike * len(words | s) for s in held if words and s):
                held.append(words)
                out.append((getattr(row, group), row.id, row.score, len(held), list(row.words), None, None, None))
        last = pdf.iloc[-1]
        out.append((last[group], None, None, before + len(out), None, last["score"], last["id"], len(pdf)))
        return pd.DataFrame(out, columns=[group, "id", "score", "place", "words", "last_score", "last_id", "seen"])

    left = rows.select(group, "id", F.col("score").cast("double").alias("score"), "words").withColumn("held", F.lit(None).cast("array<array<string>>"))
    found: DataFrame | None = None
    while True:
        round_ = left.mapInPandas(cut, left.schema).groupBy(group).applyInPandas(pick, out_schema).persist()
        picks = round_.where("id IS NOT NULL").select(group, "id", "score", "place", "words")
        found = picks if found is None else found.unionByName(picks)
        open_ = round_.where((F.col("id").isNull()) & (F.col("place") < most) & (F.col("seen") >= pool)).select(group, "last_score", "last_id")
        if open_.isEmpty():
            return found.select(group, "id", "score", "place")
        held = found.groupBy(group).agg(F.collect_list("words").alias("held"))
        left = rows.select(group, "id", F.col("score").cast("double").alias("score"), "words").join(F.broadcast(open_.join(held, group, "left")), group)
        shared = F.exists("held", lambda h: jaccard(h, F.col("words")) > alike)
        later = (F.col("score") < F.col("last_score")) | ((F.col("score") == F.col("last_score")) & (F.col("id") > F.col("last_id")))
        left = left.where(later & ~F.coalesce(shared, F.lit(False))).drop("last_score", "last_id")


def transcripts(turns: DataFrame, session: str, order: str, least: int = 3, limit: int = 8000, assistant: str = "Assistant") -> DataFrame:
    """Numbered transcript of each session with ``least`` exchanges (a user's turn and the reply that follows it), cut and marked at
    ``limit`` characters, and the turns in it (``source_ids``)."""
    w = Window.partitionBy(session).orderBy(order)
    replied = F.lead("role").over(w) == "assistant"
    rows = turns.withColumn("_reply", F.when(replied, F.lead("text").over(w))).withColumn("_next", F.when(replied, F.lead(order).over(w)))
    rows = rows.where("role = 'user'").groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, "text", "_reply", "_next"))).alias("l"))

    def exchange(x, i):
        reply = F.coalesce(x["_reply"], F.lit(""))
        return F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(":\nUser: "), x["text"], F.lit(f"\n{assistant}: "), reply, F.lit("\n\n"))

    text = F.array_join(F.transform("l", exchange), "")
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n[... truncated]"))).otherwise(text)
    ids = F.flatten(F.transform("l", lambda x: F.filter(F.array(x[order], x["_next"]), lambda i: i.isNotNull())))
    rows = rows.where(F.size("l") >= least)
    return rows.select(session, F.size("l").cast("long").alias("exchanges"), cut.alias("transcript"), ids.alias("source_ids"))


def evidence_window(rows: DataFrame, key: str, as_of: Column, days: int = 30, least: int = 3) -> DataFrame:
    """Keys with ``least`` records in the last ``days``: how many, their ids by time, and the hottest of their tiers, which bounds what is derived from them."""
    age = F.unix_micros(as_of) - F.unix_micros("ts")
    recent = rows.where((age >= 0) & (age <= days * 86_400_000_000))
    rank = F.array_position(F.array(F.lit("cold"), F.lit("warm"), F.lit("hot")), F.col("tier"))
    out = recent.groupBy(key).agg(F.count("*").alias("records"), F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("l"), F.max_by("tier", rank).alias("tier"))
    return out.where(F.col("records") >= least).select(key, "records", "tier", F.transform("l", lambda x: x["event_id"]).alias("ids"))


def near_repeats(turns: DataFrame, session: str, order: str, least: float = 0.85) -> DataFrame:
    """Replies that repeat the reply before them in the session."""
    replies = turns.where("role = 'assistant'").withColumn("_w", response_words(F.col("text")))
    before = F.lag("_w").over(Window.partitionBy(session).orderBy(order))
    rows = replies.withColumn("similarity", jaccard(F.col("_w"), before))
    return rows.where(F.col("similarity") > least).select(session, order, "similarity")


def cross_session_patterns(neighbours: DataFrame, floor: float = 0.82, least_rows: int = 3, least_sessions: int = 2, recent_days: int = 30) -> DataFrame:
    """Queries with enough near rows (query_id, session, cosine, age_days, party) from enough sessions, one of them recent at least; and
    whether one names somebody.  Rows without a session don't count as one."""
    near = neighbours.where(F.col("cosine") >= floor)
    out = near.groupBy("query_id").agg(
        F.count("*").alias("rows"), F.countDistinct("session").alias("sessions"), F.max("cosine").alias("closest"), F.max("party").alias("party"),
        F.max((F.col("age_days") <= recent_days).cast("int")).alias("_recent"),
    )
    return out.where((F.col("rows") >= least_rows) & (F.col("sessions") >= least_sessions) & (F.col("_recent") == 1)).drop("_recent")


#: Hosts of this machine and of private networks.
PRIVATE = r"^(localhost|127[.]|10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])"


def unlisted_urls(urls: DataFrame, allowed: DataFrame, slice_rows: int = 50_000) -> DataFrame:
    """URLs (id, host, path) for which no allowed host has a path that begins theirs, or the other way round; private hosts pass.

    Distinct URLs and allowed ones are sorted together by host and path, and cut into slices of about ``slice_rows``, so a host of many pages is in many tasks.
    In this order an allowed URL is followed by all that it begins; of allowed ones that begin each other the shortest is enough (a root).  So a URL is listed
    if the last root before it begins it, or if it begins the next allowed one.  What slices must know of each other is the root that reaches into
    them and the next allowed URL after them: two strings for each slice.
    """
    named = lambda rows, kind: rows.select(F.concat_ws("\0", "host", "path").alias("s"), F.lit(kind).alias("k"))
    public = urls.where(~F.col("host").rlike(PRIVATE))
    every = named(public, 0).unionByName(named(allowed, 1)).groupBy("s").agg(F.max("k").alias("allowed"), (F.min("k") == 0).alias("asked"))
    every = written(every, "urls")
    slices = max(1, -(-every.count() // slice_rows))
    cut = every.repartitionByRange(slices, "s").select("s", "allowed", "asked", F.spark_partition_id().alias("slice"))
    cut = written(cut, "slices")

    def ends(table: pa.Table) -> pa.Table:
        """First allowed string of a slice and its last root."""
        known = sorted(table.column("s").to_pylist())
        root = known[0]
        for s in known:
            root = root if s.startswith(root) else s
        return pa.table({"slice": table.column("slice")[:1], "first": [known[0]], "root": [root]}, schema=pa.schema([("slice", pa.int32()), ("first", pa.string()), ("root", pa.string())]))

    told = {r.slice: r for r in cut.where("allowed = 1").groupBy("slice").applyInArrow(ends, "slice int, first string, root string").collect()}  # two strings a slice
    reaching, following, root, first = {}, {}, None, None
    for k in range(slices):
        reaching[k] = root
        if k in told:
            root = root if root is not None and told[k].root.startswith(root) else told[k].root
    for k in reversed(range(slices)):
        following[k] = first
        first = told[k].first if k in told else first

    def unlisted(table: pa.Table) -> pa.Table:
        k = table.column("slice")[0].as_py()
        rows = sorted(zip(table.column("s").to_pylist(), table.column("allowed").to_pylist(), table.column("asked").to_pylist(), strict=True))
        root, bad = reaching[k], []
        for s, is_allowed, asked in rows:
            if root is None or not s.startswith(root):
                if is_allowed:
                    root = s
                elif asked:
                    bad.append(s)
        following_, out, at = following[k], [], len(rows) - 1
        for s in reversed(bad):
            while at >= 0 and rows[at][0] > s:
                following_ = rows[at][0] if rows[at][1] else following_
                at -= 1
            if following_ is None or not following_.startswith(s):
                out.append(s)
        return pa.table({"s": pa.array(out, pa.string())})

    bad = cut.groupBy("slice").applyInArrow(unlisted, "s string")
    return public.withColumn("s", F.concat_ws("\0", "host", "path")).join(bad, "s", "left_semi").drop("s")


def without_urls(text: Column, urls: Column) -> Column:
    """The text without some URLs (an array), the longest first, so that none is taken for a part of another."""
    longest = F.array_sort(urls, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))
    return F.trim(F.regexp_replace(F.aggregate(longest, text, lambda t, u: F.replace(t, u, F.lit(""))), r"[ \t]{2,}", " "))
