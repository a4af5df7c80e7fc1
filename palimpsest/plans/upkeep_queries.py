"""Queries of ingestion from end to end, nightly tiering and branch counters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import ranking as R
from ..operators import tiering as H
from ..sources import imports as I
from ..sources import ingest as S
from .record_queries import ORACLES as RECORD_ORACLES
from .record_queries import _exports
from .retrieval_queries import _FREQ, AS_OF, KINDS, _now
from .tables import table
from .text_queries import _CHUNKS, _CLEANED, _any
from .sql import norm

CHAT = "chat_export"


def s12_ingest(spark, d):
    """Documents and chats from their texts to indexed chunks with their store, metadata and content key."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), "text")
    chats = I.flatten_chats(_exports(spark, d), "payload", "file").withColumn("doc_id", 1_000_000_000 + F.regexp_extract("title", r"(\d+)$", 1).cast("long"))
    rows = I.ingestion(docs, chats, CHAT)
    told = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return rows.select("chunk_id", "target", F.coalesce("content_kind", F.lit("")).alias("content_kind"), told.alias("metadata"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _store(spark, d):
    """Users as records: what a run finds stored of each."""
    events = table(spark, d, "events")
    f = H.accumulated_frequency(events, "user_id").join(events.groupBy("user_id").agg(F.min("ts").alias("first_ts")), "user_id")
    u = F.col("user_id")
    silent = u % 5 == 0
    tier = F.when(u % 3 == 0, "hot").when(u % 3 == 1, "warm").when(u % 4 != 0, "cold")
    return f.select(
        u.alias("id"), F.expr(KINDS.format("user_id % 10")).alias("kind"), F.col("first_ts").alias("created"), F.when(~silent, F.col("last_ts")).alias("last_retrieved"),
        F.when(~silent, F.col("frequency")).alias("frequency"), tier.alias("tier"), F.when(u % 11 != 0, (u % 10) / 10).alias("heat_score"),
    )


def _edges(store):
    return store.where("kind = 'reflection' AND id % 4 <> 0").select(F.col("id").alias("derived"), F.explode(F.array(F.col("id") + 1, F.col("id") * 2 + 1)).alias("source"))


def _run(spark, d):
    store = _store(spark, d)
    return store, H.nightly_run(store, _edges(store), _now())


def t6_nightly(spark, d):
    """Transitions of a nightly run, those that were unchanged, written, and all."""
    return H.run_totals(_run(spark, d)[1])


def t6_writes(spark, d):
    """What the run writes."""
    return _run(spark, d)[1].where("written").select("id", "tier", F.round("heat", 8).alias("heat"))


def t7_moves(spark, d):
    """Records that move between tiers by the run."""
    store, run = _run(spark, d)
    return H.tier_moves(store, run)


def t7_shares(spark, d):
    """Tiers before the run and after it with the delivery history discarded."""
    store = _store(spark, d)
    run = H.nightly_run(H.without_signal(store), _edges(store), _now())
    return H.tier_shares(store, run).select("tier", "before", "after", F.round("share_before", 9).alias("share_before"), F.round("share_after", 9).alias("share_after"))


def t7_signals(spark, d):
    """Stored delivery signals before and after they are discarded."""
    store = _store(spark, d)
    return H.signal_counts(store).withColumn("state", F.lit("before")).unionByName(H.signal_counts(H.without_signal(store)).withColumn("state", F.lit("after")))


def a9_branches(spark, d):
    """Counters of predicates, of branches with their parent's evaluations, and of a reached site, over documents."""
    # normalized once a row, for all markers
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", F.explode(F.array(T.normalize(F.col("text")))).alias("_flat"))
    flat = F.col("_flat")
    predicates = {"skip.short": F.length(flat) < 40, "skip.fenced": F.when(F.length(flat) >= 40, F.contains("text", F.lit("```")))}
    branches = {"route.lang": F.col("lang"), "route.rule": F.coalesce(S.skip_reason(flat), F.lit("kept"))}
    return A.branch_counters(docs, branches, ["ingest.entered"], "doc_id", predicates)


def r7_states(spark, d):
    """Unresolved state records of each user, newest first, put in order by priority for users whose query has a policy that boosts states."""
    boosts = R.policies(spark).select("policy", "state_boost")
    names = F.array(*[F.lit(p[0]) for p in R.POLICIES])
    rows = table(spark, d, "events").where("event_type <> 'error'").withColumn("policy", names[(F.col("user_id") % len(R.POLICIES)).cast("int")])
    priority = F.element_at(F.array(*[F.lit(p) for p in ("high", "low", "medium", "urgent", None)]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = rows.join(F.broadcast(boosts), "policy")  # of ten rows
    return R.state_order(rows, "user_id", priority, F.col("state_boost"), [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "place")


QUERIES = {f.__name__: f for f in (r7_states, s12_ingest, t6_nightly, t6_writes, t7_moves, t7_shares, t7_signals, a9_branches)}

_STORED = f"""(SELECT f.user_id AS id, {KINDS.format('(f.user_id % 10)')} AS kind, first_ts AS created, CASE WHEN f.user_id % 5 <> 0 THEN last_ts END AS last_retrieved, CASE WHEN f.user_id % 5 <> 0 THEN frequency END AS frequency,
 CASE WHEN f.user_id % 3 = 0 THEN 'hot' WHEN f.user_id % 3 = 1 THEN 'warm' WHEN f.user_id % 4 <> 0 THEN 'cold' END AS tier, CASE WHEN f.user_id % 11 <> 0 THEN f.user_id % 10 / 10 END AS heat_score
 FROM {_FREQ} f JOIN (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY 1) USING (user_id))"""
_DAYS = f"greatest(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(seen)) / 86400000000.0), 0)"


def _ran(silent: bool) -> str:
    seen = "created" if silent else "coalesce(last_retrieved, created)"
    frequency = "0.0" if silent else "coalesce(frequency, 0)"
    return f"""WITH st AS {_STORED}, a AS (SELECT *, {seen} AS seen, {frequency} AS f, coalesce(tier, 'hot') AS old_tier, CASE WHEN coalesce(heat_score, 0) = 0 THEN 1.0 ELSE heat_score END::DOUBLE AS old_heat FROM st),
r AS (SELECT *, CASE WHEN kind IN ('profile', 'ingested') THEN 1.0 WHEN kind IN ('conversation', 'journal') THEN pow(2.0, -{_DAYS} / 15.0) WHEN kind = 'reflection' THEN pow(2.0, -{_DAYS} / 122.0) ELSE pow(2.0, -{_DAYS} / 52.0) END AS rec FROM a),
h AS (SELECT *, greatest(rec * 0.625 + least(f * rec / 10.0, 1.0) * 0.375, CASE WHEN kind = 'profile' THEN 0.5 ELSE 0 END::DOUBLE) AS heat FROM r),
t AS (SELECT *, CASE WHEN kind = 'profile' OR heat >= 0.5 THEN 2 WHEN heat >= 0.2 THEN 1 ELSE 0 END AS rk FROM h),
e AS (SELECT id AS derived, unnest([id + 1, id * 2 + 1]) AS source FROM st WHERE kind = 'reflection' AND id % 4 <> 0),
b AS (SELECT derived, max(CASE old_tier WHEN 'hot' THEN 2 WHEN 'warm' THEN 1 WHEN 'cold' THEN 0 END) AS bound FROM e LEFT JOIN a ON a.id = e.source GROUP BY 1),
run AS (SELECT t.id, t.kind, old_tier, old_heat, heat, ['cold', 'warm', 'hot'][CASE WHEN t.kind = 'reflection' THEN least(rk, coalesce(bound, 0)) ELSE rk END + 1] AS tier FROM t LEFT JOIN b ON b.derived = t.id),
w AS (SELECT *, tier <> old_tier OR abs(heat - old_heat) > 0.01 AS written FROM run)
"""


_MOVES = ", ".join(f"('{a}_to_{b}', count(*) FILTER (old_tier = '{a}' AND tier = '{b}'))" for a in ("hot", "warm", "cold") for b in ("hot", "warm", "cold") if a != b)
_NAMED = ", ".join(f"'{a}_to_{b}'" for a in ("hot", "warm", "cold") for b in ("hot", "warm", "cold") if a != b) + ", 'unchanged', 'total', 'written'"
_VALUES = ", ".join(f"count(*) FILTER (old_tier = '{a}' AND tier = '{b}')" for a in ("hot", "warm", "cold") for b in ("hot", "warm", "cold") if a != b) + ", count(*) FILTER (old_tier = tier), count(*), count(*) FILTER (written)"
_META = "'chunk_id=' || chunk_id || ';chunk_index=' || i || "
_SAID = RECORD_ORACLES["s7_message_chunks"]
_SITES = f"""(SELECT doc_id, unnest([{{'site': 'skip.short', 'kind': 'predicate', 'parent': NULL, 'n': 1, 'f': (length(s) < 40)::INT}}, {{'site': CASE WHEN length(s) >= 40 THEN 'skip.fenced' END, 'kind': 'predicate', 'parent': NULL, 'n': 1, 'f': contains(text, '```')::INT}},
 {{'site': 'route.lang', 'kind': 'parent', 'parent': NULL, 'n': 1, 'f': 0}}, {{'site': 'route.lang=' || lang, 'kind': 'branch', 'parent': 'route.lang', 'n': 0, 'f': 1}}, {{'site': 'route.rule', 'kind': 'parent', 'parent': NULL, 'n': 1, 'f': 0}},
 {{'site': 'route.rule=' || rule, 'kind': 'branch', 'parent': 'route.rule', 'n': 0, 'f': 1}}, {{'site': 'ingest.entered', 'kind': 'reached', 'parent': NULL, 'n': 1, 'f': 1}}]) AS x FROM (SELECT *, {{skip}} AS rule FROM (SELECT doc_id, text, lang, {norm('text')} AS s FROM documents)))"""


def _worth(content: str) -> str:
    return f"NOT (s = '' OR length(s) < least_ OR {_any('s', S.META_MARKERS)} OR s[1] IN ('{{', '[') OR contains({content}, '```'))"


def _ingested() -> str:
    from .text_queries import _skip_sql

    plain = f"SELECT doc_id || '_chunk_' || i AS chunk_id, doc_id, i, source, chunk AS content, 'ingested/ingested' AS target, '' AS content_kind, NULL AS role, 40 AS least_ FROM {_CHUNKS.format(_CLEANED)}"
    said = f"""SELECT 1000000000 + split_part(chunk_id, '_', 1)::BIGINT || '_chunk_' || split_part(chunk_id, '_', 3) AS chunk_id, 1000000000 + split_part(chunk_id, '_', 1)::BIGINT AS doc_id, split_part(chunk_id, '_', 3)::INT AS i, '{CHAT}' AS source, content,
 CASE WHEN role = 'user' THEN 'memory/conversation' ELSE 'ingested/ingested' END AS target, content_kind, role, CASE WHEN role = 'user' THEN 0 ELSE 40 END AS least_ FROM ({_SAID.replace('md5(m) AS content_md5', 'm AS content')}) WHERE index_for_retrieval"""
    meta = "'chunk_id=' || chunk_id || ';chunk_index=' || i || CASE WHEN role IS NULL THEN '' ELSE ';content_kind=' || content_kind END || ';doc_id=' || doc_id || CASE WHEN role IS NULL THEN '' ELSE ';role=' || role END || ';source=' || source || ';title=' || CASE WHEN role IS NULL THEN 't' || doc_id ELSE 'chat ' || (doc_id - 1000000000) END"
    return f"SELECT chunk_id, target, content_kind, {meta} AS metadata, md5(content) AS content_md5 FROM (SELECT *, {norm('content')} AS s FROM ({plain} UNION ALL {said})) WHERE {_worth('content')}"


def _counted() -> str:
    from .text_queries import _skip_sql

    sites = _SITES.replace("{skip}", _skip_sql())
    return f"""WITH c AS (SELECT x.site AS site, any_value(x.kind) AS kind, any_value(x.parent) AS parent, sum(x.n)::BIGINT AS evaluations, sum(x.f)::BIGINT AS firings, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM {sites} WHERE x.site IS NOT NULL GROUP BY 1)
SELECT c.*, coalesce(p.evaluations, c.evaluations) AS denominator FROM c LEFT JOIN c p ON p.site = c.parent"""


_BOOSTS = "[" + ", ".join(str(p[5]) for p in R.POLICIES) + "]"
ORACLES = {
    "r7_states": f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN ({_BOOSTS})[user_id % {len(R.POLICIES)} + 1] <> 0 THEN CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END ELSE 0 END DESC, ts DESC, event_id DESC)::INT AS place FROM events WHERE event_type <> 'error'",
    "s12_ingest": _ingested(),
    "t6_nightly": _ran(False) + f"SELECT unnest([{_NAMED}]) AS name, unnest([{_VALUES}]) AS n FROM w",
    "t6_writes": _ran(False) + "SELECT id, tier, round(heat, 8) AS heat FROM w WHERE written",
    "t7_moves": _ran(False) + "SELECT coalesce(st.tier, '(none)') AS old, w.tier AS new, count(*) AS n, min(w.id) AS first_id FROM w JOIN st ON st.id = w.id GROUP BY 1, 2",
    "t7_shares": _ran(True) + "SELECT tier, coalesce(b, 0)::BIGINT AS before, coalesce(a, 0)::BIGINT AS after, round(coalesce(b, 0) / (SELECT count(*) FROM st), 9) AS share_before, round(coalesce(a, 0) / (SELECT count(*) FROM w), 9) AS share_after FROM (SELECT coalesce(tier, '(none)') AS tier, count(*) AS b FROM st GROUP BY 1) x FULL JOIN (SELECT tier, count(*) AS a FROM w GROUP BY 1) y USING (tier)",
    "t7_signals": f"SELECT 'before' AS state, count(*) AS rows, count(last_retrieved) AS with_last_retrieved, count(*) FILTER (coalesce(frequency, 0) > 0) AS with_frequency FROM {_STORED} UNION ALL SELECT 'after', count(*), 0, 0 FROM {_STORED}",
    "a9_branches": _counted(),
}
