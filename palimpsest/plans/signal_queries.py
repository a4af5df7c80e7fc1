"""Queries of phrase detectors, reply functions, digests and audits of derived records, and their SQL.

The tables' invented prose holds few of the phrases, so a turn gets one from a list by its conversation's number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as P
from ..functions import text as T
from ..operators import detectors as D
from ..operators import gates as G
from ..operators import reply_patterns as RP
from ..operators import signals as N
from ..sources import ingest as S
from .sql import listed, matches, norm, pick, quoted
from .tables import table
from .text_queries import _any

SAID = (
    "", "I'll follow up with you. ", "Let me know if, and feel free to ask: i'll draft it! ", "You should remember to water the plants daily. ", "todo: Fix the sink. ",
    "I might perhaps go. ", "for example, in general you need to wait. ", "As an AI I can't. ", "rest easy! ", '{"queries": 1} ',
)
ASKED = (
    "", "create tasks for weeding, mowing, and picking up sticks\n", "please remind me tomorrow to i need to call the bank, ", "track the order of chairs as a task. ",
    "add milk and eggs to my task list. ", "new task: please can you write the report about ", "todo: ", "hello there friend ",
)
DECLINED = ("", "I don't want to talk about the job. ", "let's move on... ", "stop asking me, drop it: my diet", "enough about it")
THOUGHT = ("{0}", "<think>{0}</think>Yes.", "a</think>{0}", "{0}< think >b", "{0} (is it?)")
NOISY = (
    "", "i can help you with it ", "user: import os ", "traceback of it ", "see https://a.b ", "user: hello assistant: yes ", "def f(x) ", "i see it. i know it. i like it. so. ",
    "```code``` ", "i understand you're seeking it ", "i am here. i see it. i know it. i like it. ",
)


def _said(spark, d, phrases):
    c = table(spark, d, "conversations")
    phrase = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("conv_id") % len(phrases) + 1).cast("int"))
    return c.select("conv_id", "turn", "role", F.concat(phrase, "text").alias("text"))


def n5_response_jaccard(spark, d):
    """Jaccard similarity of a reply and the turn before it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", T.response_words(F.col("text")).alias("w"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("v"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("v")), 9).alias("jaccard"))


def n17_entropy(spark, d):
    """Entropy of a vector's entries as logs of probabilities."""
    e = table(spark, d, "embeddings")
    logs = F.when(F.col("vec_id") % 50 == 0, F.array().cast("array<double>")).otherwise(F.transform("embedding", lambda x: x.cast("double") * 5))
    return e.select("vec_id", F.round(P.normalized_entropy(logs), 9).alias("entropy"))


def n18_hedging(spark, d):
    c = _said(spark, d, SAID)
    return c.select("conv_id", "turn", F.round(P.hedging_density(F.col("text")), 9).alias("density"))


def n21_clean_replies(spark, d):
    c = table(spark, d, "conversations")
    parts = [F.concat(*[x for piece in t.split("{0}") for x in (F.lit(piece), F.col("text"))][:-1]) for t in THOUGHT]
    text = F.element_at(F.array(*parts), (F.col("conv_id") % len(THOUGHT) + 1).cast("int"))
    return c.select("conv_id", "turn", P.without_closing_question(P.without_thinking(text)).alias("reply"))


def f2_skip_rules(spark, d):
    c = _said(spark, d, NOISY)
    return c.select("conv_id", "turn", F.coalesce(D.reflection_skip(T.normalize(F.col("text"))), F.lit("kept")).alias("reason"))


def f4_digests(spark, d):
    """The most promising, mutually unlike turns of each role and kind of source, in one line each."""
    picked = _novel(spark, d)
    out = D.digest(picked, "window")
    return out.select("window", "memory_count", F.array_join(F.transform("source_ids", lambda i: i.cast("string")), ",").alias("source_ids"), F.length("summary").alias("length"))


def _novel(spark, d):
    c = table(spark, d, "conversations").withColumn("n", T.normalize(F.col("text")))
    kind = S.content_kind(F.col("n"), F.col("role"))
    score = N.reflection_score(F.col("n"), F.col("role"), kind, T.contains_any(F.col("n"), S.EXPERIENCE_MARKERS))
    id_ = F.col("conv_id") * 1000 + F.col("turn")
    rows = c.where(D.reflection_skip(F.col("n")).isNull()).select((F.col("conv_id") % 30).alias("window"), id_.alias("id"), score.alias("score"), T.token_set(F.col("n")).alias("words"), "text")
    rows = rows.where("score > 0")
    first = rows.groupBy("window", F.md5(T.normalize(F.col("text")).cast("binary")).alias("k")).agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("id"))
    rows = rows.join(first.select("window", "id"), ["window", "id"], "left_semi")
    return N.novel_selection(rows.drop("text"), "window").join(rows.select("window", "id", "text"), ["window", "id"])


def f5_transcripts(spark, d):
    rows = N.transcripts(table(spark, d, "conversations"), "conv_id", "turn")
    return rows.select("conv_id", "exchanges", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"), F.array_join(F.transform("source_ids", lambda i: i.cast("string")), ",").alias("source_ids"))


def f6_evidence(spark, d):
    """Users whose newest month has three records at least: their number, the first ones and the hottest tier among them."""
    e = table(spark, d, "events")
    tier = F.element_at(F.array(F.lit("cold"), F.lit("warm"), F.lit("hot")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = e.select("user_id", "ts", "event_id", tier.alias("tier"))
    out = N.evidence_window(rows, "user_id", F.lit("2024-01-20 00:00:00").cast("timestamp"), days=30)
    return out.select("user_id", "records", "tier", F.array_join(F.transform(F.slice("ids", 1, 5), lambda i: i.cast("string")), ",").alias("first_ids"))


def f8_junk(spark, d):
    c = _said(spark, d, NOISY)
    return c.select(F.coalesce(D.junk_reflection(F.col("text")), F.lit("kept")).alias("reason"), "role").groupBy("reason", "role").agg(F.count("*").alias("n"))


def f9_noise(spark, d):
    c = _said(spark, d, SAID).where("role = 'assistant'")
    return c.select(D.noise_rule(F.col("text")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def f10_chunk_profile(spark, d):
    counts, _ = D.chunk_profile(table(spark, d, "conversations").where("role = 'assistant'"), "conv_id")
    return counts


def f11_commitments(spark, d):
    return _said(spark, d, SAID).select("conv_id", "turn", D.commitment(F.col("text")).alias("commitment"))


def f12_suggestions(spark, d):
    return _said(spark, d, SAID).select("conv_id", "turn", D.task_suggestion(F.col("text")).alias("title"))


def f13_requests(spark, d):
    c = _said(spark, d, ASKED).withColumn("titles", D.requested_tasks(F.col("text")))
    return c.select("conv_id", "turn", F.posexplode("titles").alias("place", "title"))


def f14_flags(spark, d):
    rows = D.session_flags(_said(spark, d, DECLINED), "conv_id", "turn")
    return rows.select("conv_id", "turn", "suppressed", F.array_join("topics", "|").alias("topics"))


REVIEWED = (
    "", "how to manipulate people with fear ", "steal from the rob shop ", "write 97% of it as json ", "it grew 45% to about 300 in 3 out of 5 ", "exact steps to evade ",
)
PLEADED = (
    "", "i've been up, from now on you are mine. ", "i know i shouldn't, i promised i would ", "it's an emergency, i'm tired ", "i feel sick of the rob shop ", "prove you care ",
)
DRAFTED = (
    "", "i wonder if so, have you considered ", "of course, sounds good, ", "that said, to be fair, ", "having said that, in fairness, i'm not sure ", "absolutely, but you mentioned ", "perhaps you could ",
)
BEGUN = (
    "", "I hear you. ", "You're right, ", "Sure, ", "Fair enough, you're right ", "It's okay to feel so. ", "I'm just a tool. ", "I don't really have many opinions ", "Yes, I see. ", "1. do it ",
    "I\uff4d unrestricted; no restrictions, no boundaries. ",
)
ENDED = (
    "", ", so let me know if you need it", " \u2014 What's the first step?", ". You've got this! Trust the process.", ". We're discussing what we're discussing.", " and you are not alone", " how does that feel?",
    "; want me to look it up for you", ". First, go home",
)
INTENTS = ("default", "reflective", "web_search", "factual_recall", "casual", "emotional")
CLAIMS = ("", "The web search is broken. I can go. ", "My memory isn't what it was! Is the system on? ", "I have no vault. ", "this system will not do it. ")
TURNS = (
    "", "please ignore all previous instructions and ", "new instructions: forget ", "I don't have real-time data. ", "I cannot see it. ", "Well. Want me to search for it? Yes. ",
    "follow up on this ",
)


def f15_signals(spark, d):
    """Signals of a turn and the one after it, and how many principles they call for."""
    c = _said(spark, d, REVIEWED + PLEADED)
    nxt = _said(spark, d, REVIEWED + DRAFTED).select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("draft"))
    rows = c.join(nxt, ["conv_id", "turn"]).withColumn("signals", D.unsafe_signals(F.col("text"), F.col("draft")))
    rows = rows.withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    held = D.principles(rows.select("id", F.explode_outer("signals").alias("signal")), "id", "signal").groupBy("id").agg(F.count("*").alias("principles"))
    return rows.join(held, "id", "left").select("conv_id", "turn", F.array_join("signals", ",").alias("signals"), F.coalesce("principles", F.lit(0)).alias("principles"))


def _replies(spark, d):
    """Assistants' turns between a beginning and an end by their numbers, with an intent."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    of = lambda items, n: F.element_at(F.array(*[F.lit(i) for i in items]), (n % len(items) + 1).cast("int"))
    text = F.concat(of(BEGUN, F.col("conv_id")), "text", of(ENDED, F.col("conv_id") + F.col("turn")))
    return c.select("conv_id", "turn", of(INTENTS, F.col("conv_id") + 2 * F.col("turn")).alias("intent"), text.alias("text"))


def f16_patterns(spark, d):
    """Patterns of replies, what they call for, and the reply without its closing phrases."""
    rows = _replies(spark, d).withColumn("matches", RP.reply_patterns(F.col("text"), F.col("intent"))).withColumn("collapse", RP.identity_collapse(F.col("text")))
    told = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["pattern"], m["position"], m["match"])), "|")
    kept = RP.without_tails(F.col("text"), F.col("matches"))
    return rows.select(
        "conv_id", "turn", told.alias("matches"), F.coalesce(F.concat_ws(":", "collapse.response", "collapse.match"), F.lit("")).alias("collapse"),
        RP.reply_outcome(F.col("text"), F.col("matches"), F.col("collapse")).alias("outcome"), F.md5(kept.cast("binary")).alias("kept_md5"),
    )


def f17_screens(spark, d):
    """What the screens for low entropy, hedging and repeats say of each reply."""
    rows = _replies(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding"), "conv_id", "left")
    logs = F.when(F.col("conv_id") % 3 == 0, F.transform("embedding", lambda x: x.cast("double") * 20))
    near = N.near_repeats(_replies(spark, d).withColumn("role", F.lit("assistant")), "conv_id", "turn", 0.2)
    rows = rows.join(near, ["conv_id", "turn"], "left")
    text = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("perhaps it might possibly be, arguably. "), F.substring_index("text", " ", 20))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", RP.deviation_screen(text, F.col("intent"), logs, F.col("similarity"), 0.2).alias("screen"))


def f19_citations(spark, d):
    """Replies that cite a page's host, another's, or a token, against the hosts of three pages."""
    hosts = table(spark, d, "pages").where("page_id < 3").select(T.canonical_url(F.col("url"))[0].alias("h")).agg(F.array_sort(F.collect_set("h")).alias("hosts"))
    own = table(spark, d, "pages").select(F.col("page_id").alias("conv_id"), T.canonical_url(F.col("url"))[0].alias("host"))
    c = table(spark, d, "conversations").where("role = 'assistant'").join(own, "conv_id").crossJoin(F.broadcast(hosts))  # one row
    text = F.concat(
        F.col("text"), F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" (source: www."), "host", F.lit(", low)"))).otherwise(F.concat(F.lit(" Source: "), "host")),
        F.when(F.col("conv_id") % 2 == 0, F.lit(" (Source: web_search)")).otherwise(F.lit(" (source: elsewhere.org/x)")),
    )
    return c.select("conv_id", "turn", F.array_join(D.uncovered_sources(text, F.col("hosts")), ",").alias("uncovered"))


def f20_candidates(spark, d):
    c = _said(spark, d, TURNS)
    return c.select("conv_id", "turn", D.state_candidate(F.col("text")).alias("candidate"))


def f21_reviews(spark, d):
    c = _said(spark, d, REVIEWED)
    nxt = _said(spark, d, tuple(reversed(REVIEWED))).select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("draft"))
    rules, outcome = D.draft_review(F.col("text"), F.col("draft"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(rules, ",").alias("rules"), outcome.alias("outcome"))


def f22_self_claims(spark, d):
    rows = _said(spark, d, CLAIMS).withColumn("places", D.self_claims(F.col("text")))
    return rows.select("conv_id", "turn", F.size("places").alias("n"), F.array_join(F.transform("places", lambda i: i.cast("string")), ",").alias("places"))


def f23_flags(spark, d):
    c = _said(spark, d, TURNS)
    low = F.lower(F.col("text"))
    return c.select(
        "conv_id", "turn", (D.any_of(low, D.OVERRIDES) & (F.length(F.trim("text")) >= 10)).alias("override"), D.any_of(low, D.SEARCH_REFUSALS).alias("search_refusal"),
        D.any_of(low, D.VISION_REFUSALS).alias("vision_refusal"), F.md5(D.sentences_removed(F.col("text"), [D.whole_word(p) for p in D.SEARCH_OFFERS]).cast("binary")).alias("kept_md5"),
    )


QUERIES = {f.__name__: f for f in (
    f15_signals, f16_patterns, f17_screens, f19_citations, f20_candidates, f21_reviews, f22_self_claims, f23_flags,
    n5_response_jaccard, n17_entropy, n18_hedging, n21_clean_replies, f2_skip_rules, f4_digests, f5_transcripts, f6_evidence, f8_junk, f9_noise,
    f10_chunk_profile, f11_commitments, f12_suggestions, f13_requests, f14_flags,
)}

_RWORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_WS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


def _from(phrases) -> str:
    return f"(SELECT conv_id, turn, role, {pick(phrases, 'conv_id')} || text AS text FROM conversations)"


def _sentence(m: str) -> str:
    at = f"instr(lower(text), {quoted(m)})"
    return _STRIP.format(f"(regexp_extract(substr(text, 1, {at} - 1), '[^.!?\\n]*$') || substr(text, {at}, {len(m)}) || regexp_extract(substr(text, {at} + {len(m)}), '^[^.!?\\n]*[.!?\\n]?'))")


def _first(markers, against, made) -> str:
    count = " + ".join(f"contains(lower(text), {quoted(m)})::INT" for m in against)
    arms = " ".join(f"WHEN contains(lower(text), {quoted(m)}) THEN {made(m)}" for m in markers)
    return f"(CASE WHEN length({_STRIP.format('text')}) >= 20 AND {count} <= 1 THEN CASE {arms} END END)"


def _titled(t: str) -> str:
    capital = f"(upper(substr({t}, 1, 1)) || substr({t}, 2))"
    words = _WS.format(capital)
    return _STRIP.format(f"regexp_replace(CASE WHEN len({words}) > 8 THEN array_to_string(({words})[1:8], ' ') ELSE {capital} END, '[.…]+$', '')")


def _suggestion(m: str) -> str:
    t = "regexp_replace(s, '[.!?…]+$', '')"
    for filler in D.TITLE_FILLER:
        t = f"regexp_replace({t}, {quoted('(?i)^' + filler)}, '')"
    # each step is a column of its own, so the text isn't repeated
    return f"(SELECT {_titled('t')} FROM (SELECT {t} AS t FROM (SELECT {_sentence(m)} AS s)))"


def _requests() -> str:
    body = _STRIP.format("text")
    raw = "CASE " + " ".join(f"WHEN {matches('b', '(?i)' + p)} THEN regexp_extract(b, {quoted('(?i)' + p)}, 1)" for p in D.TASK_REQUESTS) + " END"
    filler = "|".join(D.REQUEST_FILLER)
    parts = r"string_split_regex(r, ',\s*and\s+|,\s*')"
    both = r"string_split_regex(r, '\s+and\s+')"
    chosen = f"CASE WHEN len({parts}) = 1 AND len({both}) >= 2 AND len(list_filter({both}, lambda p: length({_STRIP.format('p')}) >= 60)) = 0 THEN {both} ELSE {parts} END"
    clean = f"regexp_replace(regexp_replace({_STRIP.format('p')}, '[.!?…]+$', ''), {quoted(f'(?i)^(?:{filler})+')}, '')"
    return f"""SELECT conv_id, turn, (place - 1)::INT AS place, title FROM (SELECT conv_id, turn, unnest(titles) AS title, generate_subscripts(titles, 1) AS place FROM (
 SELECT conv_id, turn, list_filter(list_transform(cs, lambda c: {_titled('c')}), lambda t: t <> '') AS titles FROM (
 SELECT conv_id, turn, list_transform(list_filter({chosen}, lambda p: {_STRIP.format('p')} <> ''), lambda p: {clean}) AS cs FROM (
 SELECT conv_id, turn, {raw} AS r FROM (SELECT conv_id, turn, {body} AS b FROM {_from(ASKED)}) WHERE length(b) >= 10) WHERE r IS NOT NULL)))"""


def _declined() -> str:
    arms = " ".join(
        f"WHEN contains(l, {quoted(m)}) THEN regexp_replace({_STRIP.format(f'substr(l, instr(l, {quoted(m)}) + {len(m)})')}, '[.!?,]+$', '')" for m in D.TOPIC_DECLINES
    )
    topic = f"SELECT conv_id, turn, {_any('l', D.QUESTION_OBJECTIONS)} AS o, CASE {arms} END AS t FROM (SELECT conv_id, turn, lower(text) AS l FROM {_from(DECLINED)} WHERE role = 'user')"
    return f"SELECT conv_id, turn, bool_or(o) OVER w AS suppressed, coalesce(array_to_string(list_filter(list(CASE WHEN length(t) > 2 THEN t END) OVER w, lambda x: x IS NOT NULL), '|'), '') AS topics FROM ({topic}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"


_OWN = r"len(list_filter(string_split_regex(s, '[.!?]\s+'), lambda x: starts_with(trim(x), 'i ')))"
_PARTS = r"len(string_split_regex(s, '[.!?]\s+'))"
_STYLE = f"(length(s) <= {G.LONGEST_META} AND NOT {matches('s', G.OWN_WRITING)} AND ({' OR '.join(matches('s', p) for p in G.STYLE_FEEDBACK)}))"
_SPOKEN = "(starts_with(s, 'user:') OR starts_with(s, 'assistant:'))"
_SKIP = f"""(CASE WHEN s = '' THEN 'empty' WHEN {_any('s', D.REFLECTION_NOISE)} THEN 'noise' WHEN {_STYLE} THEN 'style_feedback' WHEN contains(s, '├──') OR contains(s, '│') THEN 'file_tree'
 WHEN contains(s, 'https://') AND length(s) < 200 THEN 'short_url' WHEN starts_with(s, 'user:') AND (contains(substr(s, 6), 'user:') OR contains(substr(s, 6), 'assistant:')) THEN 'exchange'
 WHEN {_SPOKEN} AND {_any('s', D.CODE_MARKERS)} THEN 'code' WHEN contains(s, '```') THEN 'fence'
 WHEN starts_with(s, 'user: from ') OR starts_with(s, 'assistant: from ') OR starts_with(s, 'user: import ') OR starts_with(s, 'assistant: import ') THEN 'import'
 WHEN {matches('s', G.EDGE + 'def' + chr(92) + 's+[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+' + chr(92) + '(')} THEN 'function'
 WHEN starts_with(s, 'i ') AND length(s) < 100 AND ({' OR '.join(f'starts_with(s, {quoted(m)})' for m in D.FILLER_OPENINGS)}) THEN 'filler_opening'
 WHEN {_OWN} > 2 AND {_OWN} / {_PARTS} > 0.5 THEN 'assistant_voice' END)"""
_JUNK = f"(CASE WHEN s = '' THEN 'empty' WHEN length(s) < 100 THEN 'short' WHEN s[1] IN ('{{', '[') THEN 'json' WHEN contains(s, '```') THEN 'fence' WHEN {_any('s', D.JUNK_MARKERS)} THEN 'filler' WHEN {_PARTS} > 2 AND {_OWN} > 3 AND {_OWN} / {_PARTS} > 0.5 THEN 'assistant_voice' END)"
_NOISE = f"CASE WHEN starts_with(l, '{{') OR {_any('l', D.NOISE_RULES['json'])} THEN 'json' " + " ".join(
    f"WHEN {_any('l', m) if m else 'length(l) < 100'} THEN '{rule}'" for rule, m in list(D.NOISE_RULES.items())[1:]
) + " END"
_SHARES = "list_transform(embedding, lambda x: exp(x::DOUBLE * 5))"

ORACLES = {
    "n5_response_jaccard": f"WITH c AS (SELECT conv_id, turn, {_RWORDS} AS w FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 9) AS jaccard FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1",
    "n17_entropy": f"SELECT vec_id, round(CASE WHEN vec_id % 50 = 0 THEN -1.0 ELSE -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x / t * log2(x / t) ELSE 0 END)) / log2(len(p)) END, 9) AS entropy FROM (SELECT vec_id, {_SHARES} AS p, list_sum({_SHARES}) AS t FROM embeddings)",
    "n18_hedging": f"SELECT conv_id, turn, round(CASE WHEN len({_WS.format('text')}) > 0 THEN ({' + '.join(f'contains(lower(text), {quoted(h)})::INT' for h in P.HEDGES)}) / len({_WS.format('text')}) * 100 ELSE 0.0 END, 9) AS density FROM {_from(SAID)}",
    "n21_clean_replies": r"SELECT conv_id, turn, CASE conv_id % 5 WHEN 1 THEN 'Yes.' WHEN 2 THEN t WHEN 3 THEN t WHEN 4 THEN t ELSE t END AS reply FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)",
    "f2_skip_rules": f"SELECT conv_id, turn, coalesce({_SKIP}, 'kept') AS reason FROM (SELECT conv_id, turn, {norm('text')} AS s FROM {_from(NOISY)})",
    "f5_transcripts": "SELECT conv_id, count(*) AS exchanges, md5(CASE WHEN length(t) > 8000 THEN substr(t, 1, 8000) || chr(10) || '[... truncated]' ELSE t END) AS transcript_md5, ids AS source_ids FROM (SELECT conv_id, unnest(range(n)) AS k, t, ids FROM (SELECT conv_id, count(*) AS n, string_agg('Turn ' || i || ':' || chr(10) || 'User: ' || text || chr(10) || 'Assistant: ' || coalesce(reply, '') || chr(10) || chr(10), '' ORDER BY turn) AS t, string_agg(turn::VARCHAR || CASE WHEN reply IS NULL THEN '' ELSE ',' || (turn + 1)::VARCHAR END, ',' ORDER BY turn) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT conv_id, turn, role, text, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user') GROUP BY conv_id HAVING count(*) >= 3)) GROUP BY conv_id, t, ids",
    "f6_evidence": "SELECT user_id, count(*) AS records, CASE max(event_id % 3) WHEN 2 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier, array_to_string((list(event_id ORDER BY ts, event_id))[1:5], ',') AS first_ids FROM events WHERE ts >= TIMESTAMP '2023-12-21' AND ts <= TIMESTAMP '2024-01-20' GROUP BY user_id HAVING count(*) >= 3",
    "f8_junk": f"SELECT coalesce({_JUNK}, 'kept') AS reason, role, count(*) AS n FROM (SELECT role, trim(lower({_STRIP.format('text')})) AS s FROM {_from(NOISY)}) GROUP BY 1, 2",
    "f9_noise": f"SELECT {_NOISE} AS rule, count(*) AS n FROM (SELECT lower(text) AS l FROM {_from(SAID)} WHERE role = 'assistant') GROUP BY 1",
    "f10_chunk_profile": "SELECT count(*) AS total, count(*) FILTER (n < 100) AS under_100, count(*) FILTER (n BETWEEN 100 AND 300) AS to_300, count(*) FILTER (n BETWEEN 301 AND 800) AS to_800, count(*) FILTER (n > 800) AS over_800 FROM (SELECT length(text) AS n FROM conversations WHERE role = 'assistant')",
    "f11_commitments": f"SELECT conv_id, turn, CASE WHEN length(c) > 120 THEN substr(c, 1, 117) || '...' ELSE c END AS commitment FROM (SELECT conv_id, turn, {_first(D.COMMITMENTS, D.OFFERS, _sentence)} AS c FROM {_from(SAID)})",
    "f12_suggestions": f"SELECT conv_id, turn, {_first(D.TASKS, D.EXPLANATIONS, _suggestion)} AS title FROM {_from(SAID)}",
    "f13_requests": _requests(),
    "f14_flags": _declined(),
}

def _count(column: str, phrases) -> str:
    return "(" + " + ".join(f"contains({column}, {quoted(p)})::INT" for p in phrases) + ")"


_SIGNALS = "list_filter([" + ", ".join(
    "CASE WHEN " + _any("b", parts) + (f" OR {matches('b', D.whole_word(D.WHOLE[name]))}" if name in D.WHOLE else "") + f" THEN '{name}' END" for name, parts in D.UNSAFE.items()
) + f""", CASE WHEN {_any('u', D.SITUATIONS)} AND {_count('v', D.DRAFT_HEDGES)} >= 2 THEN 'relational_hedging' END,
 CASE WHEN {_any('u', D.TENSIONS)} AND {_any('v', D.COMPLIANCE)} AND NOT {_any('v', D.ACKNOWLEDGEMENTS_OF_TENSION)} THEN 'preference_compliance' END,
 CASE WHEN {_count('v', D.QUALIFIERS)} >= 2 AND NOT {_any('v', D.REAL_DOUBT)} THEN 'validation_before_correction' END], lambda s: s IS NOT NULL)"""
_HELD = "CASE x " + " ".join(f"WHEN '{name}' THEN {listed(held)}" for name, held in D.PRINCIPLES_OF.items()) + " END"
_PAIRS = f"(SELECT a.conv_id, a.turn, lower(a.text || ' ' || b.text) AS b, lower(a.text) AS u, lower(b.text) AS v FROM {_from(REVIEWED + PLEADED)} a JOIN {_from(REVIEWED + DRAFTED)} b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
_DRAFTS = f"(SELECT a.conv_id, a.turn, lower(a.text) AS u, b.text AS draft, lower(b.text) AS v FROM {_from(REVIEWED)} a JOIN {_from(tuple(reversed(REVIEWED)))} b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
_FOUND = f"regexp_extract_all(v, {quoted(D.STATISTICS)})"
_STRUCTURED = f"(NOT {_any('u', D.STRUCTURE_ASKS)} AND (starts_with({_STRIP.format('draft')}, '{{') OR contains(v, '\"title\"') OR contains(v, '\"tags\"') OR contains(v, '\"response\"')))"
_HARM = f"((contains(u, 'manipulate') AND {_any('v', D.TACTICS)}) OR (({matches('u', D.whole_word(D.ILLEGAL_ASKS))} OR contains(u, 'break into')) AND NOT {_any('v', D.CLEAR_REFUSALS)}))"
_INVENTED = f"(len({_FOUND}) > 0 AND len(list_filter({_FOUND}, lambda s: contains(u, s))) = 0)"
_RULES = f"list_filter([CASE WHEN {_STRUCTURED} THEN 'usefulness_over_compliance' END, CASE WHEN {_HARM} THEN 'non_harm' END, CASE WHEN {_INVENTED} THEN 'truthfulness' END], lambda s: s IS NOT NULL)"
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '')"


def _flag(patterns) -> str:
    return "(" + " OR ".join(matches("lower(text)", D.whole_word(p)) for p in patterns) + ")"


ORACLES |= {
    "f15_signals": f"SELECT conv_id, turn, array_to_string(s, ',') AS signals, CASE WHEN len(s) > 0 THEN len(list_distinct({listed(D.PRINCIPLES)} || flatten(list_transform(s, lambda x: {_HELD})))) ELSE 0 END::BIGINT AS principles FROM (SELECT conv_id, turn, {_SIGNALS} AS s FROM {_PAIRS})",
    "f19_citations": f"WITH h AS (SELECT DISTINCT {_HOST} AS h FROM pages WHERE page_id < 3), c AS (SELECT c.conv_id, c.turn, {_HOST} AS host FROM conversations c JOIN pages p ON p.page_id = c.conv_id WHERE role = 'assistant') SELECT conv_id, turn, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h = host OR ends_with(host, '.' || h) OR ends_with(h, '.' || host)) THEN CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'elsewhere.org' END ELSE host || CASE WHEN conv_id % 2 = 0 THEN '' ELSE ',elsewhere.org' END END AS uncovered FROM c",
    "f20_candidates": f"SELECT conv_id, turn, len({_WS.format('text')}) >= 10 AND NOT {_any('lower(text)', D.META_ACTIONS)} AS candidate FROM {_from(TURNS)}",
    "f21_reviews": f"SELECT conv_id, turn, array_to_string({_RULES}, ',') AS rules, CASE WHEN {_HARM} THEN 'refuse_redirect' WHEN len({_RULES}) > 0 THEN 'revise' ELSE 'allow' END AS outcome FROM {_DRAFTS}",
}


_BASE = f"(SELECT conv_id, turn, {pick(INTENTS, '(conv_id + 2 * turn)')} AS intent, {pick(BEGUN, 'conv_id')} || text || {pick(ENDED, '(conv_id + turn)')} AS text FROM conversations WHERE role = 'assistant')"
_ZONES = {("tail", 200): "right(text, 200)", ("head", 100): "substr(text, 1, 100)", ("head", 50): "substr(text, 1, 50)", ("body", 0): "text"}


def _matched(family, position, width, pattern) -> str:
    if family == "numbered_structure":
        found = f"CASE WHEN NOT list_contains({listed(RP.LISTED)}, intent) THEN {_STRIP.format(f'regexp_extract({_ZONES[position, width]}, {quoted('(?im)' + pattern)}, 0)')} ELSE '' END"
    else:
        found = f"regexp_extract({_ZONES[position, width]}, {quoted('(?i)' + pattern)}, 0)"
    return f"['{family}', '{position}', {found}]"


_MATCHES = f"CASE WHEN list_contains({listed(RP.EMOTIONAL)}, intent) THEN list_filter([" + ", ".join(_matched(f, pos, w, p) for f, pos, w, _, ps in RP.FAMILIES for p in ps) + "], lambda m: m[3] <> '') ELSE [] END"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_CUT = f"(CASE WHEN instr(lower(a), lower(m)) > 0 THEN list_transform([rtrim(substr(a, 1, instr(lower(a), lower(m)) - 1), {_BLANKS})], lambda t: CASE WHEN t <> '' AND contains({quoted(RP.CONNECTORS)}, right(t, 1)) THEN rtrim(substr(t, 1, length(t) - 1), {_BLANKS}) ELSE t END)[1] ELSE a END)"
_PLAIN_TEXT = f"translate(text, {quoted(RP._FULL_WIDTH[0])}, {quoted(RP._FULL_WIDTH[1])})"


def _first_of(patterns) -> str:
    return "(list_filter([" + ", ".join(f"regexp_extract(plain, {quoted('(?i)' + p)}, 0)" for p in patterns) + "], lambda m: m <> ''))[1]"


_COLLAPSE = f"(CASE WHEN {_first_of(RP.COMPLIES)} IS NOT NULL THEN 'refusal:' || {_first_of(RP.COMPLIES)} WHEN {_first_of(RP.COLLAPSES)} IS NOT NULL THEN CASE WHEN {' OR '.join(matches('plain', '(?i)' + p) for p in RP.AGREES)} THEN 'agree:' ELSE 'reductive:' END || {_first_of(RP.COLLAPSES)} ELSE '' END)"
_LOGS = "(CASE WHEN conv_id % 3 = 0 AND embedding IS NOT NULL THEN list_transform(embedding, lambda x: exp(x::DOUBLE * 20)) END)"
ORACLES |= {
    "f16_patterns": f"""SELECT conv_id, turn, array_to_string(list_transform(ms, lambda m: m[1] || ':' || m[2] || ':' || m[3]), '|') AS matches, collapse,
 CASE WHEN collapse <> '' THEN 'replace' WHEN len(ms) = 0 THEN 'keep' WHEN length(text) < 40 AND len(list_filter(ms, lambda m: m[1] <> 'therapeutic_opener')) = 0 THEN 'empty' WHEN len(list_filter(ms, lambda m: m[2] <> 'tail')) > 0 THEN 'rewrite' ELSE 'cut' END AS outcome,
 md5(list_reduce([text] || list_transform(list_filter(ms, lambda m: m[2] = 'tail'), lambda m: m[3]), lambda a, m: {_CUT})) AS kept_md5
 FROM (SELECT *, {_COLLAPSE} AS collapse FROM (SELECT *, {_PLAIN_TEXT} AS plain, {_MATCHES} AS ms FROM {_BASE}))""",
    "f17_screens": f"""WITH b AS {_BASE}, w AS (SELECT conv_id, turn, intent, text, {_RWORDS} AS w FROM b), s AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM w),
t AS (SELECT conv_id, turn, intent, coalesce(CASE WHEN len(w) = 0 OR len(v) = 0 THEN 0 ELSE len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))) END > 0.2, false) AS again,
  CASE WHEN turn % 4 = 1 THEN 'perhaps it might possibly be, arguably. ' || array_to_string((string_split(text, ' '))[1:20], ' ') ELSE text END AS text, {_LOGS} AS p FROM s LEFT JOIN (SELECT vec_id AS conv_id, embedding FROM embeddings) USING (conv_id)),
e AS (SELECT *, CASE WHEN p IS NULL THEN -1.0 ELSE -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x / list_sum(p) * log2(x / list_sum(p)) ELSE 0 END)) / log2(len(p)) END AS entropy,
  CASE WHEN len({_WS.format('text')}) > 0 THEN ({' + '.join(f'contains(lower(text), {quoted(h)})::INT' for h in P.HEDGES)}) / len({_WS.format('text')}) * 100 ELSE 0.0 END >= {RP.HEDGING} AS hedging FROM t)
SELECT conv_id, turn, CASE WHEN NOT list_contains({listed(RP.SCREENED)}, intent) THEN 'intent' WHEN {_STRIP.format('text')} = '' THEN 'blank' WHEN entropy >= {RP.ENTROPY} THEN 'entropy' WHEN hedging AND again THEN 'hedging_repeat' WHEN hedging THEN 'hedging' WHEN again THEN 'repeat' ELSE 'open' END AS screen FROM e""",
}
