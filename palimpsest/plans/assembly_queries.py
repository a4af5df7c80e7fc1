"""Queries of the full context assembly and its parts, and their SQL.

Records are ``embeddings`` with the text of the document of the same id; kinds come from labels, other properties from the id
(see ``records``).  Queries are the items of ``benchmark`` after a beginning that gives them different policies.
"""

from __future__ import annotations



from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as A
from ..operators import gates as G
from ..operators import ranking as R
from ..sources import ingest as S
from .retrieval_queries import KINDS
from .sql import listed as _list
from .sql import matches as _matches
from .sql import norm as _norm
from .sql import pick as _pick
from .sql import bare_sql as _bare
from .sql import curly as _curly
from .sql import policy_sql, relational_sql
from .sql import quoted as _quoted
from .sql import rule_sql as _rule
from .tables import table
from .text_queries import AS_OF, NORM, WORDS, _any

BEGINNINGS = ("", "When did Buddy say that ", "status of ", "what are my open loops, ", "my son and Walter of ", "find ", "thanks. ", "I fix the weather for ")
DIVERSE = ("what patterns ", "lately ", "recently building ", "working on ")
CONTENT_KINDS = ("experience", "question", "user_content", "other")
#: Floors that suit the random vectors of the tables.
FLOOR, USUAL, INGESTED = 0.1, 0.3, 0.2
MARKERS = S.META_MARKERS


def records(spark, d):
    poor = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id")).distinct().withColumn("suppressed", F.lit(True))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", "lang")
    e = table(spark, d, "embeddings").withColumn("kind", F.expr(KINDS.format("label"))).join(docs, "vec_id").join(poor, "vec_id", "left")
    v = F.col("vec_id")
    role = F.when((F.col("kind") == "conversation") & (v % 5 == 4), "assistant").otherwise("user")
    own = F.col("kind").isin("profile", "journal") | ((F.col("kind") == "conversation") & (role == "user"))
    return e.select(
        "vec_id", "kind", "text", "embedding", "suppressed", role.alias("role"),
        F.element_at(F.array(*[F.lit(t) for t in ("hot", "warm", "cold")]), (v % 3 + 1).cast("int")).alias("tier"),
        F.element_at(F.array(*[F.lit(k) for k in CONTENT_KINDS]), (v % 4 + 1).cast("int")).alias("content_kind"),
        F.when(own, "first_person").when(role == "assistant", "mixed").otherwise("unknown").alias("authorship"),
        F.timestamp_micros(F.unix_micros(F.lit(AS_OF).cast("timestamp")) - v * 13 % 500 * 86_400_000_000).alias("created"),
        (v % 7).alias("project_id"), F.col("source").alias("doc"), F.concat("source", F.lit(" "), "lang").alias("title"),
    )


def asked(spark, d, beginnings=BEGINNINGS):
    begin = F.element_at(F.array(*[F.lit(b) for b in beginnings]), (F.col("item_id") % len(beginnings) + 1).cast("int"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    rows = table(spark, d, "benchmark").join(vectors, "item_id")
    return rows.select(F.col("item_id").alias("query_id"), F.concat(begin, "text").alias("text"), "embedding", (F.col("item_id") % 7).alias("project_id"))


def _now():
    return F.lit(AS_OF).cast("timestamp")


def r12_assembly(spark, d):
    """What each query gets, from its channels to its slots."""
    return A.assemble(asked(spark, d), records(spark, d), _now(), MARKERS, None, FLOOR, USUAL, INGESTED)


def r10_diversity(spark, d):
    """The same for queries whose policies want diversity."""
    return A.assemble(asked(spark, d, DIVERSE), records(spark, d), _now(), MARKERS, None, FLOOR, USUAL, INGESTED)


def _channels(spark, d):
    return A.channels(A.searched(A.described_queries(asked(spark, d)), records(spark, d), MARKERS), FLOOR)


def v9_v13_channels(spark, d):
    """Memory, reflection and profile channels, merged and parted."""
    return _channels(spark, d).select("query_id", "vec_id", "channel", F.round("found", 8).alias("found"))


def v6_entities(spark, d):
    q = asked(spark, d)
    return q.select("query_id", F.array_join(G.entity_names(F.col("text")), ",").alias("names"))


def p3_bare_search(spark, d):
    """Whether the beginning of a turn, as a query, is a bare request for a search."""
    asks = ("search the web please", "google it for me, thanks!", "look it up now", "can you find online the", "web search", "thank you")
    c = table(spark, d, "conversations")
    ask = F.element_at(F.array(*[F.lit(a) for a in asks]), (F.col("conv_id") % len(asks) + 1).cast("int"))
    q = F.lower(F.when(F.col("turn") % 2 == 0, ask).otherwise(F.concat(ask, F.lit(" "), "text")))
    return c.select("conv_id", "turn", G.bare_search(q).alias("bare"))


def p8_p9_filters(spark, d):
    """Why candidates are left out as echoes or for their low value."""
    rows = A.gated_and_scored(_channels(spark, d), _now(), USUAL, INGESTED)
    why = F.coalesce(G.echo(F.col("content"), F.col("q")), G.low_value(F.col("content"), F.col("content_kind")), F.lit("kept"))
    return rows.select(why.alias("reason"), "channel").groupBy("reason", "channel").agg(F.count("*").alias("n"))


def p9_low_value(spark, d):
    """Why a turn, after one of some remarks, would be left out for its low value."""
    remarks = ("", "that was a long winded response ", "i wrote a long reply to her ", "the answer is way too long ", "what do you think of it? ", "as an ai language model ")
    c = table(spark, d, "conversations")
    remark = F.element_at(F.array(*[F.lit(r) for r in remarks]), (F.col("conv_id") % len(remarks) + 1).cast("int"))
    content = T.normalize(F.concat(remark, F.col("text")))
    kind = F.when(F.col("turn") % 2 == 0, "question").otherwise("other")
    return c.select("conv_id", "turn", F.coalesce(G.low_value(content, kind), F.lit("kept")).alias("reason"))


def p11_zero_hits(spark, d):
    """Relational queries, and whether what they get scores nothing."""
    q = A.described_queries(asked(spark, d)).where("relational").select("query_id")
    got = G.zero_hits(r12_assembly(spark, d).where("channel <> 'reflection'"), "query_id")
    return q.join(got, "query_id", "left").select("query_id", F.coalesce("empty", F.lit(True)).alias("empty"))


def r14_deliveries(spark, d):
    """Events of what is rendered for each query, by store: how many were asked for, are still stored (ids not divisible by 9), and the outcome."""
    got = A.rendered(r12_assembly(spark, d))
    stored = table(spark, d, "embeddings").where("vec_id % 9 <> 0").select("vec_id")
    return A.delivery_events(got, stored)


def p12_routing(spark, d):
    """Policies that queries get against those their beginnings intend."""
    intended = ("default", "factual_recall", "task_status", "status_state", "default", "factual_recall", "default", "web_search")
    q = asked(spark, d).withColumn("intended", F.element_at(F.array(*[F.lit(i) for i in intended]), (F.col("query_id") % len(intended) + 1).cast("int")))
    rows = q.select("intended", R.classify_query(F.col("text")).alias("policy"), R.relational(F.col("text")).alias("relational"))
    return rows.groupBy("intended", "policy").agg(F.count("*").alias("n"), F.count_if("relational").alias("relational"))


def p13_declined(spark, d):
    """Documents that hold all words of a topic declined in the conversation of the same number."""
    topics = table(spark, d, "conversations").where("turn = 0").select("conv_id", F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1).alias("topic"))
    topics = topics.groupBy("conv_id").agg(F.collect_list(G.decline_keywords(F.col("topic"))).alias("topics"))
    docs = table(spark, d, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 10).cast("long").alias("conv_id"))
    rows = docs.join(topics, "conv_id")
    return rows.select("doc_id", G.declined(F.col("text"), F.col("topics")).alias("declined"))


def p14_flags(spark, d):
    asks = ("", "i’m tired ", "good morning ", "my plan: ")
    c = table(spark, d, "conversations")
    ask = F.element_at(F.array(*[F.lit(a) for a in asks]), (F.col("conv_id") % len(asks) + 1).cast("int"))
    text = F.concat(ask, F.col("text"))
    policy = R.classify_query(text)
    return c.select("conv_id", "turn", G.personal_query(policy, text).alias("personal"), G.check_in(text).alias("check_in"))


def v16_rules(spark, d):
    says = ("Thanks!", "what's the weather in ", "I'm watching today's news of ", "I have the latest updates on ", "who won ", "bitcoin price of ", "")
    c = table(spark, d, "conversations")
    say = F.element_at(F.array(*[F.lit(s) for s in says]), (F.col("conv_id") % len(says) + 1).cast("int"))
    text = F.when((F.col("turn") % 2 == 0) & (F.col("conv_id") % len(says) == 0), say).otherwise(F.concat(say, F.col("text")))
    return c.select("conv_id", "turn", F.coalesce(G.intent_rule(text), F.lit("undecided")).alias("rule"))


def _hits(spark, d):
    """Pages as results of queries: page_id / 5 is the query, its rest the place."""
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    p = p.withColumn("item_id", F.floor(F.col("page_id") / 5).cast("long")).withColumn("place", F.col("page_id") % 5 + 1)
    return p.join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("query")), "item_id")


def v18_freshness(spark, d):
    age = F.when(F.col("page_id") % 4 == 0, None).otherwise((F.col("page_id") * 7 % 100 - 10).cast("double"))
    rows = G.freshness_ranked(_hits(spark, d), "item_id", "place", age, most=3)
    return rows.select("item_id", "page_id", F.round("worth", 9).alias("worth"), "rank")


def v19_low_relevance(spark, d):
    return G.low_relevance(_hits(spark, d), "item_id", F.col("query"), F.col("title"), 2)


def v20_quarantine(spark, d):
    extra = F.when(F.col("page_id") % 3 == 0, " gpt and claude").when(F.col("page_id") % 7 == 0, " context window").otherwise("")
    query = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("compare gpt "), "query")).otherwise(F.col("query"))
    rows = _hits(spark, d).withColumn("flag", G.quarantined(query, F.concat("title", extra)))
    return G.quarantine_status(rows, "item_id", "flag")


QUERIES = {f.__name__: f for f in (
    r12_assembly, r10_diversity, v9_v13_channels, v6_entities, p3_bare_search, p8_p9_filters, p9_low_value, p11_zero_hits, r14_deliveries, p12_routing, p13_declined,
    p14_flags, v16_rules, v18_freshness, v19_low_relevance, v20_quarantine,
)}


def _names(text: str) -> str:
    runs = rf"regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
    before = f"trim(array_to_string(({runs})[1:i - 1], ''), ' ' || chr(9) || chr(10) || chr(13))"
    keep = f"regexp_full_match(({runs})[i], '[A-Z][a-z]{{2,}}') AND NOT list_contains({_list(G.NOT_NAMES)}, ({runs})[i]) AND {before} <> '' AND NOT list_contains(['.', '!', '?'], right({before}, 1))"
    return f"list_transform(list_filter(range(1, len({runs}) + 1), lambda i: {keep}), lambda i: lower(({runs})[i]))"


def _jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({WORDS.format(a)})", f"list_distinct({WORDS.format(b)})"
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END)"


def _low_value(c: str, kind: str) -> str:
    style = f"(length({c}) <= {G.LONGEST_META} AND NOT {_matches(c, G.OWN_WRITING)} AND ({' OR '.join(_matches(c, p) for p in G.STYLE_FEEDBACK)}))"
    return f"(CASE WHEN length({c}) < 40 THEN 'short' WHEN {_any(c, G.NON_ANSWERS)} THEN 'non_answer' WHEN {style} THEN 'style_feedback' WHEN length({c}) <= {G.LONGEST_META} AND {_matches(c, G.META_PROMPT)} THEN 'meta_prompt' WHEN {kind} = 'question' AND length({c}) < 120 THEN 'short_question' END)"


def _echo(c: str, q: str) -> str:
    return f"(CASE WHEN {c} = '' THEN 'empty' WHEN {_any(c, G.ECHO_MARKERS)} THEN 'marker' WHEN {q} <> '' AND contains({c}, {q}) THEN 'verbatim' WHEN {_jaccard(c, q)} > 0.55 THEN 'alike' END)"


def _case(column: str, values: dict) -> str:
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " ELSE 1.0 END::DOUBLE)"


_TERMS = f"list_filter({WORDS.format('q')}, lambda w: NOT list_contains({_list(T.STOPWORDS)}, w))"
_POLICY_COLUMNS = ", ".join(
    _case("policy", {p[0]: p[i] for p in R.POLICIES}) + f" AS {name}" for i, name in ((1, "memory_weight"), (2, "reflection_weight"), (6, "memory_limit"), (7, "reflection_limit"))
)
_PREFERENCE = "(CASE policy " + " ".join(f"WHEN '{p[0]}' THEN '{p[4]}'" for p in R.POLICIES) + " END)"
_ASKED = f"(SELECT item_id AS query_id, {_pick(BEGINNINGS, 'item_id')} || text AS text, embedding, item_id % 7 AS q_project FROM benchmark JOIN (SELECT vec_id AS item_id, embedding FROM embeddings) USING (item_id))"
_ARM = f"""(CASE WHEN {_PREFERENCE} = 'experience' AND (content_kind = 'experience' OR {_any('lower(text)', R.EXPERIENCE)}) THEN 'prefer_experience'
 WHEN {_PREFERENCE} = 'active_work' AND ({_any('lower(text)', R.ACTIVE_WORK)} OR {_any('lower(title)', R.ACTIVE_WORK)}) THEN 'active_work'
 WHEN {_PREFERENCE} = 'exact' THEN CASE content_kind WHEN 'question' THEN 'exact_question' ELSE 'exact_other' END ELSE 'none' END)"""
_AGE = "(vec_id * 13 % 500)"
_REFLECTIVE = f"(CASE kind WHEN 'conversation' THEN 0.10 WHEN 'reflection' THEN 0.08 WHEN 'ingested' THEN -0.03 ELSE 0 END::DOUBLE + CASE WHEN starts_with(content, 'user:') THEN 0.10 WHEN starts_with(content, 'assistant:') THEN -0.10 ELSE 0 END::DOUBLE)"
_WORK = "(CASE kind WHEN 'ingested' THEN 0.08 WHEN 'conversation' THEN 0.03 ELSE 0 END::DOUBLE)"
_APART = f"NOT contains(text, '│') AND NOT contains(text, '├') AND NOT contains(text, '└') AND NOT starts_with(content, 'recent themes:') AND NOT (q <> '' AND contains(content, q)) AND NOT {_jaccard('content', 'q')} > 0.60"
_CTES = f"""
WITH rec AS (SELECT vec_id, e.embedding, text, lang, source AS doc, source || ' ' || lang AS title, {NORM} AS content, {KINDS.format('label')} AS kind,
  {_pick(('hot', 'warm', 'cold'), 'vec_id')} AS tier, {_pick(CONTENT_KINDS, 'vec_id')} AS content_kind, vec_id % 7 AS project_id,
  CASE WHEN {KINDS.format('label')} = 'conversation' AND vec_id % 5 = 4 THEN 'assistant' ELSE 'user' END AS role
  FROM embeddings e JOIN documents ON doc_id = vec_id WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
asked AS (SELECT *, {_norm('text')} AS q, {policy_sql('text')} AS policy, {relational_sql('text')} AS relational, {_names('text')} AS names, {_any('lower(text)', G.IDENTITY_MARKERS)} AS identity FROM {_ASKED}),
told AS (SELECT * EXCLUDE (text, embedding), {_TERMS} AS terms, {_POLICY_COLUMNS} FROM asked),
near AS (SELECT a.query_id, r.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS cosine, row_number() OVER (PARTITION BY a.query_id, kind ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], r.embedding::DOUBLE[]) DESC, r.vec_id) AS rank FROM asked a, rec r QUALIFY rank <= 32),
found AS (SELECT *, cosine + CASE WHEN q <> '' AND contains(content, q) THEN 0.1 ELSE 0.0 END::DOUBLE + least(len(list_filter(terms, lambda t: contains(content, t))) * 0.03::DOUBLE, 0.18::DOUBLE)
  + least(len(list_filter(names, lambda n: contains(content, n))) * 0.2::DOUBLE, 0.4::DOUBLE)
  + CASE WHEN {_any('q', A.REFLECTIVE)} THEN {_REFLECTIVE} WHEN {_any('q', A.WORK)} THEN {_WORK} ELSE 0.0 END AS found
  FROM near JOIN told USING (query_id) JOIN rec USING (vec_id)
  WHERE NOT (content = '' OR length(content) < 40 OR {_any('content', MARKERS)} OR content[1] IN ('{{', '[') OR contains(content, '```'))),
chan AS (
  SELECT * FROM (SELECT *, 'profile' AS channel, 1 AS o, row_number() OVER (PARTITION BY query_id ORDER BY found DESC, vec_id) AS place FROM found WHERE kind = 'profile' AND rank <= CASE WHEN identity THEN 32 ELSE 12 END AND cosine >= CASE WHEN identity THEN 0.0 ELSE 0.3 END) WHERE place <= CASE WHEN identity THEN 8 ELSE 3 END AND length(trim(text)) >= 40
  UNION ALL SELECT * FROM (SELECT *, 'memory' AS channel, 2 AS o, row_number() OVER (PARTITION BY query_id ORDER BY found DESC, vec_id) AS place FROM found WHERE cosine >= {FLOOR}) WHERE place <= 8 AND {_APART}
  UNION ALL SELECT * FROM (SELECT *, 'reflection' AS channel, 3 AS o, row_number() OVER (PARTITION BY query_id ORDER BY found DESC, vec_id) AS place FROM found WHERE kind = 'reflection' AND rank <= 12) WHERE place <= 3 AND {_APART}),
merged AS (SELECT * FROM chan m WHERE channel = 'reflection' OR NOT EXISTS (SELECT 1 FROM chan r WHERE r.channel = 'reflection' AND r.query_id = m.query_id AND (r.vec_id = m.vec_id OR r.content = m.content))
  QUALIFY channel = 'reflection' OR row_number() OVER (PARTITION BY query_id, content, channel = 'reflection' ORDER BY o, place) = 1),
gated AS (SELECT *, round(found * CASE WHEN channel = 'reflection' THEN reflection_weight ELSE memory_weight END * CASE WHEN kind = 'profile' THEN 1.0 ELSE {_case('tier', R.TIER_FACTORS)} END
  * CASE WHEN channel <> 'reflection' AND relational THEN CASE WHEN kind IN ('profile', 'journal') OR (kind = 'conversation' AND role = 'user') THEN 1.0 WHEN role = 'assistant' THEN 0.3 ELSE 0.5 END ELSE 1.0 END::DOUBLE
  * greatest({R.PRIOR_MIN!r}, least({R.PRIOR_MAX!r}, CASE WHEN length(trim(text)) < 50 THEN {R.SHORT_ARM!r} WHEN length(trim(text)) > 1200 THEN {R.LONG_ARM!r} ELSE 1.0 END::DOUBLE * {_case('content_kind', R.KIND_ARMS)}
   * CASE WHEN {_AGE} <= 7 THEN {R.RECENCY_ARMS['d7']!r} WHEN {_AGE} <= 30 THEN {R.RECENCY_ARMS['d30']!r} WHEN {_AGE} <= 90 THEN {R.RECENCY_ARMS['d90']!r} WHEN {_AGE} <= 365 THEN {R.RECENCY_ARMS['d365']!r} ELSE {R.RECENCY_ARMS['older']!r} END::DOUBLE
   * {_case(_ARM, R.POLICY_ARMS)} * CASE WHEN project_id = q_project THEN {R.UP['project']!r} ELSE 1.0 END::DOUBLE * CASE WHEN channel = 'reflection' THEN {R.DOWN['reflection']!r} ELSE 1.0 END::DOUBLE)), 9) AS score
  FROM (SELECT *, policy = 'default' AND coalesce(max(cosine) FILTER (channel <> 'reflection' AND kind NOT IN ('profile', 'ingested')) OVER (PARTITION BY query_id), 0) < {USUAL}
    AND coalesce(max(cosine) FILTER (channel <> 'reflection' AND kind = 'ingested') OVER (PARTITION BY query_id), 0) < {INGESTED} AS closed FROM merged)
  WHERE (NOT closed OR (channel <> 'reflection' AND kind = 'profile')) AND (kind = 'profile' OR (found >= 0.25 AND (policy <> 'task_status' OR kind IN ('state', 'task', 'project', 'conversation', 'ingested'))))
    AND (channel = 'reflection' OR role <> 'assistant')),
good AS (SELECT *, channel <> 'reflection' AS memory, channel = 'reflection' OR ({_echo('content', 'q')} IS NULL AND {_low_value('content', 'content_kind')} IS NULL) AS good FROM gated),
kept AS (SELECT * FROM (SELECT *, coalesce(bool_or(good) FILTER (memory) OVER (PARTITION BY query_id), false) AS any_good FROM good) WHERE good OR NOT any_good
  QUALIFY row_number() OVER (PARTITION BY query_id, memory, content ORDER BY score DESC, o, place) = 1),
chosen AS (SELECT *, CASE WHEN channel = 'reflection' THEN 2 WHEN kind = 'profile' THEN 0 ELSE 1 END AS part, row_number() OVER (PARTITION BY query_id, CASE WHEN channel = 'reflection' THEN 2 WHEN kind = 'profile' THEN 0 ELSE 1 END ORDER BY score DESC, o, place) AS n FROM kept),
delivered AS (SELECT query_id, vec_id, kind, channel, score, row_number() OVER (PARTITION BY query_id ORDER BY part, n)::INT AS slot FROM chosen WHERE part = 0 OR (part = 1 AND n <= memory_limit) OR (part = 2 AND n <= reflection_limit))
"""
_REMARKS = ("", "that was a long winded response ", "i wrote a long reply to her ", "the answer is way too long ", "what do you think of it? ", "as an ai language model ")
_ASKS = ("search the web please", "google it for me, thanks!", "look it up now", "can you find online the", "web search", "thank you")
_GREETS = ("", "i’m tired ", "good morning ", "my plan: ")
_SAYS = ("Thanks!", "what's the weather in ", "I'm watching today's news of ", "I have the latest updates on ", "who won ", "bitcoin price of ", "")
_INTENDED = ("default", "factual_recall", "task_status", "status_state", "default", "factual_recall", "default", "web_search")
_HITS = "(SELECT page_id, page_id // 5 AS item_id, page_id % 5 + 1 AS place, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, text AS query FROM pages JOIN benchmark ON item_id = page_id // 5)"
_FRESH = "(CASE WHEN page_id % 4 = 0 OR page_id * 7 % 100 - 10 <= 0 THEN 1.0 ELSE greatest(0.3, pow(0.5, (page_id * 7 % 100 - 10) / 24.0)) END / place)"


def _content_terms(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_list(G.SEARCH_STOPWORDS.split())}, w)))"


def _flagged() -> str:
    query = "CASE WHEN item_id % 4 = 0 THEN 'compare gpt ' || query ELSE query END"
    result = "title || CASE WHEN page_id % 3 = 0 THEN ' gpt and claude' WHEN page_id % 7 = 0 THEN ' context window' ELSE '' END"
    names = " + ".join(f"contains(r, {_quoted(n)})::INT" for n in G.SYSTEM_NAMES)
    asked = f"({_any('a', G.SYSTEM_INQUIRIES)} OR (contains(a, 'compare') AND {_any('a', G.SYSTEM_NAMES)}))"
    return f"(SELECT item_id, NOT {asked} AND ({names} >= 2 OR {_any('r', G.SYSTEM_DOCS)}) AS flag FROM (SELECT item_id, lower({query}) AS a, lower({result}) AS r FROM {_HITS}))"


ORACLES = {
    "r12_assembly": _CTES + "SELECT query_id, vec_id, kind, channel, score, slot FROM delivered",
    "v9_v13_channels": _CTES + "SELECT query_id, vec_id, channel, round(found, 8) AS found FROM merged",
    "v6_entities": f"SELECT query_id, array_to_string({_names('text')}, ',') AS names FROM {_ASKED}",
    "p3_bare_search": f"SELECT conv_id, turn, {_bare('q')} AS bare FROM (SELECT conv_id, turn, lower(CASE WHEN turn % 2 = 0 THEN {_pick(_ASKS, 'conv_id')} ELSE {_pick(_ASKS, 'conv_id')} || ' ' || text END) AS q FROM conversations)",
    "p8_p9_filters": _CTES + f"SELECT reason, channel, count(*) AS n FROM (SELECT coalesce({_echo('content', 'q')}, {_low_value('content', 'content_kind')}, 'kept') AS reason, channel FROM gated) GROUP BY 1, 2",
    "p9_low_value": f"SELECT conv_id, turn, coalesce({_low_value('c', 'k')}, 'kept') AS reason FROM (SELECT conv_id, turn, {_norm('said')} AS c, CASE WHEN turn % 2 = 0 THEN 'question' ELSE 'other' END AS k FROM (SELECT *, {_pick(_REMARKS, 'conv_id')} || text AS said FROM conversations))",
    "p11_zero_hits": _CTES + "SELECT query_id, coalesce(empty, true) AS empty FROM (SELECT query_id FROM told WHERE relational) LEFT JOIN (SELECT query_id, count(*) FILTER (kind <> 'profile' AND score <> 0) = 0 AS empty FROM delivered WHERE channel <> 'reflection' GROUP BY 1) USING (query_id)",
    "r14_deliveries": _CTES + "SELECT query_id, store, count(*) AS requested, count(*) FILTER (vec_id % 9 <> 0) AS matched, CASE WHEN count(*) FILTER (vec_id % 9 <> 0) = count(*) THEN 'matched' WHEN count(*) FILTER (vec_id % 9 <> 0) = 0 THEN 'all_missed' ELSE 'missed' END AS outcome FROM (SELECT *, CASE WHEN kind = 'ingested' THEN 'ingested' ELSE 'memory' END AS store, row_number() OVER (PARTITION BY query_id, CASE WHEN channel = 'reflection' THEN 2 WHEN kind = 'profile' THEN 0 ELSE 1 END ORDER BY slot) AS r, CASE WHEN channel = 'reflection' THEN 2 WHEN kind = 'profile' THEN 0 ELSE 1 END AS part FROM delivered) WHERE part = 0 OR (part = 1 AND r <= 4) OR (part = 2 AND r <= 1) GROUP BY 1, 2",
    "p12_routing": f"SELECT intended, policy, count(*) AS n, count(*) FILTER (relational) AS relational FROM (SELECT {_pick(_INTENDED, 'query_id')} AS intended, {policy_sql('text')} AS policy, {relational_sql('text')} AS relational FROM {_ASKED}) GROUP BY 1, 2",
    "p13_declined": rf"WITH t AS (SELECT conv_id, list_filter(string_split_regex(lower(regexp_extract(text, '^\s*(\S+\s+\S+)', 1)), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({_list(G.DECLINE_STOPWORDS)}, w)) AS ws FROM conversations WHERE turn = 0) SELECT doc_id, len(ws) > 0 AND len(list_filter(ws, lambda w: contains(lower(text), w))) = len(ws) AS declined FROM documents JOIN t ON conv_id = doc_id // 10",
    "p14_flags": f"SELECT conv_id, turn, list_contains({_list(G.PERSONAL_POLICIES)}, {policy_sql('said')}) OR {_matches('lower(said)', G.EDGE + 'my' + chr(92) + 's+[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')} AS personal, length(trim({_curly('said')})) < 100 AND {_any(_curly('said'), G.CHECK_IN_MARKERS)} AS check_in FROM (SELECT *, {_pick(_GREETS, 'conv_id')} || text AS said FROM conversations)",
    "v16_rules": f"SELECT conv_id, turn, coalesce({_rule('said')}, 'undecided') AS rule FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND conv_id % 7 = 0 THEN {_pick(_SAYS, 'conv_id')} ELSE {_pick(_SAYS, 'conv_id')} || text END AS said FROM conversations)",
    "v18_freshness": f"SELECT item_id, page_id, round({_FRESH}, 9) AS worth, row_number() OVER (PARTITION BY item_id ORDER BY {_FRESH} DESC, place)::INT AS rank FROM {_HITS} QUALIFY rank <= 3",
    "v19_low_relevance": f"SELECT item_id, bool_and(len(t) > 0 AND len(list_intersect(t, {_content_terms('title')})) < CASE WHEN len(t) >= 2 THEN 2 ELSE 1 END) AS low FROM (SELECT *, {_content_terms('query')} AS t FROM {_HITS}) GROUP BY 1",
    "v20_quarantine": f"SELECT item_id, count(*) - sum(flag::INT)::BIGINT AS safe, sum(flag::INT)::BIGINT AS quarantined, CASE WHEN bool_and(flag) THEN 'unavailable/filtered' ELSE 'ok' END AS status FROM {_flagged()} GROUP BY 1",
}
