"""Queries of the text functions and ingestion, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import ingest as S
from ..sources.folders import written
from .tables import table

NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
RUNS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
WORDS = r"list_filter(" + RUNS + r", lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}'))"
AS_OF = "2024-02-15 00:00:00"


def _any(column: str, markers) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, m.replace("'", "''")) for m in markers) + ")"


def n1_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text")).cast("binary")).alias("norm_md5"))


def n2_token_set(spark, d):
    s = T.token_set(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n_tokens"), F.md5(F.array_join(F.array_sort(s), " ").cast("binary")).alias("tokens_md5"))


def n3_query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


def n4_jaccard(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", T.token_set(F.col("text")).alias("w"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("v")), 9).alias("jaccard"))


def _stamped(spark, d):
    e = table(spark, d, "events")
    micros = F.unix_micros("ts")
    hyphen = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-"), F.date_format("ts", "SSSSSS"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    raw = F.when(F.col("event_id") % 4 == 0, F.concat((F.floor(micros / 1_000_000)).cast("string"), F.lit(".5"))).when(F.col("event_id") % 4 == 1, hyphen).when(F.col("event_id") % 4 == 2, iso).otherwise("not a time")
    return e.withColumn("raw", raw)


def n6_parse_timestamp(spark, d):
    return _stamped(spark, d).select("event_id", F.coalesce(F.unix_micros(T.parse_timestamp(F.col("raw"))), F.lit(-1)).alias("micros"))


def n7_age(spark, d):
    e = table(spark, d, "events")
    days = T.age_days(F.col("ts"), F.lit(AS_OF).cast("timestamp"))
    return e.select("event_id", days.alias("age_days"), T.recency_bucket(days).alias("bucket"))


def n8_n9_phrases(spark, d):
    e = table(spark, d, "events")
    s = F.floor((F.unix_micros(F.lit("2024-01-31 12:00:00").cast("timestamp")) - F.unix_micros("ts")) / 1_000_000)
    s = F.when(s >= 0, s).otherwise(-s)
    return e.select("event_id", T.elapsed_phrase(s).alias("elapsed"), T.relative_age(s).alias("relative"), T.record_age(s).alias("recorded"))


def n10_item_date(spark, d):
    ts, as_of = F.col("ts"), F.lit("2025-01-16 00:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", T.item_date(ts, as_of).alias("item_date"))


def n11_cosine(spark, d):
    """Of each vector and the one after it."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("next")), 9).alias("cosine"))


def n12_token_estimate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


def n13_version(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", T.coerce_version(F.get_json_object("props", "$.k")).alias("version"))


def n14_third_party(spark, d):
    return table(spark, d, "documents").select("doc_id", T.mentions_third_party(F.col("text")).alias("third_party"))


def n15_title(spark, d):
    return table(spark, d, "conversations").where("turn = 0").select("conv_id", T.conversation_title(F.regexp_replace("text", r"\s", " ")).alias("title"))


def n16_url(spark, d):
    host, path = T.canonical_url(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), path.alias("path"))


def n19_decay(spark, d):
    e = table(spark, d, "events")
    days = T.age_days(F.col("ts"), F.lit(AS_OF).cast("timestamp"))
    return e.select("event_id", F.round(T.halved(days, 52.0), 9).alias("decay"), F.round(F.greatest(F.lit(0.3), F.pow(F.lit(0.5), days * 24 / 24.0)), 9).alias("freshness"))


def s5_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.clean_text(F.col("text")).cast("binary")).alias("clean_md5"))


def s6_chunks(spark, d):
    rows = S.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def s8_skip_report(spark, d):
    c = table(spark, d, "conversations")
    said = T.normalize(F.concat(F.col("role"), F.lit(": "), F.col("text")))
    return c.select(F.coalesce(S.skip_reason(said), F.lit("kept")).alias("reason"), "role").groupBy("reason", "role").agg(F.count("*").alias("n"))


def s9_s10_kinds(spark, d):
    said = T.normalize(F.concat(F.col("role"), F.lit(": "), F.col("text")))
    role = S.detected_role(said)
    return table(spark, d, "conversations").select("conv_id", "turn", role.alias("detected"), S.content_kind(said, role).alias("kind"))


def s12_pipeline(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", S.clean_text(F.col("text")).alias("text"))
    return S.fixed_chunks(docs).groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


def s13_routing(spark, d):
    c = table(spark, d, "conversations").withColumn("source", F.when(F.col("conv_id") % 2 == 0, "chat_export").otherwise("notes"))
    target = F.coalesce(S.index_target(F.col("source"), F.col("role"), "chat_export"), F.lit("none"))
    return c.select(target.alias("target")).groupBy("target").agg(F.count("*").alias("n"))


def s14_index_filter(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "journal").when(F.col("doc_id") % 3 == 1, "conversation").otherwise("ingested")
    return table(spark, d, "documents").select("doc_id", S.skip_record(F.col("text"), kind).alias("skipped"))


def s16_content_key(spark, d):
    return table(spark, d, "documents").select("doc_id", S.content_key(F.col("text")).alias("content_key"))


def _split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", S.content_key(F.col("text")).alias("content_key"))
    return docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")


def s17_upsert(spark, d):
    batch, store = _split(spark, d)
    return S.upsert_outcomes(batch, store, "doc_id", "content_key", "doc_id").select("doc_id", "outcome")


def s18_unique_ids(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return S.unique_ids(e, "user_id", "event_type", "event_id").select("unique_id", "event_type", "event_id")


def s19_dry_run(spark, d):
    batch, store = _split(spark, d)
    return S.upsert_outcomes(batch, store, "doc_id", "content_key", "doc_id").groupBy("outcome").agg(F.count("*").alias("n"))


def s22_rebuild_plan(spark, d):
    docs = written(table(spark, d, "documents").select("doc_id", "source", S.content_key(F.col("text")).alias("content_key")), "keys")
    plan = S.rebuild_plan(docs.where("source <> 'src1'"), docs.where("source <> 'src2'"), "content_key", "doc_id")
    return plan.select("record_id", "index_id", "class")


QUERIES = {f.__name__: f for f in (
    n1_normalize, n2_token_set, n3_query_terms, n4_jaccard, n6_parse_timestamp, n7_age, n8_n9_phrases, n10_item_date, n11_cosine,
    n12_token_estimate, n13_version, n14_third_party, n15_title, n16_url, n19_decay, s5_clean, s6_chunks, s8_skip_report, s9_s10_kinds,
    s12_pipeline, s13_routing, s14_index_filter, s16_content_key, s17_upsert, s18_unique_ids, s19_dry_run, s22_rebuild_plan,
)}

_CLEAN = r"trim(regexp_replace(regexp_replace(replace(text, chr(0), ' '), '[^\x00-\x7F]+', ' ', 'g'), '[\s\x0B\x1C-\x1F]+', ' ', 'g'))"
_CLEANED = f"(SELECT doc_id, source, CASE WHEN length(c) > 40 AND length(regexp_replace(c, '[^0-9]', '', 'g')) / length(c) > 0.55 THEN '[structured numeric/table-like content]' ELSE c END AS text FROM (SELECT doc_id, source, {_CLEAN} AS c FROM documents))"
_SAID = r"trim(regexp_replace(lower(role || ': ' || text), '\s+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_AGE = f"greatest(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0), 0)::BIGINT"
_KEY = rf"sha256({NORM})"


def _skip_sql() -> str:
    arms = ["WHEN s = '' THEN 'empty' WHEN length(s) < 30 THEN 'short'"]
    for rule, markers in S.SKIP_MARKERS.items():
        test = _any("s", [m for m in markers if not m.startswith("\n")])
        if rule == "json_payload":
            test = f"(s[1] IN ('{{', '[') OR {test})"
        if rule == "assistant_filler":
            test = f"starts_with(s, 'assistant:') AND {test}"
        if rule == "mixed_speakers":
            test = f"starts_with(s, 'user:') AND {test}"
        arms.append(f"WHEN {test} THEN '{rule}'")
    return "CASE " + " ".join(arms) + " ELSE 'kept' END"


_ROLE = "CASE WHEN starts_with(s, 'user:') THEN 'user' WHEN starts_with(s, 'assistant:') THEN 'assistant' WHEN starts_with(s, 'tool:') THEN 'tool' WHEN starts_with(s, 'system:') THEN 'system' ELSE 'unknown' END"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CUT = _STRIP.format("substr(text, i * 1050 + 1, 1200)")
_CHUNKS = "(SELECT doc_id, source, i, " + _CUT + " AS chunk FROM (SELECT doc_id, source, text, unnest(range(CASE WHEN length(text) <= 1200 THEN 1 ELSE ceil((length(text) - 1200) / 1050.0)::INT + 1 END)) AS i FROM (SELECT doc_id, source, " + _STRIP.format("text") + " AS text FROM {0})) WHERE length(" + _CUT + ") > 0)"
_PLURAL = "({0} || ' {1}' || CASE WHEN {0} = 1 THEN '' ELSE 's' END)"
_UPSERT = f"""
(WITH k AS (SELECT doc_id, {_KEY} AS content_key FROM documents), store AS (SELECT * FROM k WHERE doc_id % 3 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY doc_id) AS n FROM k WHERE doc_id % 3 <> 0)
SELECT doc_id, CASE WHEN n > 1 OR content_key IN (SELECT content_key FROM store) THEN 'present' WHEN doc_id IN (SELECT doc_id FROM store) THEN 'replaced' ELSE 'inserted' END AS outcome FROM b)"""


def _ago(unit_seconds: int, unit: str, least: int = 0) -> str:
    n = f"greatest(s // {unit_seconds}, {least})"
    return _PLURAL.format(n, unit) + " || ' ago'"


ORACLES = {
    "n1_normalize": f"SELECT doc_id, md5({NORM}) AS norm_md5 FROM documents",
    "n2_token_set": f"SELECT doc_id, len(s)::INT AS n_tokens, md5(array_to_string(list_sort(s), ' ')) AS tokens_md5 FROM (SELECT doc_id, list_distinct({WORDS.format('text')}) AS s FROM documents)",
    "n3_query_terms": f"SELECT item_id, array_to_string(list_filter({WORDS.format('text')}, lambda w: NOT list_contains({_STOP}, w)), ' ') AS terms FROM benchmark",
    "n4_jaccard": f"WITH c AS (SELECT conv_id, turn, list_distinct({WORDS.format('text')}) AS w FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 9) AS jaccard FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
    "n6_parse_timestamp": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 + 500000 WHEN 1 THEN epoch_us(ts) WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000 ELSE -1 END AS micros FROM events",
    "n7_age": f"SELECT event_id, a AS age_days, CASE WHEN a <= 7 THEN 'd7' WHEN a <= 30 THEN 'd30' WHEN a <= 90 THEN 'd90' WHEN a <= 365 THEN 'd365' ELSE 'older' END AS bucket FROM (SELECT event_id, {_AGE} AS a FROM events)",
    "n8_n9_phrases": f"""
SELECT event_id,
  CASE WHEN s < 60 THEN 'less than a minute ago' WHEN s < 3600 THEN {_PLURAL.format('(s // 60)', 'minute')} || ' ago'
       WHEN s % 3600 // 60 = 0 THEN {_PLURAL.format('(s // 3600)', 'hour')} || ' ago'
       ELSE {_PLURAL.format('(s // 3600)', 'hour')} || ' ' || {_PLURAL.format('(s % 3600 // 60)', 'minute')} || ' ago' END AS elapsed,
  CASE WHEN s < 3600 THEN {_ago(60, 'minute', 1)} WHEN s < 86400 THEN {_ago(3600, 'hour')} WHEN s < 2592000 THEN {_ago(86400, 'day')}
       WHEN s < 31536000 THEN {_ago(2592000, 'month')} ELSE {_ago(31536000, 'year')} END AS relative,
  CASE WHEN s < 300 THEN 'moments ago' WHEN s < 3600 THEN (s // 60) || ' minutes ago' WHEN s < 86400 THEN {_ago(3600, 'hour')}
       WHEN s < 172800 THEN 'yesterday' WHEN s < 604800 THEN (s // 86400) || ' days ago' ELSE {_ago(604800, 'week')} END AS recorded
FROM (SELECT event_id, abs(floor((epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(ts)) / 1000000.0))::BIGINT AS s FROM events)""",
    "n10_item_date": "SELECT event_id, CASE WHEN floor((epoch_us(TIMESTAMP '2025-01-16 00:00:00') - epoch_us(ts)) / 86400000000.0) > 365 THEN strftime(ts, '%b %d, %Y') ELSE strftime(ts, '%b %d') END AS item_date FROM events",
    "n11_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "n12_token_estimate": r"SELECT conv_id, turn, (len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) * 13 // 10)::BIGINT AS tokens FROM conversations",
    "n13_version": "SELECT event_id, (props->>'$.k')::BIGINT AS version FROM events",
    "n15_title": r"SELECT conv_id, CASE WHEN h = '' THEN 'New conversation' WHEN length(t) > 50 AND contains(h, ' ') THEN regexp_replace(h, ' [^ ]*$', '') || '...' ELSE h END AS title FROM (SELECT conv_id, t, trim(substr(t, 1, 50)) AS h FROM (SELECT conv_id, regexp_replace(text, '\s', ' ', 'g') AS t FROM conversations WHERE turn = 0))",
    "n16_url": r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/+$', '') AS path FROM pages",
    "n19_decay": f"SELECT event_id, round(pow(2.0, -a / 52.0), 9) AS decay, round(greatest(0.3, pow(0.5, a)), 9) AS freshness FROM (SELECT event_id, {_AGE} AS a FROM events)",
    "s5_clean": f"SELECT doc_id, md5(text) AS clean_md5 FROM {_CLEANED}",
    "s6_chunks": f"SELECT doc_id, doc_id || '_chunk_' || i AS chunk_id, md5(chunk) AS chunk_md5 FROM {_CHUNKS.format('documents')}",
    "s8_skip_report": f"SELECT reason, role, count(*) AS n FROM (SELECT role, {_skip_sql()} AS reason FROM (SELECT role, {_SAID} AS s FROM conversations)) GROUP BY ALL",
    "s9_s10_kinds": f"SELECT conv_id, turn, detected, CASE WHEN {_any('s', S.QUESTION_MARKERS)} THEN 'question' WHEN detected = 'assistant' AND {_any('s', S.ANSWER_MARKERS)} THEN 'answer' WHEN detected = 'user' AND {_any('s', S.EXPERIENCE_MARKERS)} THEN 'experience' WHEN detected = 'user' THEN 'user_content' WHEN detected = 'assistant' THEN 'assistant_content' ELSE 'other' END AS kind FROM (SELECT conv_id, turn, s, {_ROLE} AS detected FROM (SELECT conv_id, turn, {_SAID} AS s FROM conversations))",
    "s12_pipeline": f"SELECT source, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM {_CHUNKS.format(_CLEANED)} GROUP BY source",
    "s13_routing": "SELECT CASE WHEN conv_id % 2 = 0 AND role = 'assistant' THEN 'none' WHEN conv_id % 2 = 0 AND role = 'user' THEN 'memory/conversation' ELSE 'ingested/ingested' END AS target, count(*) AS n FROM conversations GROUP BY 1",
    "s14_index_filter": f"SELECT doc_id, s = '' OR length(s) < CASE doc_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 0 ELSE 40 END OR {_any('s', S.META_MARKERS)} OR s[1] IN ('{{', '[') OR contains(text, '```') AS skipped FROM (SELECT doc_id, text, {NORM} AS s FROM documents)",
    "s16_content_key": f"SELECT doc_id, {_KEY} AS content_key FROM documents",
    "s17_upsert": f"SELECT * FROM {_UPSERT}",
    "s18_unique_ids": "SELECT user_id || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS unique_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) AS n FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2))",
    "s19_dry_run": f"SELECT outcome, count(*) AS n FROM {_UPSERT} GROUP BY outcome",
    "s22_rebuild_plan": f"WITH k AS (SELECT doc_id, source, {_KEY} AS c FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS n FROM k WHERE source <> 'src1'), x AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS n FROM k WHERE source <> 'src2') SELECT r.doc_id AS record_id, x.doc_id AS index_id, CASE WHEN x.doc_id IS NULL THEN 'added' WHEN r.doc_id IS NULL THEN 'orphan' ELSE 'matched' END AS class FROM r FULL JOIN x ON r.c = x.c AND r.n = x.n",
}
_THIRD = "(?:^|[^\\p{L}\\p{N}_])"
_AFTER = "(?:$|[^\\p{L}\\p{N}_])"
_COMMON = "said|told|asked|thinks?|thought|feels?|felt|wants?|wanted|believes?|believed|did|does|mentioned"
_KIN = "mom|dad|mother|father|parent|parents|partner|wife|husband|spouse|girlfriend|boyfriend|ex|sister|brother|sibling|siblings|son|daughter|kid|kids|child|children|friend|friends|bestie|best\\s+friend|boss|coworker|coworkers|colleague|colleagues|manager|teammate|therapist|doctor|teacher|professor|advisor|mentor|coach|roommate|neighbor"
ORACLES["n14_third_party"] = rf"SELECT doc_id, regexp_matches(lower(text), '{_THIRD}my\s+(?:{_KIN}){_AFTER}') OR regexp_matches(lower(text), '{_THIRD}(?:she|he|they)\s+(?:{_COMMON}|knows?|knew|replied|answered|claimed|insisted|admitted|agreed|disagreed){_AFTER}') OR regexp_matches(text, '{_THIRD}[A-Z][a-z]+\s+(?:{_COMMON}){_AFTER}') AS third_party FROM documents"
