"""Queries of evaluation, audits, signals, sensitivity and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import evaluation as E
from ..operators import signals as G
from ..sources import ingest as S
from ..streaming import streams as X
from . import sensitivity as M
from ..sources.folders import shared_folder, written
from .retrieval_queries import _NEAR, _SCORED, _neighbours, _scored
from .retrieval_queries import ORACLES as RETRIEVAL_ORACLES
from .tables import table
from .text_queries import _ROLE, _SAID, NORM, _any


def grades_of(spark, d, rows):
    """query_id, id and grade of the rows (query_id, id) whose record has the query's label: 2, or 3 where the id is even."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    pairs = rows.select("query_id", "id").where("query_id <> id").distinct()
    pairs = pairs.join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("_a")), "id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_b")), "query_id")
    return pairs.where("_a = _b").select("query_id", "id", (2 + (F.col("id") % 2 == 0).cast("int")).alias("grade"))


def grade_counts(spark, d, queries):
    """query_id, grade and n: how many records of each grade there are for each of ``queries`` (query_id), from two counts for each label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", (2 + (F.col("vec_id") % 2 == 0).cast("int")).alias("grade"))
    counts = e.groupBy("label", "grade").agg(F.count("*").alias("n"))
    own = queries.select("query_id").distinct().join(e.select(F.col("vec_id").alias("query_id"), "label", F.col("grade").alias("_own")), "query_id")
    return own.join(counts, "label").select("query_id", "grade", (F.col("n") - (F.col("grade") == F.col("_own")).cast("int")).alias("n"))


def _graded(spark, d):
    """Neighbours as a ranking with their grades, and the counts of all grades."""
    ranked = _neighbours(spark, d).where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("id"), (F.col("rank") - 1).alias("rank"), F.col("cosine").alias("score"))
    ranked = written(ranked, "ranked")
    return ranked, grades_of(spark, d, ranked), grade_counts(spark, d, ranked)


def _arms(spark, d):
    s = _scored(spark, d)
    w = Window.partitionBy("query_id")
    plain = s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("cosine"), "vec_id")))
    full = s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "vec_id")))
    return [x.where("rank <= 8").select("query_id", F.col("vec_id").alias("id"), "rank") for x in (plain, full)]


def e1_ndcg(spark, d):
    ranked, grades, counts = _graded(spark, d)
    return E.ndcg(ranked, grades, 6, counts).select("query_id", F.round("ndcg", 8).alias("ndcg"))


def e2_contamination(spark, d):
    return E.contamination(*_graded(spark, d)[:2], 4).select("query_id", F.round("contamination", 9).alias("contamination"))


def e3_tie_bands(spark, d):
    ranked = _graded(spark, d)[0].withColumn("score", F.round("score", 2))
    return E.tie_bands(ranked).select("query_id", "id", "band", "band_size")


def e4_selection_jaccard(spark, d):
    return E.selection_jaccard(*_arms(spark, d)).select("query_id", F.round("jaccard", 9).alias("jaccard"))


def e5_pairwise_jaccard(spark, d):
    return E.mean_pairwise_jaccard(_arms(spark, d)[0]).select(F.round("mean_jaccard", 9).alias("mean_jaccard"), "sharing")


def e6_displacement(spark, d):
    return E.rank_displacement(*_arms(spark, d)).select("query_id", F.round("displacement", 9).alias("displacement"), "common")


def e12_drift(spark, d):
    rows = E.drift(table(spark, d, "events"), "event_type", "event_id", "value", 10, 5.0)
    return rows.select("event_type", "passed", F.round("change", 6).alias("change"), F.round("slope", 8).alias("slope"))


def e13_gate(spark, d):
    e = table(spark, d, "events")
    now = e.where("ts >= '2024-01-16' AND event_type <> 'view'").groupBy(F.col("event_type").alias("metric")).agg((F.avg("value") / 100).alias("value"))
    base = e.where("ts < '2024-01-16' AND event_type <> 'error'").groupBy(F.col("event_type").alias("metric")).agg((F.avg("value") / 90).alias("value"))
    return E.baseline_gate(now, base).select("metric", F.round("value", 8).alias("value"), F.round("base", 8).alias("base"), "verdict")


def a1_inventory(spark, d):
    return A.inventory(table(spark, d, "documents"), "source", F.octet_length("text"), "doc_id")


def a2_missing(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return A.missing_fields(rows, "source", ["text", "lang", "quality", "toxic"])


def a4_duplicates(spark, d):
    rows = table(spark, d, "documents").select("lang", "doc_id", F.md5(T.normalize(F.col("text")).cast("binary")).alias("key"))
    return A.duplicate_groups(rows, ["lang", "key"], "doc_id")


def a5_junk(spark, d):
    norm = T.normalize(F.col("text"))
    tests = {"short": F.length(norm) < 40, "meta": T.contains_any(norm, S.META_MARKERS), "fenced": F.contains("text", F.lit("```"))}
    return A.junk_rates(table(spark, d, "documents"), "lang", tests)


def a6_verdict(spark, d):
    docs = table(spark, d, "documents").select("lang", T.normalize(F.col("text")).alias("t"))
    rates = docs.groupBy("lang").agg(F.avg((F.length("t") < 40).cast("double")).alias("junk"), (1 - F.countDistinct("t") / F.count("*")).alias("duplicates"))
    return rates.select("lang", F.round("junk", 9).alias("junk"), F.round("duplicates", 9).alias("duplicates"), A.verdict(F.col("junk"), F.col("duplicates")).alias("verdict"))


def a7_growth(spark, d):
    return A.daily_growth(table(spark, d, "events"), "ts", F.octet_length("props")).select(F.col("day").cast("string").alias("day"), "bytes", "records", "total", "projected")


def _counters(spark, d):
    # a generator's output is computed once a row, and each site asks for the text, some by marker
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array(T.normalize(F.col("text")))).alias("norm"))
    norm = F.col("norm")
    sites = {"short": F.length(norm) < 40, "json": T.starts_any(norm, ("{", "[")), "any": F.length(norm) >= 0, "question": T.contains_any(norm, S.QUESTION_MARKERS)}
    return A.guard_counters(docs, sites, "doc_id")


def a9_counters(spark, d):
    return _counters(spark, d)


def a10_site_states(spark, d):
    declared = spark.createDataFrame([(s,) for s in ("short", "json", "any", "question", "never")], "site string")
    return A.site_states(_counters(spark, d), declared)


def documents_by_lang_and_source(spark, d):
    return A.grouped_counts(table(spark, d, "documents"), ["lang", "source"])


def f1_reflection_score(spark, d):
    said = T.normalize(F.concat(F.col("role"), F.lit(": "), F.col("text")))
    role = S.detected_role(said)
    score = G.reflection_score(said, role, S.content_kind(said, role), T.contains_any(said, S.EXPERIENCE_MARKERS))
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(score, 9).alias("score"))


def f3_novel(spark, d):
    rows = table(spark, d, "documents").select("lang", F.col("doc_id").alias("id"), F.length("text").cast("double").alias("score"), T.token_set(F.col("text")).alias("words"))
    return G.novel_selection(rows, "lang")


def f7_patterns(spark, d):
    v = F.col("vec_id")
    rows = _neighbours(spark, d).where("query_id <> vec_id")
    rows = rows.select("query_id", (v % 25).alias("session"), "cosine", (v * 13 % 500).alias("age_days"), (v % 6 == 0).alias("party"))
    return G.cross_session_patterns(rows, 0.3, 2, 2, 100).select("query_id", "rows", "sessions", "party", F.round("closest", 8).alias("closest"))


def f17_near_repeats(spark, d):
    return G.near_repeats(table(spark, d, "conversations"), "conv_id", "turn", 0.2).select("conv_id", "turn", F.round("similarity", 9).alias("similarity"))


def f18_urls(spark, d):
    host, path = T.canonical_url(F.col("url"))
    urls = table(spark, d, "pages").select(F.col("page_id").alias("id"), host.alias("host"), path.alias("path"))
    return G.unlisted_urls(urls, urls.where("id % 5 = 0")).select("id", "host", "path")


def _sobol_outputs(spark, d, samples, seed=1):
    """Mean score of all neighbours under each row of a design of four factors.

    The candidates enter by the sums that the score needs: their count and mean cosine by tier.
    """
    c = _scored(spark, d).groupBy("tier").agg(F.avg("cosine").alias("cosine"), F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # of three rows
    c = c.select("tier", "cosine", share.alias("weight"))

    def score(x, rows):
        factor = F.when(F.col("tier") == "hot", x[0]).when(F.col("tier") == "warm", x[1]).otherwise(x[2])
        return F.col("cosine") * (0.5 + factor) * (0.9 + 0.2 * x[3])

    return M.rescored(c, M.saltelli_design(spark, samples, 4, seed), score)


def m11_bootstrap(spark, d):
    """Intervals of the indices over 200 resamples of 512 samples."""
    rows = M.bootstrap_indices(_sobol_outputs(spark, d, 512), 4, 200)
    return rows.select("parameter", *[F.round(c, 3).alias(c) for c in ("s1_low", "s1_high", "st_low", "st_high")])


def m8_stability(spark, d):
    """Agreement of three seeds on the two strongest of the kinds of events."""
    means = {r[0]: r[1] for r in table(spark, d, "events").groupBy("event_type").agg(F.avg("value")).orderBy("event_type").collect()}  # a row for each type
    names = sorted(means)

    def model(x):
        total = F.lit(0.0)
        for k, name in enumerate(names):
            total = total + x[k] * (means[name] or 0.0)
        return total

    runs = None
    for seed in (3, 4, 5):
        run = M.morris_screening(spark, 32, len(names), 0.1, model, seed).withColumn("seed", F.lit(seed))
        runs = run if runs is None else runs.unionByName(run)
    return M.rank_stability(runs.withColumn("mu_star", F.round("mu_star", 9)), 2)


def m12_convergence(spark, d):
    """How wide the total indices' intervals are at 32, 64 and 128 samples, and how many samples a tenth would take."""
    def measure(n):
        outputs = _sobol_outputs(spark, d, n)
        return M.sobol_indices(outputs, 4).join(M.bootstrap_indices(outputs, 4, 100), "parameter")

    steps = spark.createDataFrame([(n, float(w)) for n, w, _ in M.converged_samples(measure, 0.01, 32, 128, 4)], "samples int, width double")
    need = M.required_samples(steps, 0.1)
    return steps.select("samples", F.round("width", 4).alias("width")).crossJoin(need.select("needed"))  # one row


def m9_m10_sobol(spark, d):
    """Which of four factors moves the mean score of all neighbours most."""
    return M.sobol_indices(_sobol_outputs(spark, d, 2048), 4).select("parameter", F.round("s1", 3).alias("s1"), F.round("st", 3).alias("st"))


def m7_morris(spark, d):
    """Of the mean value of events by type, under weights."""
    means = {r[0]: r[1] for r in table(spark, d, "events").groupBy("event_type").agg(F.avg("value")).orderBy("event_type").collect()}  # a row for each type
    names = sorted(means)

    def model(x):
        total = F.lit(0.0)
        for k, name in enumerate(names):
            total = total + x[k] * (means[name] or 0.0)
        return total + x[0] * x[1]

    out = M.morris_screening(spark, 64, len(names), 0.1, model)
    return out.select("parameter", *[F.round(c, 6).alias(c) for c in ("mu", "mu_star", "sigma")])


def _streamed(spark, d, build, mode, *keys):
    # a pattern, as the source takes a single file only so
    events = X.file_stream(spark, f"{d}/events.parque[t]", spark.read.parquet(f"{d}/events.parquet"), files=None)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return X.run_available(build(events), mode, shared_folder(spark), *keys)


def x1_delivery_frequency(spark, d):
    rows = _streamed(spark, d, X.delivery_frequency, "update", ["user_id"], "deliveries")
    return rows.select("user_id", F.round("frequency", 8).alias("frequency"), "deliveries")


def x3_windows(spark, d):
    rows = _streamed(spark, d, X.counted_by_window, "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (
    e1_ndcg, e2_contamination, e3_tie_bands, e4_selection_jaccard, e5_pairwise_jaccard, e6_displacement, e12_drift, e13_gate, a1_inventory, a2_missing,
    a4_duplicates, a5_junk, a6_verdict, a7_growth, a9_counters, a10_site_states, documents_by_lang_and_source, f1_reflection_score, f3_novel,
    f7_patterns, f17_near_repeats, f18_urls, m9_m10_sobol, m7_morris, m8_stability, m11_bootstrap, m12_convergence, x1_delivery_frequency, x3_windows,
)}

_RANKED = f"(SELECT query_id, vec_id AS id, rank - 1 AS rank, cosine AS score FROM {_NEAR.format(20)} WHERE query_id <> vec_id)"
_GRADES = "(SELECT q.vec_id AS query_id, e.vec_id AS id, 2 + (e.vec_id % 2 = 0)::INT AS grade FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)"
_GRADES_OF_ALL = "(SELECT q.query_id, e.vec_id AS id, 2 + (e.vec_id % 2 = 0)::INT AS grade FROM {0} q JOIN embeddings v ON v.vec_id = q.query_id JOIN embeddings e ON v.label = e.label AND q.query_id <> e.vec_id)"
_ARM = "(SELECT query_id, vec_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {1} DESC, vec_id) AS rank FROM {0}) WHERE rank <= 8)"
_PLAIN, _FULL = _ARM.format(_SCORED, "cosine"), _ARM.format(_SCORED, "score")
_RWORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"
_COUNTERS = f"(SELECT site, count(*) AS evaluations, sum(fired::INT)::BIGINT AS firings, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM (SELECT doc_id, unnest(['short', 'json', 'any', 'question']) AS site, unnest([length(s) < 40, s[1] IN ('{{', '['), length(s) >= 0, {_any('s', S.QUESTION_MARKERS)}]) AS fired FROM (SELECT doc_id, {NORM} AS s FROM documents)) GROUP BY site)"
_KINDS = f"CASE WHEN {_any('s', S.QUESTION_MARKERS)} THEN 'question' WHEN role = 'assistant' AND {_any('s', S.ANSWER_MARKERS)} THEN 'answer' WHEN role = 'user' AND {_any('s', S.EXPERIENCE_MARKERS)} THEN 'experience' WHEN role = 'user' THEN 'user_content' WHEN role = 'assistant' THEN 'assistant_content' ELSE 'other' END"
_HOSTS = r"(SELECT page_id AS id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/+$', '') AS path FROM pages)"

ORACLES = {
    "e1_ndcg": f"WITH g AS (SELECT r.query_id, sum((pow(2, coalesce(g.grade, 0)) - 1) / log2(r.rank + 1)) AS dcg FROM {_RANKED} r LEFT JOIN {_GRADES} g USING (query_id, id) WHERE r.rank <= 6 GROUP BY 1), i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(n + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS n FROM {_GRADES}) WHERE n <= 6 GROUP BY 1) SELECT query_id, round(dcg / ideal, 8) AS ndcg FROM g LEFT JOIN i USING (query_id)",
    "e2_contamination": f"SELECT query_id, round(avg((coalesce(g.grade, 0) = 0)::INT), 9) AS contamination FROM {_RANKED} r LEFT JOIN {_GRADES} g USING (query_id, id) WHERE r.rank <= 4 GROUP BY 1",
    "e3_tie_bands": f"SELECT query_id, id, band::BIGINT AS band, count(*) OVER (PARTITION BY query_id, band) AS band_size FROM (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS band FROM (SELECT *, coalesce((lag(s) OVER (PARTITION BY query_id ORDER BY rank) - s >= 1e-6)::INT, 1) AS new FROM (SELECT *, round(score, 2) AS s FROM {_RANKED})))",
    "e4_selection_jaccard": f"SELECT query_id, round(count(*) FILTER (a.rank IS NOT NULL AND b.rank IS NOT NULL) / count(*), 9) AS jaccard FROM {_PLAIN} a FULL JOIN {_FULL} b USING (query_id, id) GROUP BY query_id",
    "e5_pairwise_jaccard": f"WITH a AS {_PLAIN}, n AS (SELECT query_id, count(*) AS n FROM a GROUP BY 1), m AS (SELECT x.query_id AS p, y.query_id AS q, count(*) AS i FROM a x JOIN a y USING (id) WHERE x.query_id < y.query_id GROUP BY 1, 2) SELECT round((SELECT coalesce(sum(i / (u.n + v.n - i)), 0) FROM m JOIN n u ON u.query_id = p JOIN n v ON v.query_id = q) / (SELECT count(*) * (count(*) - 1) / 2 FROM n), 9) AS mean_jaccard, (SELECT count(*) FROM m) AS sharing",
    "e6_displacement": f"SELECT query_id, round(avg(abs(a.rank - b.rank)), 9) AS displacement, count(*) AS common FROM {_PLAIN} a JOIN {_FULL} b USING (query_id, id) GROUP BY query_id",
    "e12_drift": "SELECT event_type, avg(value) FILTER (d <= 10) - avg(value) FILTER (u <= 10) >= -5 AS passed, round(avg(value) FILTER (d <= 10) - avg(value) FILTER (u <= 10), 6) AS change, round(regr_slope(value, u), 8) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS u, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS d FROM events) GROUP BY event_type",
    "e13_gate": "SELECT metric, round(n.value, 8) AS value, round(b.value, 8) AS base, CASE WHEN b.value IS NULL THEN 'new' WHEN n.value IS NULL THEN 'not_measured' WHEN b.value - n.value > 0.05 THEN 'fail' ELSE 'pass' END AS verdict FROM (SELECT event_type AS metric, avg(value) / 100 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> 'view' GROUP BY 1) n FULL JOIN (SELECT event_type AS metric, avg(value) / 90 AS value FROM events WHERE event_type <> 'error' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1) b USING (metric)",
    "a1_inventory": "SELECT coalesce(source, 'total') AS source, count(*) AS records, sum(strlen(text))::BIGINT AS bytes, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY ROLLUP (source)",
    "a2_missing": "SELECT source, field, count(*) AS n FROM (SELECT source, unnest(['text', 'lang', 'quality', 'toxic']) AS field, unnest([text IS NULL OR text = '', lang IS NULL OR lang = '', quality IS NULL, toxic IS NULL]) AS gone FROM documents LEFT JOIN labels USING (doc_id)) WHERE gone GROUP BY 1, 2",
    "a4_duplicates": f"SELECT lang, md5({NORM}) AS key, min(doc_id) AS first_id, count(*) - 1 AS surplus FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "a5_junk": f"SELECT lang, count(*) AS n, sum((length(s) < 40)::INT)::BIGINT AS short, sum({_any('s', S.META_MARKERS)}::INT)::BIGINT AS meta, sum(contains(text, '```')::INT)::BIGINT AS fenced, round(avg((length(s) < 40 OR {_any('s', S.META_MARKERS)} OR contains(text, '```'))::INT), 9) AS junk_rate FROM (SELECT lang, text, {NORM} AS s FROM documents) GROUP BY lang",
    "a6_verdict": f"SELECT lang, round(junk, 9) AS junk, round(dup, 9) AS duplicates, CASE WHEN junk > 0.2 OR dup > 0.2 THEN 'RED' WHEN junk > 0.05 OR dup > 0.05 THEN 'YELLOW' ELSE 'GREEN' END AS verdict FROM (SELECT lang, avg((length(s) < 40)::INT) AS junk, 1 - count(DISTINCT s) / count(*) AS dup FROM (SELECT lang, {NORM} AS s FROM documents) GROUP BY lang)",
    "a7_growth": "SELECT day::VARCHAR AS day, bytes::BIGINT AS bytes, records, total::BIGINT AS total, round(total + total / (datediff('day', first_day, day) + 1) * 30, 6) AS projected FROM (SELECT *, sum(bytes) OVER w AS total, min(day) OVER w AS first_day FROM (SELECT ts::DATE AS day, sum(strlen(props)) AS bytes, count(*) AS records FROM events GROUP BY 1) WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING))",
    "a9_counters": f"SELECT * FROM {_COUNTERS}",
    "a10_site_states": f"SELECT site, coalesce(evaluations, 0) AS evaluations, coalesce(firings, 0) AS firings, CASE WHEN coalesce(evaluations, 0) = 0 THEN 'unreached' WHEN firings = 0 THEN 'dead' WHEN firings = evaluations THEN 'always' ELSE 'live' END AS state FROM (SELECT unnest(['short', 'json', 'any', 'question', 'never']) AS site) LEFT JOIN {_COUNTERS} USING (site)",
    "documents_by_lang_and_source": "SELECT CASE WHEN lang IS NOT NULL THEN 'lang' ELSE 'source' END AS \"column\", coalesce(lang, source) AS value, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))",
    "f1_reflection_score": f"SELECT conv_id, turn, round(1.0 + CASE role WHEN 'user' THEN 0.5 WHEN 'assistant' THEN -0.4 WHEN 'tool' THEN -1.0 WHEN 'system' THEN -1.0 ELSE 0 END::DOUBLE + CASE kind WHEN 'experience' THEN 0.6 WHEN 'user_content' THEN 0.2 WHEN 'question' THEN -0.3 WHEN 'answer' THEN -0.1 ELSE 0 END::DOUBLE + CASE WHEN length(s) > 100 AND {_any('s', S.EXPERIENCE_MARKERS)} THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN {_any('s', S.QUESTION_MARKERS)} THEN -0.2 ELSE 0 END::DOUBLE + CASE WHEN length(s) < 40 THEN -0.5 WHEN length(s) > 1500 THEN -0.2 ELSE 0 END::DOUBLE + CASE WHEN length(s) > 200 THEN 0.15 ELSE 0 END::DOUBLE, 9) AS score FROM (SELECT *, {_KINDS} AS kind FROM (SELECT *, {_ROLE} AS role FROM (SELECT conv_id, turn, {_SAID} AS s FROM conversations)))",
    "f7_patterns": f"SELECT query_id, count(*) AS rows, count(DISTINCT vec_id % 25) AS sessions, bool_or(vec_id % 6 = 0) AS party, round(max(cosine), 8) AS closest FROM {_NEAR.format(20)} WHERE query_id <> vec_id AND cosine >= 0.3 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT vec_id % 25) >= 2 AND bool_or(vec_id * 13 % 500 <= 100)",
    "f17_near_repeats": f"SELECT conv_id, turn, round(j, 9) AS similarity FROM (SELECT conv_id, turn, CASE WHEN len(w) = 0 OR len(v) = 0 THEN 0 ELSE len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))) END AS j FROM (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM (SELECT conv_id, turn, {_RWORDS} AS w FROM conversations WHERE role = 'assistant')) WHERE v IS NOT NULL) WHERE j > 0.2",
    "f18_urls": f"SELECT id, host, path FROM {_HOSTS} u WHERE NOT regexp_matches(host, '^(localhost|127[.]|10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])') AND NOT EXISTS (SELECT 1 FROM {_HOSTS} a WHERE a.id % 5 = 0 AND a.host = u.host AND (starts_with(u.path, a.path) OR starts_with(a.path, u.path)))",
    "x3_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
}
ORACLES["x1_delivery_frequency"] = RETRIEVAL_ORACLES["t1_frequency"]
