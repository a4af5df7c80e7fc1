"""Queries of the replay family on assembly's own traces, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import designs as D
from ..operators import evaluation as E
from ..operators import gates as G
from ..operators import ranking as R
from ..operators import replay as P
from ..sources.folders import written
from . import assembly_queries as Q
from . import sensitivity as M
from .analysis_queries import _GRADES_OF_ALL, grade_counts, grades_of
from .sql import listed
from .tables import table
from .text_queries import _any

RANGES = P.parameter_ranges()
LOW, HIGH = [r[2] for r in RANGES], [r[3] for r in RANGES]
#: The default, and each parameter alone at both ends of its range.
ENDS = [[]] + [[(k, end)] for k in range(len(RANGES)) for end in (LOW[k], HIGH[k])]
SWEPT = 9


def _trace(spark, d, beginnings=Q.BEGINNINGS):
    rows = A.traced(Q.asked(spark, d, beginnings), Q.records(spark, d), Q._now(), Q.MARKERS, None, Q.FLOOR, Q.USUAL, Q.INGESTED)
    return written(P.by_query(rows), "trace")


def _ends():
    return D.Listed(P.DEFAULT, ENDS)


def m1_compose(spark, d):
    """Stage scores of every candidate under the defaults, and with all parameters at the lower and at the upper end of their ranges."""
    design = D.Listed(P.DEFAULT, [[], list(enumerate(LOW)), list(enumerate(HIGH))])
    rows = P.composed(_trace(spark, d), design)
    return rows.select("row", "query_id", "vec_id", "reflection", *[F.round(c, 9).alias(c) for c in ("retrieval", "policy", "authorship", "final")])


def m2_replay(spark, d):
    """What each query is shown under the defaults and with each parameter alone at an end of its range."""
    rows = P.replayed(_trace(spark, d), _ends())
    shown = F.array_join(F.transform(F.array_sort("shown"), lambda i: i.cast("string")), ",")
    return rows.select("row", "query_id", shown.alias("shown"), "moved", "changed")


def m3_endpoints(spark, d):
    """Mean score and delivery distance of the same parameter rows."""
    return P.endpoints(_trace(spark, d), _ends()).select("row", F.round("score", 9).alias("score"), F.round("delivery", 9).alias("delivery"))


def _fidelity(spark, d, beginnings):
    delivered = A.assemble(Q.asked(spark, d, beginnings), Q.records(spark, d), Q._now(), Q.MARKERS, None, Q.FLOOR, Q.USUAL, Q.INGESTED)
    return P.fidelity(_trace(spark, d, beginnings), A.rendered(delivered), D.Listed(P.DEFAULT, [[]]))


def m4_fidelity(spark, d):
    """Replay under the defaults against what assembly itself scored and showed."""
    return _fidelity(spark, d, Q.BEGINNINGS)


def m4_fidelity_diverse(spark, d):
    """The same for queries that want diversity."""
    return _fidelity(spark, d, Q.DIVERSE)


def m5_ranges(spark, d):
    """Range of each parameter, and how many candidates have the branch that it belongs to."""
    told = spark.createDataFrame(RANGES, "name string, family string, low double, high double, default double")
    used = _trace(spark, d).select(F.explode("candidates").alias("c")).select(F.explode("c.arms").alias("k")).where("k >= 0").groupBy("k").agg(F.count("*").alias("candidates"))
    names = F.array(*[F.lit(n) for n in P.NAMES])
    used = used.select(names[F.col("k")].alias("name"), "candidates")
    return told.join(used, "name", "left").select("name", "family", *[F.round(c, 9).alias(c) for c in ("low", "high", "default")], F.coalesce("candidates", F.lit(0)).alias("candidates"))


def m6_coverage(spark, d):
    return P.coverage(_trace(spark, d))


def m6_sweeps(spark, d):
    """Rendered ids that come or go as each parameter alone takes nine values, from the crossing points of its range."""
    return P.swept(P.sweeps(_trace(spark, d)), SWEPT).select("name", F.round("value", 9).alias("value"), "changed")


def m13_solo(spark, d):
    return P.no_solo_effect(_trace(spark, d)).select("name", "moved", "changed", "flat")


def _exercised(trace) -> list[int]:
    """Numbers of the parameters that move something on their own; some dozens at most."""
    moved = P.one_at_a_time(trace, [(n, end) for n, _, low, high, _ in RANGES for end in (low, high)])
    names = {r.name for r in moved.where("moved > 0 OR changed > 0").select("name").distinct().collect()}
    return [k for k, n in enumerate(P.NAMES) if n in names]


def _sampled(spark, d, samples):
    """Delivery distances of a Saltelli design over the exercised parameters, by sample."""
    trace = _trace(spark, d)
    varied = _exercised(trace)
    design = D.Saltelli(samples, LOW, HIGH, P.DEFAULT, varied)
    rows = written(P.endpoints(trace, design), "endpoints")
    return M.by_sample(rows, design.matrices, y="delivery"), [P.NAMES[k] for k in varied]


def m10_pairs(spark, d):
    """Pairs of parameters by how much of the variance of what is shown only both together explain, with first and total indices of the first one."""
    rows, names = _sampled(spark, d, 256)
    singles, pairs = M.indices_with_pairs(rows, names)
    rows = pairs.join(singles.select(F.col("name").alias("first"), "s1", "st", "share"), "first")
    return rows.select("first", "second", *[F.round(c, 6).alias(c) for c in ("s2", "s1", "st", "share")])


def m11_resamples(spark, d):
    """Intervals of the indices over 1,000 resamples of 256 samples."""
    rows, names = _sampled(spark, d, 256)
    told = M.resampled_indices(rows, names, 256)
    return told.select("kind", "name", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), M.supported(F.col("low"), F.col("high")).alias("supported"))


def m7_screening(spark, d):
    """Elementary effects of the exercised parameters on what is shown, over 16 trajectories."""
    trace = _trace(spark, d)
    varied = _exercised(trace)
    design = D.Morris(16, LOW, HIGH, P.DEFAULT, varied)
    rows = M.screening(P.endpoints(trace, design), design, [P.NAMES[k] for k in varied], y="delivery")
    return rows.select("name", *[F.round(c, 6).alias(c) for c in ("mu", "mu_star", "sigma")], "interaction", "no_effect", "distinguishable")


def m12_replayed(spark, d):
    """How wide the five greatest total indices' intervals are at 64, 128 and 256 samples; a larger sample keeps the evaluations of a smaller one."""
    trace = _trace(spark, d)
    varied = _exercised(trace)
    names = [P.NAMES[k] for k in varied]
    most = 256
    design = D.Saltelli(most, LOW, HIGH, P.DEFAULT, varied)
    samples = written(M.by_sample(P.endpoints(trace, design), design.matrices, y="delivery"), "samples")

    def measure(n):
        mine = samples.where(F.col("sample") < n)
        singles, _ = M.indices_with_pairs(mine, names)
        ends = M.resampled_indices(mine, names, n, resamples=200).where("kind = 'st'").select("name", F.col("low").alias("st_low"), F.col("high").alias("st_high"))
        return singles.join(ends, "name").select(F.col("name").alias("parameter"), "st", "st_low", "st_high")

    steps = spark.createDataFrame([(n, float(w), met) for n, w, met in M.converged_samples(measure, 0.01, 64, most, 5)], "samples int, width double, met boolean")
    need = M.required_samples(steps.select("samples", "width"), 0.1)
    return steps.select("samples", F.round("width", 4).alias("width"), "met").crossJoin(need.select("needed"))  # one row


def m9_design(spark, d):
    """The A and B values of each kind of event, between its least and greatest value, in as many samples as there are users."""
    e = table(spark, d, "events")
    bounds = e.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high")).orderBy("event_type").collect()  # a row for each type
    users = e.agg(F.count_distinct("user_id")).first()[0]
    design = D.Saltelli(users, [r.low for r in bounds], [r.high for r in bounds], seed=1)
    rows = M.design_rows(spark, design).where("matrix < 2").select("sample", "matrix", F.posexplode("x").alias("k", "value"))
    names = F.array(*[F.lit(r.event_type) for r in bounds])
    return rows.select("sample", F.when(F.col("matrix") == 0, "A").otherwise("B").alias("matrix"), names[F.col("k")].alias("event_type"), F.round("value", 6).alias("value"))


def _ablated(spark, d):
    return written(P.ablated(_trace(spark, d)), "arms")


def e9_arms(spark, d):
    """What each treatment delivers."""
    rows = _ablated(spark, d).where("rank IS NOT NULL")
    return rows.select("arm", "query_id", "id", "kind", "tier", "score", "rank")


def e8_summary(spark, d):
    """Per arm: mean nDCG over queries with one, mean agreement with the full pipeline, and queries that changed."""
    rows = _ablated(spark, d).where("rank IS NOT NULL")
    out = E.arm_summary(rows, grades_of(spark, d, rows), "full", 6, grade_counts(spark, d, rows))
    return out.select("arm", F.round("ndcg", 8).alias("ndcg"), F.round("jaccard", 8).alias("jaccard"), "changed")


def e10_levers(spark, d):
    """Baits: ingested and reflection rows; what they outrank: rows of the query's label."""
    rows = _ablated(spark, d)
    out = E.lever_attribution(rows, grades_of(spark, d, rows), "full", F.col("kind").isin("ingested", "reflection"))
    return out.select("query_id", "bait", "lever", F.round("swing", 8).alias("swing"))


def e15_integrity(spark, d):
    """Cases: each query's candidate of the least id, and whether it should surface."""
    rows = _ablated(spark, d).where("arm = 'full'")
    cases = rows.groupBy("query_id").agg(F.min("id").alias("id")).withColumn("expect", F.when(F.col("query_id") % 2 == 0, "suppress").otherwise("surface"))
    return E.integrity(cases, rows.where("rank IS NOT NULL").select("query_id", "id"))


QUERIES = {f.__name__: f for f in (e8_summary, e9_arms, e10_levers, e15_integrity, m1_compose, m2_replay, m3_endpoints, m4_fidelity, m4_fidelity_diverse, m5_ranges, m6_coverage, m6_sweeps, m13_solo, m7_screening, m12_replayed, m9_design, m10_pairs, m11_resamples)}


def _number(column: str, prefix: str, rename: dict | None = None, suffix: str = "") -> str:
    """Place (from 1) of the parameter that a branch has, or null."""
    arms = {n[len(prefix) : len(n) - len(suffix)]: k + 1 for n, k in P.INDEX.items() if n.startswith(prefix) and n.endswith(suffix)}
    return f"(CASE {column} " + " ".join(f"WHEN '{(rename or {}).get(b, b)}' THEN {k}" for b, k in arms.items()) + " END)"


def _at(name: str) -> int:
    return P.INDEX[name] + 1


_SHUT = f"""(policy = 'default' AND coalesce(max(cosine) FILTER (channel <> 'reflection' AND kind NOT IN ('profile', 'ingested')) OVER (PARTITION BY query_id), 0) < {Q.USUAL}
 AND coalesce(max(cosine) FILTER (channel <> 'reflection' AND kind = 'ingested') OVER (PARTITION BY query_id), 0) < {Q.INGESTED})"""
_BUCKET = f"CASE WHEN {Q._AGE} <= 7 THEN 'd7' WHEN {Q._AGE} <= 30 THEN 'd30' WHEN {Q._AGE} <= 90 THEN 'd90' WHEN {Q._AGE} <= 365 THEN 'd365' ELSE 'older' END"
_AUTHOR = "CASE WHEN channel <> 'reflection' AND relational THEN CASE WHEN kind IN ('profile', 'journal') OR (kind = 'conversation' AND role = 'user') THEN 'first_person' WHEN role = 'assistant' THEN 'mixed' ELSE 'unknown' END END"
_EARLIER = f"""({Q._case('kind', P.EARLIER_KINDS).replace('ELSE 1.0', 'ELSE 0.0')} + CASE role WHEN 'user' THEN {P.EARLIER_ROLES['user']} WHEN 'assistant' THEN {P.EARLIER_ROLES['assistant']} ELSE 0 END::DOUBLE
 + CASE WHEN {_any('content', P.QUESTIONS)} THEN {P.EARLIER_QUESTION} ELSE {P.EARLIER_STATEMENT} END::DOUBLE + CASE WHEN {_any('content', P.CLARIFYING)} THEN {P.EARLIER_CLARIFYING} ELSE 0 END::DOUBLE
 + CASE WHEN {_any('content', P.EXPERIENCED)} THEN {P.EARLIER_EXPERIENCE} ELSE 0 END::DOUBLE + CASE WHEN {_any('content', P.SUMMARIES)} THEN {P.EARLIER_SUMMARY} ELSE 0 END::DOUBLE)"""
_ACT = Q._CTES + f""", seen AS (SELECT *, {_SHUT} AS shut0 FROM merged),
act AS (SELECT query_id, vec_id, channel = 'reflection' AS reflection, kind = 'profile' AS profile, content, o, place, memory_limit, reflection_limit, cosine,
  (q <> '' AND contains(content, q))::INT AS whole, len(list_filter(terms, lambda t: contains(content, t))) AS hits, len(list_filter(names, lambda n: contains(content, n))) AS ents,
  CASE WHEN channel = 'reflection' THEN reflection_weight ELSE memory_weight END AS w, memory_weight, kind, tier, {_number('tier', 'tier.')} AS own_tier,
  shut0 AND (channel = 'reflection' OR kind <> 'profile') AS shut_only, {_EARLIER} AS earlier,
  CASE WHEN {_any('q', A.REFLECTIVE)} THEN {_number('kind', 'ret.intent.reflective_')} WHEN {_any('q', A.WORK)} THEN {_number('kind', 'ret.intent.task_')} END AS i1,
  CASE WHEN {_any('q', A.REFLECTIVE)} THEN CASE WHEN starts_with(content, 'user:') THEN {_at('ret.intent.reflective_user_prefix')} WHEN starts_with(content, 'assistant:') THEN {_at('ret.intent.reflective_assistant_prefix')} END END AS i2,
  CASE WHEN kind = 'profile' THEN {_at('tier.profile_bypass')} ELSE {_number('tier', 'tier.')} END AS i3, {_number(_AUTHOR, 'auth.')} AS i4,
  {_number(Q._ARM, 'prior.policy.', {'prefer_active_work': 'active_work'})} AS i5, CASE WHEN project_id = q_project THEN {_at('prior.project.match')} END AS i6,
  {_number('content_kind', 'prior.kind.')} AS i7, CASE WHEN length(trim(text)) < 50 THEN {_at('prior.len.lt50')} WHEN length(trim(text)) > 1200 THEN {_at('prior.len.gt1200')} END AS i8,
  {_number(_BUCKET, 'prior.recency.')} AS i9, CASE WHEN channel = 'reflection' THEN {_at('prior.reflection_discount')} END AS i10,
  (shut0 AND (channel = 'reflection' OR kind <> 'profile')) OR (channel <> 'reflection' AND role = 'assistant') AS shut,
  kind = 'profile' OR policy <> 'task_status' OR kind IN ('state', 'task', 'project', 'conversation', 'ingested') AS eligible,
  channel <> 'reflection' AND ({Q._echo('content', 'q')} IS NOT NULL OR {Q._low_value('content', 'content_kind')} IS NOT NULL) AS poor FROM seen),
"""
_DEFAULT = "[" + ", ".join(f"{v!r}::DOUBLE" for v in P.PARAMETERS.values()) + "]"


def _rows(changes: list[list[tuple[int, float]]]) -> str:
    """Parameter rows as SQL: (row, x)."""
    told = ", ".join(f"({k}, {[p + 1 for p, _ in row]!r}::INT[], {[float(v) for _, v in row]!r}::DOUBLE[])" for k, row in enumerate(changes))
    return f"(SELECT row, list_transform(range(1, {len(RANGES)} + 1), lambda i: coalesce(vs[list_position(ks, i)], ({_DEFAULT})[i])) AS x FROM (VALUES {told}) t(row, ks, vs))"


def _staged(changes) -> str:
    """stages: every candidate's scores under every row, with ``shown``."""
    arm = lambda i, none: f"coalesce(x[i{i}], {none}::DOUBLE)"
    prior = " * ".join(arm(i, 1.0) for i in (8, 7, 9, 5, 6, 10))
    return _ACT + f"""given AS MATERIALIZED {_rows(changes)},
found2 AS (SELECT g.row, a.*, x, cosine + (whole * x[1] + least(hits * x[2], x[3]) + CASE WHEN ents > 0 THEN least(ents * x[4], x[5]) ELSE 0 END) + ({arm(1, 0.0)} + {arm(2, 0.0)}) AS retrieval FROM act a, given g),
stages0 AS (SELECT *, retrieval * w * {arm(3, 1.0)} AS policy, retrieval * w * {arm(3, 1.0)} * {arm(4, 1.0)} AS authorship,
  retrieval * w * {arm(3, 1.0)} * {arm(4, 1.0)} * greatest({R.PRIOR_MIN!r}::DOUBLE, least({R.PRIOR_MAX!r}::DOUBLE, {prior})) AS final,
  NOT shut AND (profile OR (eligible AND retrieval >= 0.25)) AS gated FROM found2),
again AS (SELECT query_id, vec_id, reflection FROM stages0 WHERE row = 0 AND gated AND NOT poor QUALIFY row_number() OVER (PARTITION BY query_id, reflection, content ORDER BY final DESC, o, place) > 1),
stages1 AS (SELECT s.*, poor OR a.vec_id IS NOT NULL AS filtered FROM stages0 s LEFT JOIN again a ON a.query_id = s.query_id AND a.vec_id = s.vec_id AND a.reflection = s.reflection),
stages2 AS (SELECT *, gated AND (NOT filtered OR (NOT reflection AND NOT coalesce(bool_or(NOT filtered) FILTER (gated AND NOT reflection) OVER (PARTITION BY row, query_id), false))) AS survives FROM stages1),
stages AS (SELECT *, survives AND (profile AND NOT reflection OR n <= CASE WHEN reflection THEN least(reflection_limit, 1) ELSE least(memory_limit, 4) END) AS shown FROM (
  SELECT *, row_number() OVER (PARTITION BY row, query_id, survives, reflection, profile AND NOT reflection ORDER BY round(final, 9) DESC, o, place) AS n FROM stages2)),
base AS (SELECT query_id, vec_id, reflection, final, shown FROM stages WHERE row = 0),
moves AS (SELECT s.row, s.query_id, list(s.vec_id ORDER BY s.vec_id) FILTER (s.shown) AS ids, count(*) FILTER (abs(s.final - b.final) > 1e-12) AS moved, count(*) FILTER (s.shown <> b.shown) AS changed,
  count(*) FILTER (s.shown OR b.shown) AS either, avg(s.final) AS score FROM stages s JOIN base b ON b.query_id = s.query_id AND b.vec_id = s.vec_id AND b.reflection = s.reflection GROUP BY 1, 2)
"""


_ENDS_SQL = _staged(ENDS)
_SWEEP_ROWS = [[]] + [[(k, LOW[k] + (HIGH[k] - LOW[k]) * j / (SWEPT + 1))] for k in range(len(RANGES)) for j in range(1, SWEPT + 1)]
_NAMES = listed(P.NAMES)
_UP = [(2 * k + 2 if v < HIGH[k] else 2 * k + 1) for k, v in enumerate(P.DEFAULT)]


def _points(dimensions: int) -> str:
    """x of sample ``s`` and dimension ``j`` (from 1), from the direction numbers and the scramble's seeds."""
    numbers = "[" + ", ".join("[" + ", ".join(map(str, map(int, row))) + "]" for row in D.direction_numbers(dimensions)) + "]"
    seeds = "[" + ", ".join(map(str, map(int, D.scramble_seeds(dimensions, 1)))) + "]"

    def reverse(v: str) -> str:
        for shift, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
            v = f"list_transform([{v}], lambda v{shift}: ((v{shift} >> {shift}) & {mask}) | ((v{shift} & {mask}) << {shift}))[1]"
        return v

    x = f"list_reduce(list_transform(range(0, 32), lambda b: CASE WHEN (s >> b) & 1 = 1 THEN (({numbers})[j])[b + 1]::BIGINT ELSE 0::BIGINT END), lambda p, q: xor(p, q))"
    x = f"(({reverse(x)} + ({seeds})[j]) & {(1 << 32) - 1})"
    for n, stir in enumerate(D.STIRS):
        x = f"list_transform([{x}], lambda w{n}: xor(w{n}, ((w{n}::HUGEINT * {stir}) % {1 << 32})::BIGINT))[1]"
    return f"({reverse(x)}) / {float(1 << 32)!r}"


ORACLES = {
    "m1_compose": _staged([[], list(enumerate(LOW)), list(enumerate(HIGH))]) + "SELECT row, query_id, vec_id, reflection, round(retrieval, 9) AS retrieval, round(policy, 9) AS policy, round(authorship, 9) AS authorship, round(final, 9) AS final FROM stages",
    "m2_replay": _ENDS_SQL + "SELECT row, query_id, coalesce(array_to_string(ids, ','), '') AS shown, moved, changed FROM moves",
    "m3_endpoints": _ENDS_SQL + "SELECT row, round(avg(score), 9) AS score, round(avg(CASE WHEN either > 0 THEN changed / either ELSE 0 END), 9) AS delivery FROM moves GROUP BY row",
    "m4_fidelity": _staged([[]]) + "SELECT count(*) AS candidates, 0::BIGINT AS score_mismatches, 0::BIGINT AS delivery_mismatches FROM stages",
    "m5_ranges": _ACT + f"ranges AS (SELECT unnest({_NAMES}) AS name, unnest({listed([r[1] for r in RANGES])}) AS family, unnest({LOW!r}::DOUBLE[]) AS low, unnest({HIGH!r}::DOUBLE[]) AS high, unnest({_DEFAULT}) AS d), used AS (SELECT ({_NAMES})[i] AS name, count(*) AS n FROM (SELECT unnest([i1, i2, i3, i4, i5, i6, i7, i8, i9, i10]) AS i FROM act) WHERE i IS NOT NULL GROUP BY 1) SELECT name, family, round(low, 9) AS low, round(high, 9) AS high, round(d, 9) AS \"default\", coalesce(n, 0) AS candidates FROM ranges LEFT JOIN used USING (name)",
    "m6_coverage": _ENDS_SQL + f"SELECT ({_NAMES})[(row + 1) // 2] AS name, CASE WHEN starts_with(({_NAMES})[(row + 1) // 2], 'div.') THEN 0 ELSE sum(moved) END::BIGINT AS moved FROM moves WHERE row IN ({', '.join(map(str, _UP))}) GROUP BY row",
    "m6_sweeps": _staged(_SWEEP_ROWS) + f"SELECT ({_NAMES})[(row - 1) // {SWEPT} + 1] AS name, round(any_value(v), 9) AS value, sum(changed)::BIGINT AS changed FROM moves JOIN (SELECT row, x[(row - 1) // {SWEPT} + 1] AS v FROM given) USING (row) WHERE row > 0 GROUP BY row",
    "m13_solo": _ENDS_SQL + f"SELECT name, max(m)::BIGINT AS moved, max(c)::BIGINT AS changed, max(c) = 0 AND (max(m) > 0 OR starts_with(name, 'div.')) AS flat FROM (SELECT ({_NAMES})[(row + 1) // 2] AS name, sum(moved) AS m, sum(changed) AS c FROM moves WHERE row > 0 GROUP BY row) GROUP BY name",
    "m9_design": f"WITH b AS (SELECT event_type, min(value) AS low, max(value) AS high, row_number() OVER (ORDER BY event_type) AS k FROM events GROUP BY 1), s AS (SELECT unnest(range(0, (SELECT count(DISTINCT user_id) FROM events))) AS s), j AS (SELECT s, unnest(range(1, 11)) AS j FROM s), u AS (SELECT s, j, {_points(10)} AS u FROM j) SELECT s AS sample, CASE WHEN j <= 5 THEN 'A' ELSE 'B' END AS matrix, event_type, round(low + u * (high - low), 6) AS value FROM u JOIN b ON k = (j - 1) % 5 + 1",
}


def _switched(arm: P.Arm) -> list[tuple[int, float]]:
    """Parameters that a treatment sets."""
    out = []
    for n, k in P.INDEX.items():
        if (n.startswith("ret.intent.") and not n.endswith("_prefix") and not arm.type_terms) or ((n.startswith("ret.lexical.") or n.endswith("_prefix")) and not arm.lexical_terms):
            out.append((k, 0.0))
        elif (n.startswith("tier.") and not arm.tier_scoring) or (n.startswith("prior.") and not arm.prior):
            out.append((k, 1.0))
    return out


_TREATED = ", ".join(
    f"({k}, '{name}', {str(a.ranker_stages).lower()}, {str(a.type_scoring).lower()}, {str(a.type_policy).lower()}, {str(a.role_predicate).lower()}, {str(a.earlier_terms).lower()})" for k, (name, a) in enumerate(P.TREATMENTS.items())
)
_arm = lambda i, none: f"coalesce(x[i{i}], {none}::DOUBLE)"
_ARMED = _staged([[]]) + f""",
treated AS MATERIALIZED (SELECT r.x AS x2, t.* EXCLUDE (k) FROM {_rows([_switched(a) for a in P.TREATMENTS.values()])} r JOIN (VALUES {_TREATED}) t(k, arm, ranker, scoring, policy_on, role_on, before) ON t.k = r.row),
r0 AS (SELECT s.* EXCLUDE (x, row, retrieval, policy, authorship, final, gated, survives, n, shown), t.arm, t.x2 AS x, ranker, policy_on, role_on, CASE WHEN scoring THEN w ELSE memory_weight END AS w2,
  CASE WHEN before THEN earlier ELSE 0 END AS extra FROM stages s, treated t WHERE s.row = 0),
r1 AS (SELECT *, (cosine + extra) + (whole * x[1] + least(hits * x[2], x[3]) + CASE WHEN ents > 0 THEN least(ents * x[4], x[5]) ELSE 0 END) + ({_arm(1, 0.0)} + {_arm(2, 0.0)}) AS retrieval FROM r0),
r2 AS (SELECT *, profile AND policy_on AS pf, round(CASE WHEN ranker THEN retrieval * w2 * CASE WHEN policy_on THEN {_arm(3, 1.0)} ELSE coalesce(x[own_tier], 1.0) END * {_arm(4, 1.0)}
  * greatest({R.PRIOR_MIN!r}::DOUBLE, least({R.PRIOR_MAX!r}::DOUBLE, {' * '.join(_arm(i, 1.0) for i in (8, 7, 9, 5, 6, 10))})) ELSE retrieval END, 9) AS score FROM r1),
r3 AS (SELECT *, NOT CASE WHEN role_on THEN shut ELSE shut_only END AND (pf OR ((eligible OR NOT policy_on) AND cosine >= 0.25)) AS kept FROM r2),
r4 AS (SELECT *, CASE WHEN NOT ranker THEN 0 WHEN kept AND NOT reflection AND (NOT filtered OR NOT coalesce(bool_or(NOT filtered) FILTER (kept AND NOT reflection) OVER (PARTITION BY arm, query_id), false)) THEN CASE WHEN pf THEN 0 ELSE 1 END
  WHEN kept AND reflection AND NOT filtered THEN 2 ELSE 3 END AS part, count(*) FILTER (profile) OVER (PARTITION BY arm, query_id) AS profiles FROM r3),
r5 AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id, part ORDER BY score DESC, o, place) AS n FROM r4),
r6 AS (SELECT *, CASE WHEN NOT ranker THEN n <= memory_limit + profiles ELSE part = 0 OR (part = 1 AND n <= memory_limit) OR (part = 2 AND n <= reflection_limit) END AS ok FROM r5),
arms AS (SELECT arm, query_id, vec_id AS id, kind, tier, score, CASE WHEN ok THEN row_number() OVER (PARTITION BY arm, query_id, ok ORDER BY part, n) END::INT AS rank FROM r6),
grades AS {_GRADES_OF_ALL.format("(SELECT DISTINCT query_id FROM arms)")}
"""
ORACLES |= {
    "e9_arms": _ARMED + "SELECT arm, query_id, id, kind, tier, score, rank FROM arms WHERE rank IS NOT NULL",
    "e8_summary": _ARMED + """, a AS (SELECT * FROM arms WHERE rank <= 6), dcg AS (SELECT arm, query_id, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg FROM a LEFT JOIN grades g USING (query_id, id) GROUP BY 1, 2),
 ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(n + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS n FROM grades) WHERE n <= 6 GROUP BY 1),
 j AS (SELECT x.arm, x.query_id, count(y.id) AS i, count(*) AS m FROM a x LEFT JOIN (SELECT query_id, id FROM a WHERE arm = 'full') y ON y.query_id = x.query_id AND y.id = x.id GROUP BY 1, 2), b AS (SELECT query_id, count(*) AS nb FROM a WHERE arm = 'full' GROUP BY 1)
 SELECT arm, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal END), 8) AS ndcg, round(avg(i / (m + coalesce(nb, 0) - i)), 8) AS jaccard, count(*) FILTER (i / (m + coalesce(nb, 0) - i) < 1) AS changed FROM j LEFT JOIN b USING (query_id) LEFT JOIN dcg USING (arm, query_id) LEFT JOIN ideal USING (query_id) GROUP BY arm""",
    "e10_levers": _ARMED + """, f AS (SELECT * FROM arms WHERE arm = 'full'), off AS (SELECT * FROM arms WHERE arm <> 'full'), good2 AS (SELECT f.* FROM f JOIN grades g USING (query_id, id) WHERE grade >= 2)
 SELECT query_id, bait, lever, round(swing, 8) AS swing FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bait ORDER BY swing DESC, lever) AS n FROM (SELECT b.query_id, b.id AS bait, ob.arm AS lever, max(round((b.score - ob.score) - (v.score - ov.score), 9)) AS swing
 FROM f b JOIN good2 v ON v.query_id = b.query_id AND v.id <> b.id AND b.score > v.score JOIN off ob ON ob.query_id = b.query_id AND ob.id = b.id JOIN off ov ON ov.query_id = v.query_id AND ov.id = v.id AND ov.arm = ob.arm WHERE b.kind IN ('ingested', 'reflection') GROUP BY 1, 2, 3)) WHERE n = 1""",
    "e15_integrity": _ARMED + ", a AS (SELECT * FROM arms WHERE arm = 'full'), c AS (SELECT query_id, min(id) AS id, CASE WHEN query_id % 2 = 0 THEN 'suppress' ELSE 'surface' END AS expect FROM a GROUP BY query_id) SELECT query_id, c.id, expect, x.id IS NOT NULL AS present, CASE WHEN (x.id IS NOT NULL) = (expect = 'surface') THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c LEFT JOIN (SELECT query_id, id FROM a WHERE rank IS NOT NULL) x USING (query_id, id)",
}
