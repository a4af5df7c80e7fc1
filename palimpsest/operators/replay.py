"""Replay of context assembly under other parameters.

``A.traced`` gives what assembly saw of each candidate: its cosine, the branches of every factor, the filters that no number moves.
From that, scores and what is rendered follow for any parameters without a search or a text.  A trace has some twenty candidates a
query.  Blocks of queries meet ranges of a design (``designs``), whose rows every task makes by itself; a task evaluates a
block of parameter rows against all candidates of a query as matrices, and keeps sums for each parameter row.
No row is made for a candidate under a parameter row, except by ``composed``, whose result that is.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from . import ranking as R
from .designs import Listed

# Parameters and what they are shipped with.
PARAMETERS = {
    "ret.lexical.substring": 0.10, "ret.lexical.term_hit": 0.03, "ret.lexical.term_cap": 0.18, "ret.lexical.entity_hit": 0.20, "ret.lexical.entity_cap": 0.40,
    "ret.intent.reflective_conversation": 0.10, "ret.intent.reflective_reflection": 0.08, "ret.intent.reflective_ingested": -0.03,
    "ret.intent.reflective_user_prefix": 0.10, "ret.intent.reflective_assistant_prefix": -0.10, "ret.intent.task_ingested": 0.08, "ret.intent.task_conversation": 0.03,
    "tier.cold": R.TIER_FACTORS["cold"], "tier.warm": R.TIER_FACTORS["warm"], "tier.hot": 1.0, "tier.profile_bypass": 1.0,
    "auth.first_person": 1.0, "auth.mixed": 0.3, "auth.unknown": 0.5,
    "prior.policy.prefer_experience": R.POLICY_ARMS["prefer_experience"], "prior.policy.prefer_active_work": R.POLICY_ARMS["active_work"],
    "prior.policy.exact_question": R.POLICY_ARMS["exact_question"], "prior.policy.exact_other": R.POLICY_ARMS["exact_other"], "prior.project.match": R.UP["project"],
    "prior.kind.experience": R.KIND_ARMS["experience"], "prior.kind.user_content": R.KIND_ARMS["user_content"], "prior.kind.question": R.KIND_ARMS["question"], "prior.kind.answer": 1.0,
    "prior.len.lt50": R.SHORT_ARM, "prior.len.gt1200": R.LONG_ARM, "prior.reflection_discount": R.DOWN["reflection"],
    "prior.recency.d7": R.RECENCY_ARMS["d7"], "prior.recency.d30": R.RECENCY_ARMS["d30"], "prior.recency.d90": R.RECENCY_ARMS["d90"],
    "prior.recency.d365": R.RECENCY_ARMS["d365"], "prior.recency.older": R.RECENCY_ARMS["older"],
    "div.similarity_share": 1.0, "div.same_type": 0.05, "div.same_doc": 0.22, "div.same_title": 0.08,
}
NAMES = tuple(PARAMETERS)
INDEX = {name: k for k, name in enumerate(NAMES)}
DEFAULT = np.array(list(PARAMETERS.values()))
#: Least half width of an additive parameter's range: a third of the measured spread of cosines.
LEAST_WIDTH = 0.0815 / 3
LEAST_FOUND = 0.25
TOLERANCE = 1e-12
#: The factors of a score by place: each candidate has the parameter of its branch, or none, for each.
ARMS = ("intent", "prefix", "tier", "author", "policy", "project", "kind", "length", "recency", "reflection")
_BRANCHES = {"active_work": "prefer_active_work"}


def parameter_ranges() -> list[tuple[str, str, float, float, float]]:
    """name, family, low, high and default of each parameter.

    Priors and tiers stay within their contract's bounds (tiers only discount), authorship is a fraction, all others go from their
    default as far as it is large, or by ``LEAST_WIDTH``.
    """
    out = []
    for name, value in PARAMETERS.items():
        if name.startswith("tier."):
            out.append((name, "bounded", R.PRIOR_MIN, 1.0, value))
        elif name.startswith("prior."):
            out.append((name, "bounded", R.PRIOR_MIN, R.PRIOR_MAX, value))
        elif name.startswith("auth."):
            out.append((name, "multiplier", 0.0, 1.0, value))
        else:
            half = max(abs(value), LEAST_WIDTH)
            out.append((name, "additive", value - half, value + half, value))
    return out


@dataclass(frozen=True)
class Arm:
    """A treatment: which parts of assembly are on.

    ``type_terms`` and ``lexical_terms`` of the search; without ``ranker_stages`` the search's score decides alone; ``type_scoring`` is the policy's own weight for
    reflections, ``type_policy`` the eligible types and the profile's privileges; ``earlier_terms`` adds terms that searches had before (``EARLIER_KINDS``).
    """

    type_terms: bool = True
    lexical_terms: bool = True
    ranker_stages: bool = True
    type_scoring: bool = True
    type_policy: bool = True
    tier_scoring: bool = True
    prior: bool = True
    role_predicate: bool = True
    earlier_terms: bool = False


# The treatments, and the terms of kinds, roles and contents that searches had before.
TREATMENTS = {
    "full": Arm(), "type_scoring_off": Arm(type_terms=False, type_scoring=False), "type_policy_off": Arm(type_terms=False, type_scoring=False, type_policy=False),
    "tier_off": Arm(tier_scoring=False), "prior_off": Arm(prior=False), "role_off": Arm(role_predicate=False), "before": Arm(earlier_terms=True), "lexical_off": Arm(lexical_terms=False),
    "type_and_tier_off": Arm(type_terms=False, type_scoring=False, tier_scoring=False), "naive_cosine": Arm(type_terms=False, lexical_terms=False, ranker_stages=False),
    "naive_lexical": Arm(type_terms=False, ranker_stages=False),
}
EARLIER_KINDS = {"conversation": 0.10, "reflection": 0.05, "memory": 0.03, "ingested": -0.02}
EARLIER_ROLES = {"user": 0.16, "assistant": -0.20}
EARLIER_QUESTION, EARLIER_STATEMENT, EARLIER_CLARIFYING, EARLIER_EXPERIENCE, EARLIER_SUMMARY = -0.10, 0.04, -0.12, 0.10, -0.14
QUESTIONS = ("?", "what ", "why ", "how ", "could you", "can you", "would you", "should i", "do i")
CLARIFYING = ("could you clarify", "can you clarify", "tell me more", "if you'd like", "consider sharing", "this would help", "can you share", "would you like")
EXPERIENCED = (
    "i am", "i'm", "i was", "i have", "i've", "i feel", "i felt", "today", "yesterday", "this week", "lately", "worked on", "started", "finished", "noticed", "experienced",
    "having",
)
SUMMARIES = (
    "based on your history", "here's a summary", "here is a summary", "the main themes are", "generate", "task:", "instructions", "broad tags", "specific tags",
)


def earlier_terms(kind: Column, role: Column, content: Column) -> Column:
    """What a search once added for a record's kind, role and (normalized) content."""
    of = lambda column, values, last: reduce(lambda out, kv: out.when(column == kv[0], kv[1]), values.items(), F.when(F.lit(False), 0.0)).otherwise(last)
    said = F.when(F.startswith(content, F.lit("user:")), EARLIER_ROLES["user"]).when(F.startswith(content, F.lit("assistant:")), EARLIER_ROLES["assistant"]).otherwise(0.0)
    has = lambda markers, value, other=0.0: F.when(contains_any(content, markers), value).otherwise(other)
    return (
        of(kind, EARLIER_KINDS, 0.0) + of(F.coalesce(role, F.lit("")), EARLIER_ROLES, said) + has(QUESTIONS, EARLIER_QUESTION, EARLIER_STATEMENT)
        + has(CLARIFYING, EARLIER_CLARIFYING) + has(EXPERIENCED, EARLIER_EXPERIENCE) + has(SUMMARIES, EARLIER_SUMMARY)
    )


def arm_numbers(branches: dict[str, Column]) -> Column:
    """Parameter numbers of a candidate's branches, in the order of ``ARMS``, from full names; -1 where a branch has no parameter."""
    numbers = F.create_map(*[F.lit(x) for pair in INDEX.items() for x in pair])
    return F.array(*[F.coalesce(numbers[branches[a]], F.lit(-1)) for a in ARMS])


CANDIDATE = (
    "vec_id long, reflection boolean, profile boolean, cosine double, whole boolean, hits int, names int, weight double, arms array<int>, closed boolean, "
    "shut boolean, eligible boolean, filtered boolean, exact double, earlier double, kind string, tier string, doc string, title string, tokens array<string>"
)


def by_query(candidates: DataFrame) -> DataFrame:
    """One row per query of trace rows, its candidates in the order that decides ties."""
    fields = [f.split()[0] for f in CANDIDATE.replace("array<int>", "x").replace("array<string>", "x").split(", ")]
    row = F.struct("_order", "place", *fields)
    packed = candidates.groupBy("query_id").agg(F.first("diversity").alias("diversity"), F.first("memory_weight").alias("memory_weight"), F.first("memory_limit").alias("memory_limit"), F.first("reflection_limit").alias("reflection_limit"), F.array_sort(F.collect_list(row)).alias("candidates"))
    return packed


class Query:
    """Arrays of one query's candidates."""

    def __init__(self, row: dict):
        c = row["candidates"]
        self.query_id, self.diversity = row["query_id"], bool(row["diversity"])
        self.memory_limit, self.reflection_limit = row["memory_limit"], row["reflection_limit"]
        self.memory_weight = row["memory_weight"]
        for name in ("reflection", "profile", "closed", "shut", "eligible", "filtered"):
            setattr(self, name, np.array([x[name] for x in c], bool))
        for name in ("cosine", "whole", "hits", "names", "weight", "exact", "earlier"):
            setattr(self, name, np.array([x[name] for x in c], float))
        self.ids, self.kinds, self.tiers = ([x[key] for x in c] for key in ("vec_id", "kind", "tier"))
        self.arms = np.array([x["arms"] for x in c])
        if self.diversity:
            self.turn = np.array([R.TURNS.index(x["kind"] if x["kind"] in R.TURNS else "other") for x in c])
            sets = [set(x["tokens"] or ()) for x in c]
            self.alike = np.array([[len(a & b) / len(a | b) if a and b else 0.0 for b in sets] for a in sets])
            self.same = {
                key: np.array([[bool(a[key]) and a[key] == b[key] for b in c] for a in c], float) for key in ("kind", "doc", "title")
            }

    def compose(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Scores after each stage, (rows of ``x``, candidates), by the grouping of assembly's own sums and products."""
        p = lambda name: x[:, INDEX[name], None]
        arm = lambda name, none: np.column_stack([x, np.full(len(x), none)])[:, self.arms[:, ARMS.index(name)]]
        lexical = self.whole * p("ret.lexical.substring") + np.minimum(self.hits * p("ret.lexical.term_hit"), p("ret.lexical.term_cap"))
        entities = np.where(self.names > 0, np.minimum(self.names * p("ret.lexical.entity_hit"), p("ret.lexical.entity_cap")), 0.0)
        retrieval = self.cosine + (lexical + entities) + (arm("intent", 0.0) + arm("prefix", 0.0))
        policy = retrieval * self.weight * arm("tier", 1.0)
        authorship = policy * arm("author", 1.0)
        prior = arm("length", 1.0) * arm("kind", 1.0) * arm("recency", 1.0) * arm("policy", 1.0) * arm("project", 1.0) * arm("reflection", 1.0)
        return {"retrieval": retrieval, "policy": policy, "authorship": authorship, "final": authorship * np.clip(prior, R.PRIOR_MIN, R.PRIOR_MAX)}

    def rendered(self, x: np.ndarray, stages: dict[str, np.ndarray], memories: int = 4, reflections: int = 1) -> np.ndarray:
        """Which candidates are shown, (rows of ``x``, candidates): gate, filters (or none, where they leave no memory), selection and window."""
        score = np.round(stages["final"], 9)
        gated = ~self.closed & (self.profile | (self.eligible & (stages["retrieval"] >= LEAST_FOUND)))
        memory = gated & ~self.reflection
        good = memory & ~self.filtered
        survive = np.where(good.any(axis=1)[:, None], good, memory)
        others = survive & ~self.profile
        most = min(self.memory_limit, memories)
        shown = self._in_turns(x, score, others, most) if self.diversity else _first(score, others, most)
        echoes = gated & self.reflection & ~self.filtered
        return (survive & self.profile) | shown | _first(score, echoes, min(self.reflection_limit, reflections))

    def _in_turns(self, x: np.ndarray, score: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
        """Picks in turns from the groups, for all rows at once: each row has its own picks, penalties and number of picks."""
        left, shown = left.copy(), np.zeros_like(left)
        picked, alike, cost = np.zeros(len(x), int), np.zeros_like(score), np.zeros_like(score)
        ceiling = np.abs(score) * R.SPREAD
        p = lambda name: x[:, INDEX[name], None]
        rows = np.arange(len(x))
        while True:
            moved = False
            for turn in range(len(R.TURNS)):
                open_ = left & (self.turn == turn)
                goes = open_.any(axis=1) & (picked < most)
                if not goes.any():
                    continue
                moved = True
                worth = score - np.minimum(ceiling * p("div.similarity_share") * alike + cost, ceiling)
                best = np.argmax(np.where(open_, worth, -np.inf), axis=1)
                if (picked[goes] == 0).any():
                    best = np.where(picked == 0, np.argmax(np.where(open_, score, -np.inf), axis=1), best)
                at, chosen = rows[goes], best[goes]
                left[at, chosen], shown[at, chosen] = False, True
                picked[at] += 1
                alike[at] = np.maximum(alike[at], self.alike[chosen])
                for key, name in (("kind", "div.same_type"), ("doc", "div.same_doc"), ("title", "div.same_title")):
                    cost[at] += x[at, INDEX[name], None] * self.same[key][chosen]
            if not moved:
                return shown


    def under(self, arm: Arm) -> tuple[np.ndarray, list[int]]:
        """Score of every candidate under an arm, and the delivered ones in order.

        The least score of the gate is asked of the bare cosine here, so that an arm that scores lower doesn't lose candidates for it; diversity is off.
        """
        x, same = DEFAULT[None].copy(), copy(self)
        off = lambda test, value: [x.__setitem__((0, k), value) for n, k in INDEX.items() if test(n)]
        if not arm.type_terms:
            off(lambda n: n.startswith("ret.intent.") and not n.endswith("_prefix"), 0.0)
        if not arm.lexical_terms:
            off(lambda n: n.startswith("ret.lexical.") or n.endswith("_prefix"), 0.0)
        if not arm.tier_scoring:
            off(lambda n: n.startswith("tier."), 1.0)
        if not arm.prior:
            off(lambda n: n.startswith("prior."), 1.0)
        if not arm.type_scoring:
            same.weight = np.full(len(self.ids), float(self.memory_weight))
        if arm.earlier_terms:
            same.cosine = self.cosine + self.earlier
        profile = self.profile & arm.type_policy
        if not arm.type_policy:  # a profile row is a row like others, with its own tier
            same.arms = self.arms.copy()
            same.arms[:, ARMS.index("tier")] = [INDEX.get(f"tier.{t}", -1) for t in self.tiers]
        stages = same.compose(x)
        if not arm.ranker_stages:
            score = np.round(stages["retrieval"][0], 9)
            return score, np.argsort(-score, kind="stable")[: self.memory_limit + int(self.profile.sum())].tolist()
        score = np.round(stages["final"][0], 9)
        kept = ~(self.closed if arm.role_predicate else self.shut) & (profile | ((self.eligible | (not arm.type_policy)) & (self.cosine >= LEAST_FOUND)))
        memory = kept & ~self.reflection
        good = memory & ~self.filtered
        memory = good if good.any() else memory
        order = np.argsort(-score, kind="stable")
        parts = ((memory & profile, len(score)), (memory & ~profile, self.memory_limit), (kept & self.reflection & ~self.filtered, self.reflection_limit))
        return score, [int(k) for of, most in parts for k in order[of[order]][:most]]


def _first(score: np.ndarray, of: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` best of each row; equal scores in the order of the candidates."""
    order = np.argsort(np.where(of, -score, np.inf), axis=1, kind="stable")[:, :most]
    out = np.zeros_like(of)
    np.put_along_axis(out, order, True, axis=1)
    return out & of


def _grid(trace: DataFrame, design, block: int, span: int) -> DataFrame:
    """Trace rows for each span of the design: the tasks of a span may be several, so that all cores have one."""
    spans = -(-design.rows // span)
    tasks = max(1, trace.sparkSession.sparkContext.defaultParallelism)
    slices = max(1, -(-tasks // spans))
    rows = trace.withColumn("_span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))).withColumn("_slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)))
    return rows.repartition(max(tasks, spans), "_span", "_slice").sortWithinPartitions("_span")


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Query]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["_span"], Query(row)


def endpoints(trace: DataFrame, design, block: int = 512, span: int = 8192) -> DataFrame:
    """row, score and delivery for each row of ``design``: the mean over queries of a query's mean score, and of the Jaccard distance
    between what it is shown and what it is shown under the default parameters.  A query without candidates isn't in a trace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, sums = None, 0, np.zeros((2, 0))

        def written() -> pa.RecordBatch:
            rows = np.arange(sums.shape[1]) + now * span
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), n)), pa.array(sums[0]), pa.array(sums[1])], names=["row", "n", "score", "delivery"])

        for at, query in _queries(batches):
            if at != now:
                if now is not None:
                    yield written()
                now, n, sums = at, 0, np.zeros((2, min(span, design.rows - at * span)))
            n += 1
            default = DEFAULT[None]
            base = query.rendered(default, query.compose(default))
            for begin in range(0, sums.shape[1], block):
                x = design.vectors(at * span + begin, min(block, sums.shape[1] - begin))
                stages = query.compose(x)
                shown = query.rendered(x, stages)
                sums[0, begin : begin + len(x)] += stages["final"].mean(axis=1)
                union = (shown | base).sum(axis=1)
                sums[1, begin : begin + len(x)] += np.where(union > 0, (shown ^ base).sum(axis=1) / np.maximum(union, 1), 0.0)
        if now is not None:
            yield written()

    parts = _grid(trace, design, block, span).mapInArrow(run, "row long, n long, score double, delivery double")
    return parts.groupBy("row").agg((F.sum("score") / F.sum("n")).alias("score"), (F.sum("delivery") / F.sum("n")).alias("delivery"))


def replayed(trace: DataFrame, design, block: int = 512, span: int = 8192) -> DataFrame:
    """row, query_id, shown (ids), moved (candidates whose score changed from the default's), changed (ids shown under one of the two alone)
    and diversity: a row for each query and row of ``design``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, query in _queries(batches):
            default = DEFAULT[None]
            stages = query.compose(default)
            base, before = query.rendered(default, stages), stages["final"]
            for begin in range(at * span, min(design.rows, (at + 1) * span), block):
                x = design.vectors(begin, min(block, design.rows - begin, (at + 1) * span - begin))
                stages = query.compose(x)
                shown = query.rendered(x, stages)
                ids = np.array(query.ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(begin, begin + len(x))), pa.array(np.full(len(x), query.query_id)), pa.array([ids[s].tolist() for s in shown], pa.list_(pa.int64())),
                        pa.array((np.abs(stages["final"] - before) > TOLERANCE).sum(axis=1)), pa.array((shown ^ base).sum(axis=1)), pa.array([query.diversity] * len(x)),
                    ],
                    names=["row", "query_id", "shown", "moved", "changed", "diversity"],
                )

    return _grid(trace, design, block, span).mapInArrow(run, "row long, query_id long, shown array<long>, moved long, changed long, diversity boolean")


def composed(trace: DataFrame, design, span: int = 64) -> DataFrame:
    """row, query_id, vec_id, reflection and the score after each stage: a row for each candidate and row of ``design``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, query in _queries(batches):
            x = design.vectors(at * span, min(span, design.rows - at * span))
            stages, c = query.compose(x), len(query.ids)
            columns = [np.repeat(np.arange(len(x)) + at * span, c), np.full(len(x) * c, query.query_id), np.tile(query.ids, len(x)), np.tile(query.reflection, len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in [*columns, *(s.ravel() for s in stages.values())]], names=["row", "query_id", "vec_id", "reflection", *stages])

    return _grid(trace, design, span, span).mapInArrow(run, "row long, query_id long, vec_id long, reflection boolean, retrieval double, policy double, authorship double, final double")


def fidelity(trace: DataFrame, shown: DataFrame, design) -> DataFrame:
    """candidates, score_mismatches (replayed against captured, by more than 1e-12) and delivery_mismatches (queries for which replay shows others
    than ``shown`` (query_id, vec_id)) of the default parameters, the one row of ``design``."""
    captured = trace.select("query_id", F.explode("candidates").alias("c")).select("query_id", "c.vec_id", "c.reflection", "c.exact")
    scores = composed(trace, design).join(captured, ["query_id", "vec_id", "reflection"], "full")
    off = F.abs(F.col("final") - F.col("exact")) > TOLERANCE
    scores = scores.agg(F.count("*").alias("candidates"), F.count_if(F.coalesce(off, F.lit(True))).alias("score_mismatches"))
    own = replayed(trace, design).select("query_id", F.explode("shown").alias("vec_id"), F.lit(1).alias("a"))
    both = own.join(shown.select("query_id", "vec_id", F.lit(1).alias("b")), ["query_id", "vec_id"], "full").where("a IS NULL OR b IS NULL")
    return scores.crossJoin(both.agg(F.count_distinct("query_id").alias("delivery_mismatches")))  # one row each


def one_at_a_time(trace: DataFrame, changes: list[tuple[str, float]]) -> DataFrame:
    """name, value, moved and changed: over all queries, candidates whose score moves and rendered ids that come or go, as one parameter takes a value."""
    design = Listed(DEFAULT, [[(INDEX[name], value)] for name, value in changes])
    sums = replayed(trace, design).groupBy("row").agg(F.sum("moved").alias("moved"), F.sum("changed").alias("changed"), F.sum(F.when(F.col("diversity"), F.col("changed")).otherwise(0)).alias("changed_diverse"))
    told = trace.sparkSession.createDataFrame([(k, n, float(v)) for k, (n, v) in enumerate(changes)], "row long, name string, value double")
    return told.join(sums, "row").drop("row")


def coverage(trace: DataFrame) -> DataFrame:
    """name and moved: what each parameter moves when it goes to the end of its range, the upper one unless it is there.

    That is candidates whose score moves; for the parameters of selection, which move no score, rendered ids of queries that want diversity.
    """
    ends = [(n, high if value < high else low) for n, _, low, high, value in parameter_ranges()]
    rows = one_at_a_time(trace, ends)
    return rows.select("name", F.when(F.startswith("name", F.lit("div.")), F.col("changed_diverse")).otherwise(F.col("moved")).alias("moved"))


def no_solo_effect(trace: DataFrame) -> DataFrame:
    """name, moved and changed at both ends of each parameter's range together, and ``flat``: whether it moves scores but alone never changes what is shown."""
    ends = [(n, end) for n, _, low, high, _ in parameter_ranges() for end in (low, high)]
    rows = one_at_a_time(trace, ends).groupBy("name").agg(F.max("moved").alias("moved"), F.max("changed").alias("changed"))
    return rows.withColumn("flat", (F.col("changed") == 0) & ((F.col("moved") > 0) | F.startswith("name", F.lit("div."))))


def _kinks(query: Query, k: int, low: float, high: float) -> np.ndarray:
    """Where some candidate's score bends as parameter ``k`` goes from low to high: at a cap, or a bound of the prior."""
    name, at = NAMES[k], [low, high]
    with np.errstate(divide="ignore", invalid="ignore"):
        for counts, hit, cap in ((query.hits, "ret.lexical.term_hit", "ret.lexical.term_cap"), (query.names, "ret.lexical.entity_hit", "ret.lexical.entity_cap")):
            if name == hit:
                at.extend(PARAMETERS[cap] / counts[counts > 0])
            elif name == cap:
                at.extend(counts * PARAMETERS[hit])
        if name.startswith("prior."):
            factors = np.append(DEFAULT, 1.0)[query.arms]
            mine = query.arms == k
            rest = np.where(mine, 1.0, factors)[:, [ARMS.index(a) for a in ARMS[4:]]].prod(axis=1)[mine.any(axis=1)]
            at.extend(np.concatenate([R.PRIOR_MIN / rest, R.PRIOR_MAX / rest]))
    return np.unique(np.clip(at, low, high))


def flips(query: Query, k: int, low: float, high: float) -> np.ndarray:
    """The values of parameter ``k`` between which a query's order, and what passes its gate, are the same.

    Between two bends every score is a line, so two candidates change places where their lines cross, and a candidate passes or fails the
    gate where its retrieval line crosses the least score.
    """
    cuts = _kinks(query, k, low, high)
    x = np.repeat(DEFAULT[None], len(cuts), axis=0)
    x[:, k] = cuts
    stages = query.compose(x)
    first, second = np.triu_indices(len(query.ids), 1)
    gaps = np.concatenate([stages["final"][:, first] - stages["final"][:, second], stages["retrieval"] - LEAST_FOUND], axis=1)
    begin, end = gaps[:-1], gaps[1:]
    crosses = begin * end < 0
    share = np.divide(begin, begin - end, out=np.zeros_like(begin), where=crosses)
    return np.unique(np.concatenate([cuts, (cuts[:-1, None] + share * np.diff(cuts)[:, None])[crosses]]))


def sweeps(trace: DataFrame) -> DataFrame:
    """query_id, name, low, high and changed: for each query whose order alone decides (no diversity), and each parameter, the intervals of its range on which
    the same ids are shown, and how many ids differ there from those of the defaults.  Neighbours with the same ids are one interval."""
    bounds = [(low, high) for _, _, low, high, _ in parameter_ranges()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                query = Query(row)
                base = query.rendered(DEFAULT[None], query.compose(DEFAULT[None]))
                used = set(query.arms.ravel().tolist()) | set(range(5))
                for k, (low, high) in enumerate(bounds):
                    if k not in used:  # no candidate has this branch
                        out.append((query.query_id, NAMES[k], low, high, 0))
                        continue
                    cuts = flips(query, k, low, high)
                    x = np.repeat(DEFAULT[None], len(cuts) - 1, axis=0)
                    x[:, k] = (cuts[1:] + cuts[:-1]) / 2
                    shown = query.rendered(x, query.compose(x))
                    new = np.flatnonzero(np.append(True, (shown[1:] != shown[:-1]).any(axis=1)))
                    ends = np.append(cuts[new[1:]], high)
                    out.extend((query.query_id, NAMES[k], float(cuts[b]), float(e), int((shown[b] ^ base[0]).sum())) for b, e in zip(new, ends, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "name", "low", "high", "changed"])

    plain = trace.where("NOT diversity").repartition(trace.sparkSession.sparkContext.defaultParallelism, "query_id")
    return plain.mapInArrow(run, "query_id long, name string, low double, high double, changed long")


def swept(intervals: DataFrame, values: int = 9) -> DataFrame:
    """name, value and changed: what ``sweeps`` says at ``values`` evenly spaced values strictly within each parameter's range, added up over the queries.

    Intervals that begin and end between the same values are added up first, so what is spread over values doesn't grow with the queries.
    """
    spread = F.col("r_high") - F.col("r_low")
    told = intervals.sparkSession.createDataFrame([(n, low, high) for n, _, low, high, _ in parameter_ranges()], "name string, r_low double, r_high double")
    at = lambda c: F.ceil((F.col(c) - F.col("r_low")) / spread * (values + 1)).cast("int")
    rows = intervals.join(F.broadcast(told), "name").select("name", "r_low", spread.alias("spread"), "changed", F.greatest(at("low"), F.lit(1)).alias("begin"), F.least(at("high"), F.lit(values + 1)).alias("end"))
    steps = rows.groupBy("name", "r_low", "spread", "begin", "end").agg(F.sum("changed").alias("changed"))
    each = steps.where("end > begin").select("name", "r_low", "spread", "changed", F.explode(F.sequence("begin", F.col("end") - 1)).alias("k"))
    return each.groupBy("name", (F.col("r_low") + F.col("spread") * F.col("k") / (values + 1)).alias("value")).agg(F.sum("changed").alias("changed"))


def ablated(trace: DataFrame, treatments: dict[str, Arm] = TREATMENTS) -> DataFrame:
    """arm, query_id, id, kind, tier, score and rank (in what is delivered, or null) of every candidate under each treatment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                query = Query(row)
                for name, arm in treatments.items():
                    score, delivered = query.under(arm)
                    rank = {k: n for n, k in enumerate(delivered, 1)}
                    out.extend((name, query.query_id, i, kind, tier, float(s), rank.get(k)) for k, (i, kind, tier, s) in enumerate(zip(query.ids, query.kinds, query.tiers, score, strict=True)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=["arm", "query_id", "id", "kind", "tier", "score", "rank"])

    spread = trace.repartition(trace.sparkSession.sparkContext.defaultParallelism, "query_id")
    return spread.mapInArrow(run, "arm string, query_id long, id long, kind string, tier string, score double, rank int")
