"""Policies, gates, scores and selection."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, normalize
from .gates import SEARCH_MARKERS, bare_search, intent_rule

# Query markers in the order of evaluation.
TASK_MARKERS = ("status of", "status update", "where are we on", "where are we with", "where does the")
STATE_MARKERS = (
    "what am i working on", "what are my open loops", "what is my current focus", "what's my current focus", "current focus", "open loops",
    "what are my priorities", "active projects", "what are my blockers", "my blockers", "what is blocking", "what's blocking", "current state",
    "where am i at", "what am i focused on", "catch me up", "remind me what", "my routine", "my routines", "my morning", "my schedule", "my habits",
)
REFLECTIVE_MARKERS = (
    "pattern", "patterns", "theme", "themes", "trend", "trends", "what do you notice", "what have you noticed", "reflect", "reflection",
    "summarize me", "summarise me", "struggling", "what do i usually", "what have i been", "how have i been",
)
RECENT_MARKERS = ("recently", "lately", "today", "this week", "these days", "currently", "right now")
ACTIVITY_MARKERS = ("working on", "building", "doing", "focused on", "making progress on", "up to")
RECALL_MARKERS = ("when did", "what did i say", "where did i mention", "find", "look up", "search", "recall", "remember when")
KIN = (
    "son", "daughter", "child", "kid", "kids", "children", "partner", "spouse", "husband", "wife", "boyfriend", "girlfriend", "mother", "father",
    "mom", "dad", "parent", "parents", "brother", "sister", "sibling", "siblings", "family", "friend", "friends", "colleague", "coworker", "boss",
    "roommate", "neighbor", "dog", "cat", "pet", "bird", "fish", "rabbit", "hamster", "horse", "animal",
)
DOMAINS = ("job", "work", "career", "health", "home", "house", "body", "mood", "relationship", "marriage", "religion", "spirituality", "practice")
# Policy, memory weight, reflection weight, diversity, preference, state boost, memory limit, reflection limit.
POLICIES = (
    ("clarification", 1.0, 1.0, False, "none", 0.0, 6, 2), ("web_search", 0.5, 0.3, False, "none", 0.0, 6, 2),
    ("task_status", 0.6, 0.5, False, "active_work", 2.0, 6, 2), ("status_state", 0.6, 0.5, False, "active_work", 2.0, 6, 2),
    ("reflective", 0.7, 1.4, True, "experience", 0.0, 4, 3), ("factual_recall", 1.2, 0.4, False, "exact", 0.0, 6, 1),
    ("recent_activity", 1.3, 0.7, True, "active_work", 0.0, 6, 2), ("recent", 1.1, 0.9, True, "none", 0.0, 5, 2),
    ("activity", 1.2, 0.6, True, "active_work", 0.0, 6, 1), ("default", 1.0, 1.0, False, "none", 0.0, 6, 2),
)
# The measured spread of cosines over the mean best one, and the total-order index of each arm of the metadata prior.
SPREAD = 0.0815 / 0.6375
ST = {
    "experience": 0.2216, "user_content": 0.1191, "question": 0.1687, "short": 0.0559, "long": 0.0058, "recency": 0.2371,
    "active_work": 0.2453, "prefer_experience": 0.0323, "exact_other": 0.0524, "exact_question": 0.0525, "project": 0.0080, "reflection": 0.0208,
}
RECENCY_LADDER = {"d7": 0.18, "d30": 0.12, "d90": 0.06, "d365": 0.02}
# Markers of lived experience and of work in progress.
EXPERIENCE = (
    "i am", "i'm", "i was", "i have", "i've", "i feel", "i felt", "today", "yesterday", "this week", "lately", "noticed", "experiencing", "having",
    "trying",
)
ACTIVE_WORK = (
    "working on", "trying to", "focused on", "making progress", "next step", "next steps", "plan", "planning", "started", "finished", "need to",
    "figuring out", "stuck", "blocked", "updating", "changing", "organizing", "building", "improving", "fixing",
)
# The tier and the prior share the lower bound evenly; the worst arms of all families together reach a bound exactly.
PRIOR_MIN, PRIOR_MAX = math.sqrt(1 - SPREAD), 1 + SPREAD
TIER_FACTORS = {"hot": 1.0, "warm": math.sqrt(PRIOR_MIN), "cold": PRIOR_MIN}


def _arms(bound: float, worst: tuple[str, ...], names: tuple[str, ...]) -> dict[str, float]:
    """Each arm's factor: its index's part of the log of the bound, which the ``worst`` arms share."""
    total = sum(ST[w] for w in worst)
    return {n: math.exp(math.log(bound) * ST[n] / total) for n in names}


UP = _arms(PRIOR_MAX, ("experience", "recency", "active_work", "project"), ("experience", "user_content", "recency", "active_work", "prefer_experience", "exact_other", "project"))
DOWN = _arms(PRIOR_MIN, ("question", "short", "recency", "exact_question", "reflection"), ("question", "short", "long", "recency", "exact_question", "reflection"))
KIND_ARMS = {"experience": UP["experience"], "user_content": UP["user_content"], "question": DOWN["question"]}
RECENCY_ARMS = {b: UP["recency"] ** (r / RECENCY_LADDER["d7"]) for b, r in RECENCY_LADDER.items()} | {"older": DOWN["recency"]}
SHORT_ARM, LONG_ARM = DOWN["short"], DOWN["long"]
POLICY_ARMS = {"prefer_experience": UP["prefer_experience"], "active_work": UP["active_work"], "exact_question": DOWN["exact_question"], "exact_other": UP["exact_other"]}
AUTHORSHIP = {"first_person": 1.0, "mixed": 0.3}


def classify_query(text: Column) -> Column:
    """Policy of a query: the first rule whose markers occur in it.

    Explicit requests for a search come first (a bare one asks for clarification), then the status of tasks, then what the rules of
    ``intent_rule`` send to a search; the model-backed stage of that is left out.
    """
    q = F.translate(F.lower(text), "‘’", "''")
    recent, active = contains_any(q, RECENT_MARKERS), contains_any(q, ACTIVITY_MARKERS)
    return (
        F.when(bare_search(q), "clarification").when(contains_any(q, SEARCH_MARKERS), "web_search")
        .when(contains_any(q, TASK_MARKERS), "task_status").when(intent_rule(text) == "needs_internet", "web_search")
        .when(contains_any(q, STATE_MARKERS), "status_state")
        .when(contains_any(q, REFLECTIVE_MARKERS), "reflective").when(contains_any(q, RECALL_MARKERS), "factual_recall")
        .when(recent & active, "recent_activity").when(recent, "recent").when(active, "activity").otherwise("default")
    )


def policies(spark) -> DataFrame:
    return spark.createDataFrame(
        list(POLICIES),
        "policy string, memory_weight double, reflection_weight double, diversity boolean, preference string, state_boost double, memory_limit int, reflection_limit int",
    )


def relational(text: Column) -> Column:
    return F.lower(text).rlike(r"(?:^|[^\p{L}\p{N}_])my\s+(?:" + "|".join(KIN + DOMAINS) + r")(?:$|[^\p{L}\p{N}_])")


def lexical_bonus(query: Column, terms: Column, content: Column) -> Column:
    """0.10 for the whole query, 0.03 for each term that occurs, 0.18 at most."""
    hits = F.size(F.filter(terms, lambda t: F.contains(content, t)))
    whole = F.when((query != "") & F.contains(content, query), 0.10).otherwise(0.0)
    return whole + F.least(hits * F.lit(0.03), F.lit(0.18))


def _arm(values: dict[str, float], of: Column) -> Column:
    out = F.when(F.lit(False), 1.0)
    for name, value in values.items():
        out = out.when(of == name, value)
    return out.otherwise(1.0)


def tier_factor(tier: Column) -> Column:
    return _arm(TIER_FACTORS, tier)


def metadata_prior(kind: Column, length: Column, bucket: Column, policy_arm: Column | None = None, project: Column | None = None, reflection: Column | None = None) -> Column:
    """Product of an arm for the kind, the length, the recency, the policy's preference, the project and the channel, within the bounds."""
    value = F.when(length < 50, SHORT_ARM).when(length > 1200, LONG_ARM).otherwise(1.0) * _arm(KIND_ARMS, kind) * _arm(RECENCY_ARMS, bucket)
    if policy_arm is not None:
        value = value * _arm(POLICY_ARMS, policy_arm)
    if project is not None:
        value = value * F.when(project, UP["project"]).otherwise(1.0)
    if reflection is not None:
        value = value * F.when(reflection, DOWN["reflection"]).otherwise(1.0)
    return F.greatest(F.lit(PRIOR_MIN), F.least(F.lit(PRIOR_MAX), value))


def told_of(kind: Column, content: Column, title: Column) -> tuple[Column, Column]:
    """Whether a record tells of lived experience, and of work in progress; content and title are lower-cased."""
    lived = (kind == "experience") | contains_any(content, EXPERIENCE)
    return lived, contains_any(content, ACTIVE_WORK) | F.coalesce(contains_any(title, ACTIVE_WORK), F.lit(False))


def policy_arm(preference: Column, kind: Column, lived: Column, working: Column) -> Column:
    """Which arm a record takes under a policy's preference."""
    return (
        F.when((preference == "experience") & lived, "prefer_experience").when((preference == "active_work") & working, "active_work")
        .when(preference == "exact", F.when(kind == "question", "exact_question").otherwise("exact_other")).otherwise("none")
    )


def authorship_factor(relational_: Column, authorship: Column) -> Column:
    """On relational queries, what isn't surely a person's own words counts less; unknown and other authors half."""
    return F.when(relational_, F.when(authorship.isin(*AUTHORSHIP), _arm(AUTHORSHIP, authorship)).otherwise(0.5)).otherwise(1.0)


def dedup_by_content(rows: DataFrame, query: str, content: Column, order: list) -> DataFrame:
    """The first row of each query with a content; blank contents are one content."""
    w = Window.partitionBy(query, "_key").orderBy(*order)
    keyed = rows.withColumn("_key", normalize(content))
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def gate_closed(query: str, policy: Column, usual: float = 0.5, ingested: float = 0.15, counted: Column | None = None) -> Column:
    """Whether a query of the default policy has neither ingested nor other (non-profile) rows that reach their floors.

    A window over the query's rows; only ``counted`` ones are looked at.
    """
    w = Window.partitionBy(query)
    counted = F.lit(True) if counted is None else counted
    most = F.max(F.when(counted & ~F.col("kind").isin("profile", "ingested"), F.col("cosine"))).over(w)
    other = F.max(F.when(counted & (F.col("kind") == "ingested"), F.col("cosine"))).over(w)
    return (policy == "default") & (F.coalesce(most, F.lit(0.0)) < usual) & (F.coalesce(other, F.lit(0.0)) < ingested)


def relevance_gate(rows: DataFrame, query: str, policy: Column, usual: float = 0.5, ingested: float = 0.15) -> DataFrame:
    """Only profile rows of a query stay where its gate is closed."""
    return rows.withColumn("_closed", gate_closed(query, policy, usual, ingested)).where("NOT _closed OR kind = 'profile'").drop("_closed")


def guaranteed_slots(rows: DataFrame, query: str, order: list, limit: Column) -> DataFrame:
    """Profile rows first and all of them, then others up to the limit."""
    w = Window.partitionBy(query, F.col("kind") == "profile").orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).where((F.col("kind") == "profile") | (F.col("_n") <= limit)).drop("_n")
    slot = Window.partitionBy(query).orderBy((F.col("kind") != "profile").cast("int"), *order)
    return kept.withColumn("slot", F.row_number().over(slot))


def confidence(rows: DataFrame, query: str, age_days: str = "age") -> DataFrame:
    """Lowest, mean and highest score of each query's rows, and the confidence they give.

    High needs a mean of 0.6 and an oldest row of one to seven days; moderate a mean of 0.4 or an oldest row of one to thirty
    days.  An age of no whole day doesn't count, nor does an unknown one.
    """
    mean, oldest = F.avg("score"), F.max(age_days)
    recent = lambda most: F.coalesce(oldest.between(1, most), F.lit(False))
    level = F.when((mean >= 0.6) & recent(7), "high").when((mean >= 0.4) | recent(30), "moderate").otherwise("low")
    return rows.groupBy(query).agg(F.min("score").alias("lowest"), mean.alias("mean"), F.max("score").alias("highest"), level.alias("confidence"))


# Places of priorities; others and none come last.
PRIORITIES = {"high": 3, "medium": 2, "low": 1}


def state_order(rows: DataFrame, query: str, priority: Column, boost: Column, order: list) -> DataFrame:
    """State records of each query with their ``place``: by priority where the policy boosts states, else as ``order`` has them; equal ones keep that order."""
    numbers = F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair])
    rank = F.when(F.coalesce(boost, F.lit(0.0)) != 0, F.coalesce(numbers[priority], F.lit(0))).otherwise(0)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(rank), *order)))


TURNS = ("conversation", "ingested", "other")


def pick_in_turns(rows: list, most: int, same_kind: float = 0.05, same_doc: float = 0.22, same_title: float = 0.08, band: float = SPREAD) -> list:
    """Up to ``most`` of a query's rows (kind, score, tokens, doc and title, in ranking order) in turns from conversation, ingested and other rows.

    A turn takes the row of its group with the greatest score less its penalty, the first among equals; the first pick of all is the
    group's first.  The penalty adds up the greatest Jaccard similarity to a picked row (a share of the band), and what each picked row of
    its kind, document or title costs; it is a share ``band`` of the score at most.
    """
    left: dict[str, list] = {t: [] for t in TURNS}
    for row in rows:
        left[row.kind if row.kind in TURNS else "other"].append((row, set(row.tokens)))
    picked: list = []

    def worth(item) -> float:
        row, tokens = item
        ceiling = abs(row.score) * band
        cost = ceiling * max((len(tokens & t) / len(tokens | t) if tokens and t else 0.0 for _, t in picked), default=0.0)
        for p, _ in picked:
            cost += same_kind * (p.kind == row.kind) + same_doc * (bool(row.doc) and p.doc == row.doc) + same_title * (bool(row.title) and p.title == row.title)
        return row.score - min(cost, ceiling)

    while len(picked) < most and any(left.values()):
        for name in TURNS:
            if left[name] and len(picked) < most:
                best = max(left[name], key=worth) if picked else left[name][0]
                left[name].remove(best)
                picked.append(best)
    return [row for row, _ in picked]


def diversify(rows: DataFrame) -> DataFrame:
    """``pick_in_turns`` for each query: query_id, vec_id, kind, score, place (in the ranking), most, tokens, doc and title.

    A query has some forty rows, so a group is small.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        picked = pick_in_turns(list(pdf.sort_values("place").itertuples()), int(pdf["most"].iloc[0]))
        out = [(p.query_id, p.vec_id, p.kind, p.score, k) for k, p in enumerate(picked, 1)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "kind", "score", "place"])

    return rows.groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, kind string, score double, place int")
