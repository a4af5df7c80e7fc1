"""Full context assembly for a batch of queries: channels, gates, scores, filters and selection.

One DataFrame pipeline.  Candidates are cut to the k best of each kind before anything else is joined, so all windows below see
some hundred rows a query at most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.folders import written
from . import gates as G
from . import ranking as R
from . import vectors as V
from .replay import arm_numbers, earlier_terms

#: Candidates of each kind for the memory and the profile channel, and of reflections for theirs.
PER_KIND, PER_REFLECTION = 32, 12
# Markers of reflective and of work queries, which lift kinds.
REFLECTIVE = (
    "what patterns", "have you noticed", "based on my history", "from my history", "what have we discussed", "what have we been discussing",
    "what have we chatted about", "how have i been", "what themes", "summarize", "recap", "reflect", "lately",
)
WORK = (
    "fix", "build", "implement", "update", "write", "refactor", "debug", "error", "issue", "architecture", "pipeline", "service", "api", "prompt",
    "context", "ranker", "retriever", "workflow", "agent",
)


def intent_adjustment(query: Column, kind: Column, content: Column) -> Column:
    """What a normalized query's intent adds to the score of a record of a kind."""
    said = F.when(F.startswith(content, F.lit("user:")), 0.10).when(F.startswith(content, F.lit("assistant:")), -0.10).otherwise(0.0)
    reflective = F.when(kind == "conversation", 0.10).when(kind == "reflection", 0.08).when(kind == "ingested", -0.03).otherwise(0.0) + said
    work = F.when(kind == "ingested", 0.08).when(kind == "conversation", 0.03).otherwise(0.0)
    return F.when(T.contains_any(query, REFLECTIVE), reflective).when(T.contains_any(query, WORK), work).otherwise(0.0)


def exclusion(content: Column, markers: tuple[str, ...]) -> Column:
    """Why a search leaves out a record's normalized content, by the first rule; null where it doesn't."""
    return (
        F.when(content == "", "empty").when(F.length(content) < 40, "short").when(T.contains_any(content, markers), "meta")
        .when(T.starts_any(content, ("{", "[")), "json").when(F.contains(content, F.lit("```")), "fence")
    )


def described_queries(queries: DataFrame, assistant: str | None = None) -> DataFrame:
    """query_id, embedding, q (normalized), terms, names, policy with its parameters, and flags of each query (query_id, text, embedding, project_id)."""
    spark = queries.sparkSession
    text = F.col("text")
    rows = queries.select(
        "query_id", "embedding", F.col("project_id").alias("q_project"), T.normalize(text).alias("q"), T.query_terms(T.normalize(text)).alias("terms"),
        G.entity_names(text).alias("names"), R.classify_query(text).alias("policy"), R.relational(text).alias("relational"),
        G.identity_query(text, assistant).alias("identity"),
    )
    return rows.join(F.broadcast(R.policies(spark)), "policy")


def searched(queries: DataFrame, records: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """The nearest records of each kind for described queries, with their content and adjusted score.

    A record that many queries found is normalized and tested once: the distinct ones are prepared before they meet their queries.
    """
    live = records.where("NOT coalesce(suppressed, false)")
    near = written(V.top_k(queries.select("query_id", "embedding"), live.select("vec_id", "embedding", "kind"), PER_KIND, group="kind"), "near")
    found = live.drop("embedding", "kind").join(near.select("vec_id").distinct(), "vec_id", "left_semi")
    # a generator's output is computed once a row, and filters on it stay here
    found = found.repartition("vec_id").withColumn("content", F.explode(F.array(T.normalize(F.col("text")))))
    found = found.where(exclusion(F.col("content"), markers).isNull())
    lived, working = R.told_of(F.col("content_kind"), F.lower("text"), F.lower("title"))
    facts = F.struct(lived.alias("lived"), working.alias("working"), F.length(F.trim("text")).alias("length"))
    found = found.withColumn("_facts", F.explode(F.array(facts))).select("*", "_facts.*").drop("_facts")
    # few bytes but much work follows: a fixed number of parts, by query, which later windows use too
    rows = near.join(found, "vec_id").join(queries.drop("embedding"), "query_id")
    rows = rows.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")
    bonus = R.lexical_bonus(F.col("q"), F.col("terms"), F.col("content")) + G.entity_bonus(F.col("names"), F.col("content"))
    adjusted = F.col("cosine") + bonus + intent_adjustment(F.col("q"), F.col("kind"), F.col("content"))
    return rows.withColumn("found", adjusted)


def channels(rows: DataFrame, floor: float = 0.25) -> DataFrame:
    """Profile, memory and reflection channel of each query, each record in one of them, with ``channel`` and ``place``.

    A memory whose id or content is among the query's reflections is left to them; of equal contents in the other two
    channels the first stays, profile first.  Rows that are dealt by query stay so through all windows here and below.
    """
    wide = F.col("identity")
    tests = {
        "profile": (F.col("kind") == "profile") & (F.col("rank") <= F.when(wide, PER_KIND).otherwise(12)) & (F.col("cosine") >= F.when(wide, 0.0).otherwise(0.3)),
        "memory": F.col("cosine") >= floor,
        "reflection": (F.col("kind") == "reflection") & (F.col("rank") <= PER_REFLECTION),
    }
    limits = {"profile": F.when(wide, 8).otherwise(3), "memory": F.lit(8), "reflection": F.lit(3)}
    for name, test in tests.items():
        w = Window.partitionBy("query_id", f"_{name}").orderBy(F.desc("found"), "vec_id")
        rows = rows.withColumn(f"_{name}", test).withColumn(f"_{name}_n", F.row_number().over(w))
    taken = [
        F.when(F.col(f"_{name}") & (F.col(f"_{name}_n") <= limit), F.struct(F.lit(name).alias("channel"), F.col(f"_{name}_n").alias("place")))
        for name, limit in limits.items()
    ]
    rows = rows.withColumn("_c", F.explode(F.filter(F.array(*taken), lambda c: c.isNotNull()))).select("*", "_c.*")
    rows = rows.drop("_c", *[f"_{n}" for n in tests], *[f"_{n}_n" for n in tests])
    apart = G.channel_exclusion(F.col("text"), F.col("content"), F.col("q")).isNull()
    rows = rows.where(F.when(F.col("channel") == "profile", F.length(F.trim("text")) >= 40).otherwise(apart))
    reflected = (F.col("channel") == "reflection").cast("int")
    rows = rows.withColumn("_content", F.max(reflected).over(Window.partitionBy("query_id", "content")))
    rows = rows.withColumn("_id", F.max(reflected).over(Window.partitionBy("query_id", "vec_id")))
    rows = rows.where((F.col("channel") == "reflection") | (F.greatest("_content", "_id") == 0)).drop("_content", "_id")
    order = F.array_position(F.array(F.lit("profile"), F.lit("memory")), F.col("channel"))
    first = F.row_number().over(Window.partitionBy("query_id", "content", F.col("channel") == "reflection").orderBy(order, "place"))
    return rows.withColumn("_n", first).where("channel = 'reflection' OR _n = 1").drop("_n")


def scored(rows: DataFrame, as_of: Column, usual: float = 0.5, ingested: float = 0.15) -> DataFrame:
    """All channel rows with ``closed`` (the relevance gate, then also ``shut``, or the role predicate keeps them out), ``eligible`` (for the policy), the branch
    of every factor, and ``exact``, their score before it is rounded."""
    reflection = F.col("channel") == "reflection"
    closed = R.gate_closed("query_id", F.col("policy"), usual, ingested, ~reflection)
    rows = rows.withColumn("_closed", closed)
    shut = F.col("_closed") & (reflection | (F.col("kind") != "profile"))
    kept_out = shut | (~reflection & (F.lower(F.coalesce("role", F.lit(""))) == "assistant"))
    own = F.coalesce("authorship", F.lit("unknown"))
    rows = rows.withColumns({
        "closed": kept_out, "shut": shut,
        "eligible": G.type_gate(F.col("kind"), F.lit(1.0), F.col("policy")),
        "weight": F.when(reflection, F.col("reflection_weight")).otherwise(F.col("memory_weight")),
        "tier_branch": F.when(F.col("kind") == "profile", "profile_bypass").otherwise(F.col("tier")),
        "author_branch": F.when(~reflection & F.col("relational"), F.when(own.isin(*R.AUTHORSHIP), own).otherwise("unknown")).otherwise("none"),
        "bucket": T.recency_bucket(T.age_days(F.col("created"), as_of)),
        "policy_branch": R.policy_arm(F.col("preference"), F.col("content_kind"), F.col("lived"), F.col("working")),
        "in_project": F.coalesce(F.col("project_id") == F.col("q_project"), F.lit(False)),
    })
    author = F.when(F.col("author_branch") == "none", 1.0).when(F.col("author_branch") == "unknown", 0.5).otherwise(R._arm(R.AUTHORSHIP, F.col("author_branch")))
    prior = R.metadata_prior(F.col("content_kind"), F.col("length"), F.col("bucket"), F.col("policy_branch"), F.col("in_project"), reflection)
    return rows.withColumn("exact", F.col("found") * F.col("weight") * R.tier_factor(F.col("tier_branch")) * author * prior).drop("_closed")


def gated_and_scored(rows: DataFrame, as_of: Column, usual: float = 0.5, ingested: float = 0.15) -> DataFrame:
    """Rows that pass the relevance gate, the type gate and the role predicate, with their final ``score``."""
    rows = scored(rows, as_of, usual, ingested).where("NOT closed").where(G.type_gate(F.col("kind"), F.col("found"), F.col("policy")))
    return rows.withColumn("score", F.round("exact", 9))


def filtered(rows: DataFrame, assistant: str | None = None) -> DataFrame:
    """Memories that are no echo and not of low value, or all of a query's where that leaves none; the first of each content; reflections likewise."""
    memory = F.col("channel") != "reflection"
    good = G.echo(F.col("content"), F.col("q"), assistant=assistant).isNull() & G.low_value(F.col("content"), F.col("content_kind")).isNull()
    rows = rows.withColumn("_good", ~memory | good)
    any_good = F.max((memory & F.col("_good")).cast("int")).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_any", any_good).where("_good OR _any = 0").drop("_good", "_any")
    order = F.array_position(F.array(F.lit("profile"), F.lit("memory"), F.lit("reflection")), F.col("channel"))
    rows = rows.withColumn("_order", order)
    w = Window.partitionBy("query_id", memory, "content").orderBy(F.desc("score"), "_order", "place")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def selected(rows: DataFrame) -> DataFrame:
    """query_id, vec_id, kind, channel, score and slot: profile rows first, then others up to the policy's limit (by turns where it wants
    diversity), then reflections.  Only others of queries that want diversity, a few a query, go through Python."""
    part = F.when(F.col("channel") == "reflection", 2).when(F.col("kind") == "profile", 0).otherwise(1)
    w = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "_order", "place")
    ranked = rows.withColumn("part", part).withColumn("n", F.row_number().over(w))
    turns = F.col("diversity") & (F.col("part") == 1)
    columns = ("query_id", "vec_id", "kind", "channel", "score", "part", "n")
    tokens = F.when(turns, T.token_set(F.col("content")))
    ranked = written(ranked.select(*columns, turns.alias("turns"), "doc", "title", "memory_limit", "reflection_limit", tokens.alias("tokens")), "ranked")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        sorted_ = list(pdf.sort_values("n").itertuples())
        chosen = R.pick_in_turns(sorted_, int(sorted_[0].memory_limit))
        out = [(r.query_id, r.vec_id, r.kind, r.channel, r.score, r.part, n) for n, r in enumerate(chosen, 1)]
        return pd.DataFrame(out, columns=columns)

    schema = "query_id long, vec_id long, kind string, channel string, score double, part int, n int"
    most = F.when(F.col("part") == 1, F.col("memory_limit")).when(F.col("part") == 2, F.col("reflection_limit")).otherwise(F.col("n"))
    plain = ranked.where(~F.col("turns") & (F.col("n") <= most)).select(*columns)
    chosen = plain.unionByName(ranked.where("turns").drop("turns").groupBy("query_id").applyInPandas(choose, schema))
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "n"))
    return chosen.select("query_id", "vec_id", "kind", "channel", "score", slot.alias("slot"))


def traced(queries: DataFrame, records: DataFrame, as_of: Column, markers: tuple[str, ...], assistant: str | None = None, floor: float = 0.25, usual: float = 0.5, ingested: float = 0.15) -> DataFrame:
    """What assembly sees of each candidate of a channel, gated or not, without its text: the trace that ``replay`` works on (its ``CANDIDATE`` columns and
    the query's limits), not yet packed by query."""
    rows = scored(channels(searched(described_queries(queries, assistant), records, markers), floor), as_of, usual, ingested)
    memory = F.col("channel") != "reflection"
    good = ~memory | (G.echo(F.col("content"), F.col("q"), assistant=assistant).isNull() & G.low_value(F.col("content"), F.col("content_kind")).isNull())
    order = F.array_position(F.array(F.lit("profile"), F.lit("memory"), F.lit("reflection")), F.col("channel"))
    rows = rows.withColumn("_good", good).withColumn("_order", order)
    takes = F.col("_good") & ~F.col("closed") & G.type_gate(F.col("kind"), F.col("found"), F.col("policy"))
    same = Window.partitionBy("query_id", memory, "content", takes).orderBy(F.desc("exact"), "_order", "place")
    rows = rows.withColumn("_again", takes & (F.row_number().over(same) > 1))
    reflective, work = T.contains_any(F.col("q"), REFLECTIVE), T.contains_any(F.col("q"), WORK)
    asks = F.when(reflective, "reflective").when(work, "task")
    said = F.when(F.startswith("content", F.lit("user:")), "user").when(F.startswith("content", F.lit("assistant:")), "assistant")
    named = lambda prefix, c: F.concat(F.lit(prefix), c)
    policy = F.when(F.col("policy_branch") == "active_work", "prefer_active_work").otherwise(F.col("policy_branch"))
    branches = {
        "intent": F.concat(F.lit("ret.intent."), asks, F.lit("_"), F.col("kind")),
        "prefix": F.when(reflective, F.concat(F.lit("ret.intent.reflective_"), said, F.lit("_prefix"))),
        "tier": named("tier.", F.col("tier_branch")), "author": named("auth.", F.col("author_branch")), "policy": named("prior.policy.", policy),
        "project": F.when(F.col("in_project"), "prior.project.match"), "kind": named("prior.kind.", F.col("content_kind")),
        "length": F.when(F.col("length") < 50, "prior.len.lt50").when(F.col("length") > 1200, "prior.len.gt1200"),
        "recency": named("prior.recency.", F.col("bucket")), "reflection": F.when(~memory, "prior.reflection_discount"),
    }
    return rows.select(
        "query_id", "diversity", "memory_weight", "memory_limit", "reflection_limit", "_order", "place", "vec_id", (~memory).alias("reflection"), (F.col("kind") == "profile").alias("profile"), "cosine",
        ((F.col("q") != "") & F.contains("content", F.col("q"))).alias("whole"), F.size(F.filter("terms", lambda t: F.contains("content", t))).alias("hits"),
        F.size(F.filter("names", lambda n: F.contains("content", n))).alias("names"), "weight", arm_numbers(branches).alias("arms"), "closed", "shut", "eligible",
        (~F.col("_good") | F.col("_again")).alias("filtered"), "exact", earlier_terms(F.col("kind"), F.col("role"), F.col("content")).alias("earlier"), "kind", "tier", "doc", "title", F.when(F.col("diversity"), T.token_set(F.col("content"))).alias("tokens"),
    )


def assemble(queries: DataFrame, records: DataFrame, as_of: Column, markers: tuple[str, ...], assistant: str | None = None, floor: float = 0.25, usual: float = 0.5, ingested: float = 0.15) -> DataFrame:
    """What each query gets: query_id, vec_id, kind, channel, score and slot.

    ``queries``: query_id, text, embedding, project_id.  ``records``: vec_id, kind, text, embedding, created, tier, role,
    content_kind, authorship, project_id, doc, title, suppressed.  A query without a candidate has no rows.
    """
    rows = searched(described_queries(queries, assistant), records, markers)
    rows = gated_and_scored(channels(rows, floor), as_of, usual, ingested)
    return selected(filtered(rows, assistant))


def rendered(delivered: DataFrame, memories: int = 4, reflections: int = 1) -> DataFrame:
    """What of the delivered rows is shown: all profile rows, the first ``memories`` others and ``reflections``."""
    part = F.when(F.col("channel") == "reflection", 2).when(F.col("kind") == "profile", 0).otherwise(1)
    rows = delivered.withColumn("part", part)
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy("slot")))
    most = F.when(F.col("part") == 0, F.col("_r")).when(F.col("part") == 1, memories).otherwise(reflections)
    return rows.where(F.col("_r") <= most).drop("_r", "part")


def delivery_events(shown: DataFrame, stored: DataFrame) -> DataFrame:
    """query_id, store, requested, matched and outcome: shown rows go to their kind's store, where ``stored`` (vec_id) has them or not."""
    store = F.when(F.col("kind") == "ingested", "ingested").otherwise("memory")
    rows = shown.where(F.col("vec_id").isNotNull()).withColumn("store", store).join(stored.select("vec_id", F.lit(1).alias("_there")), "vec_id", "left")
    out = rows.groupBy("query_id", "store").agg(F.count("*").alias("requested"), F.count("_there").alias("matched"))
    outcome = F.when(F.col("matched") == F.col("requested"), "matched").when(F.col("matched") == 0, "all_missed").otherwise("missed")
    return out.withColumn("outcome", outcome)
