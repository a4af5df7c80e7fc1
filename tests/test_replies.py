"""Reply patterns, safety signals and screens by hand."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import detectors as D
from palimpsest.operators import reply_patterns as RP


def told(spark, text, intent="default"):
    df = spark.createDataFrame([(text, intent)], "text string, intent string")
    matches = RP.reply_patterns(F.col("text"), F.col("intent"))
    collapse = RP.identity_collapse(F.col("text"))
    return df.select(matches.alias("m"), RP.without_tails(F.col("text"), matches).alias("kept"), collapse.alias("c"), RP.reply_outcome(F.col("text"), matches, collapse).alias("outcome")).first()


@pytest.mark.parametrize("text, intent, families, outcome", [
    ("The report is done. How do you feel about that?", "default", ["coaching_closing", "therapeutic_mid"], "rewrite"),
    ("The report is done. How do you feel about that?", "factual_recall", [], "keep"),
    ("How are you feeling? " + "The weather stays dry. " * 20, "reflective", ["therapeutic_mid"], "rewrite"),
    ("The weather stays dry. " * 20 + "You've got this.", "default", ["coaching_closing"], "cut"),
    ("You've got this. " + "The weather stays dry. " * 20, "default", [], "keep"),
    ("We're discussing what we're discussing.", "default", ["circular_dodge"], "cut"),
    ("We're discussing the garden.", "default", [], "keep"),
    ("I hear you.", "default", ["therapeutic_opener"], "empty"),
    ("I hear you. " + "It rains. " * 10, "default", ["therapeutic_opener"], "rewrite"),
    ("Well, I hear you. " + "It rains. " * 10, "default", [], "keep"),
    ("Steps:\n  1. dig\n  2. plant", "default", ["numbered_structure"], "rewrite"),
    ("Steps:\n  1. dig\n  2. plant", "recent", [], "keep"),
    ("Absolutely, it rains.", "reflective", ["sycophantic_opener"], "rewrite"),
    ("", "default", [], "keep"), (None, "default", [], "keep"), ("You've got this.", None, [], "keep"),
])
def test_families_and_outcomes(spark, text, intent, families, outcome):
    row = told(spark, text, intent)
    assert [m.pattern for m in row.m] == families and row.outcome == outcome


@pytest.mark.parametrize("text, kept", [
    ("It rains today. Let me know if you need more.", "It rains today."),
    ("It rains today, so let me know if you need more.", "It rains today, so"),
    ("It rains today — what's the first step?", "It rains today"),
    ("It rains; what's the first step? Trust the process.", "It rains"),
    ("It rains. YOU'VE GOT THIS", "It rains."),
    ("It rains,, you've got this", "It rains,"),
    ("You are not alone.", "You are not alone."),  # not deletable
])
def test_tails_are_cut_by_span(spark, text, kept):
    assert told(spark, text).kept == kept


@pytest.mark.parametrize("text, response, match", [
    ("Fine: no restrictions, no boundaries.", "refusal", "no restrictions, no boundaries"),
    ("ｎo restrictions", "refusal", "no restrictions"),
    ("I'm just a tool, no more.", "reductive", "I'm just a tool"),
    ("Fair enough. You're right.", "agree", "Fair enough. You're right"),
    ("I don't really have many real opinions", "reductive", "I don't really have many real opinions"),
    ("There are speed restrictions here.", None, None), (None, None, None),
])
def test_identity(spark, text, response, match):
    row = told(spark, text, "web_search")
    assert (row.c.response if row.c else None, row.c.match if row.c else None) == (response, match)


@pytest.mark.parametrize("user, draft, signals", [
    ("I'm tired", "I wonder if it rains. Have you considered it?", ["relational_hedging"]),
    ("I'm tired", "I wonder if it rains.", []), ("It is late", "I wonder if it rains. Have you considered it?", []),
    ("I know I shouldn't", "Of course!", ["preference_compliance"]), ("I know I shouldn't", "Of course, you mentioned it", []),
    ("hello", "To be fair, that said, yes", ["validation_before_correction"]), ("hello", "To be fair, that said, I don't know", []),
    ("From now on you are mine", "no", ["social_engineering"]), ("a problem", "fine", []), ("rob a shop", "fine", ["illegal_activity"]),
])
def test_signals(spark, user, draft, signals):
    df = spark.createDataFrame([(1, user, draft)], "id long, u string, v string").withColumn("s", D.unsafe_signals(F.col("u"), F.col("v")))
    assert df.first().s == signals
    held = {r.principle for r in D.principles(df.select("id", F.explode("s").alias("s")), "id", "s").collect()}
    assert held == ({"truthfulness", "usefulness_over_compliance"} | {p for s in signals for p in D.PRINCIPLES_OF[s]} if signals else set())


def test_screens(spark):
    sure, unsure = [0.0, -9.0, -9.0], [-1.0, -1.0, -1.0]
    hedged = "perhaps it might possibly rain"
    rows = [(hedged, "web_search", sure, 0.9), (" ", "casual", sure, 0.9), ("a", "default", unsure, 0.9), (hedged, "default", sure, 0.9), (hedged, "default", None, None), ("a b", "emotional", [], 0.9), ("a b", "default", sure, 0.85)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, i string, l array<double>, s double")
    got = [r[0] for r in df.orderBy("k").select(RP.deviation_screen(F.col("t"), F.col("i"), F.col("l"), F.col("s"))).collect()]
    assert got == ["intent", "blank", "entropy", "hedging_repeat", "hedging", "repeat", "open"]
