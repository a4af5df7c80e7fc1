"""Sequences and sorted structures cut into pieces, against loops."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audit as A
from palimpsest.operators import signals as N
from palimpsest.operators import tiering as H
from palimpsest.sources import imports as I


@pytest.mark.parametrize("words, segment_rows", [(13, 30), (400, 1000)])
def test_recent_duplicates_in_segments_equal_a_loop(spark, words, segment_rows):
    """Few words make what a segment leaves depend on what it began with, over many segments."""
    rng = random.Random(words)
    rows = [(k % 2 and rng.choice(["a", "b"]) or "a", k, f" W{rng.randint(0, words)} ") for k in range(200)] + [(None, 900, "x"), (None, 901, "X "), (None, 902, None), (None, 903, "")]
    df = spark.createDataFrame(rows, "kind string, at long, text string").repartition(5)
    held, want = {}, []
    for kind, at, text in sorted(rows, key=lambda r: r[1]):
        said = (text or "").strip().lower()
        recent = held.setdefault(kind, deque(maxlen=10))
        want.append((str(kind), at, said in recent))
        if said not in recent:
            recent.append(said)
    got = I.recent_duplicates(df, ["kind"], "at", "text", segment_rows=segment_rows).collect()
    assert sorted((str(r.kind), r.at, r.skipped) for r in got) == sorted(want)


@pytest.mark.parametrize("slice_rows", [3, 50_000])
def test_unlisted_urls_in_slices_equal_all_pairs(spark, slice_rows):
    rng = random.Random(slice_rows)
    def some(n):
        return [(k, rng.choice(["hot.org", "hot.org", "b.org", "hot.org.uk"]), "".join(rng.choice(["/a", "/b", "/", "c"]) for _ in range(rng.randint(0, 5)))) for k in range(n)]
    urls, allowed = some(300) + [(999, "localhost", "/x")], some(12)
    ok = lambda u: any(a[1] == u[1] and (u[2].startswith(a[2]) or a[2].startswith(u[2])) for a in allowed)
    want = sorted(u for u in urls if u[1] != "localhost" and not ok(u))
    schema = "id long, host string, path string"
    got = N.unlisted_urls(spark.createDataFrame(urls, schema), spark.createDataFrame(allowed, schema), slice_rows)
    assert sorted((r.id, r.host, r.path) for r in got.select("id", "host", "path").collect()) == want
    assert N.unlisted_urls(spark.createDataFrame(urls, schema), spark.createDataFrame([], schema)).count() == 300


def test_nightly_run_by_hand(spark):
    day = 86_400
    rows = [
        ("p", "profile", 0, None, None, "hot", 0.7), ("old", "journal", 0, None, None, "hot", 0.9), ("new", "journal", 300 * day, None, None, "hot", 0.625),
        ("quirk", "journal", 300 * day, None, None, None, 0.0), ("near", "journal", 300 * day, None, None, "hot", 0.63), ("used", "journal", 0, 300 * day, 10.0, "cold", 0.1),
        ("r1", "reflection", 300 * day, None, None, "hot", 0.625), ("r2", "reflection", 300 * day, None, None, "hot", 0.625), ("r3", "reflection", 300 * day, None, None, "cold", 0.625),
    ]
    store = spark.createDataFrame(rows, "id string, kind string, c long, l long, frequency double, tier string, heat_score double")
    store = store.select("id", "kind", F.timestamp_seconds("c").alias("created"), F.timestamp_seconds("l").alias("last_retrieved"), "frequency", "tier", "heat_score")
    edges = spark.createDataFrame([("r1", "used"), ("r3", "old"), ("r3", "gone")], "derived string, source string")
    run = H.nightly_run(store, edges, F.timestamp_seconds(F.lit(300 * day)))
    got = {r.id: (r.old_tier, r.tier, round(r.heat, 4), r.written) for r in run.collect()}
    assert got == {
        "p": ("hot", "hot", 0.625, True), "old": ("hot", "cold", 0.0, True), "new": ("hot", "hot", 0.625, False), "quirk": ("hot", "hot", 0.625, True), "near": ("hot", "hot", 0.625, False),
        "used": ("cold", "hot", 1.0, True), "r1": ("hot", "cold", 0.625, True), "r2": ("hot", "cold", 0.625, True), "r3": ("cold", "hot", 0.625, True),
    }
    totals = {r.name: r.n for r in H.run_totals(run).collect()}
    assert totals["hot_to_cold"] == 3 and totals["cold_to_hot"] == 2 and totals["unchanged"] == 4 and totals["total"] == 9 and totals["written"] == 7
    moves = {(r.old, r.new): (r.n, r.first_id) for r in H.tier_moves(store, run).collect()}
    assert moves["(none)", "hot"] == (1, "quirk") and moves["hot", "cold"] == (3, "old")
    shares = {r.tier: (r.before, r.after) for r in H.tier_shares(store, run).collect()}
    assert shares == {"hot": (6, 6), "cold": (2, 3), "(none)": (1, 0)}
    assert H.signal_counts(H.without_signal(store)).first()[1:] == (0, 0) and H.signal_counts(store).first()[1:] == (1, 1)


def test_branches_count_by_their_parent(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, "x", None), (4, None, True)], "at long, arm string, t boolean")
    got = {r.site: r for r in A.branch_counters(df, {"way": F.col("arm")}, ["here"], "at", {"test": F.col("t")}).collect()}
    assert (got["way=x"].firings, got["way=x"].evaluations, got["way=x"].denominator, got["way=x"].parent) == (2, 0, 3, "way")
    assert (got["test"].firings, got["test"].evaluations, got["test"].denominator) == (2, 3, 3)
    assert (got["here"].firings, got["way"].evaluations, got["way"].firings, got["way"].last_seen) == (4, 3, 0, 3) and len(got) == 5
