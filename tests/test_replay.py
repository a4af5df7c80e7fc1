"""Designs, indices and replay against plain Python and known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import designs as D
from palimpsest.operators import ranking as R
from palimpsest.operators import replay as P
from palimpsest.plans import sensitivity as M

# designs


def test_every_block_has_a_point_in_each_interval():
    points = D.sobol_points(0, 256, 90, 3)
    assert (points >= 0).all() and (points < 1).all()
    for column in points.T:
        assert sorted((column * 256).astype(int)) == list(range(256))


def test_a_larger_sample_keeps_the_rows_of_a_smaller_one():
    whole = D.sobol_points(0, 512, 10, 1)
    assert (D.sobol_points(0, 128, 10, 1) == whole[:128]).all() and (D.sobol_points(200, 100, 10, 1) == whole[200:300]).all()
    small, large = D.Saltelli(16, [0] * 3, [1] * 3), D.Saltelli(32, [0] * 3, [1] * 3)
    assert (large.vectors(0, small.rows) == small.vectors(0, small.rows)).all()


def discrepancy(x):
    """Squared centred L2 discrepancy."""
    n, d = x.shape
    z = np.abs(x - 0.5)
    one = np.prod(1 + z / 2 - z**2 / 2, axis=1).sum()
    two = np.prod(1 + (z[:, None] + z[None]) / 2 - np.abs(x[:, None] - x[None]) / 2, axis=2).sum()
    return (13 / 12) ** d - 2 / n * one + two / n**2


@pytest.mark.parametrize("dimensions", [2, 8, 16])
def test_discrepancy_is_below_that_of_random_points(dimensions):
    ours = max(discrepancy(D.sobol_points(0, 512, dimensions, s)) for s in range(5))
    theirs = min(discrepancy(np.random.default_rng(s).random((512, dimensions))) for s in range(5))
    assert ours < theirs / (4 if dimensions == 2 else 1.3)


def test_saltelli_matrices():
    design = D.Saltelli(5, [0, 10, -1], [1, 20, 1], default=[0.5, 11, 0], varied=[0, 2])
    x = design.vectors(0, design.rows).reshape(5, 6, 3)
    a, b, ab0, ab1, ba0, ba1 = x.transpose(1, 0, 2)
    assert (x[:, :, 1] == 11).all()
    assert (ab0[:, 0] == b[:, 0]).all() and (ab0[:, 2] == a[:, 2]).all() and (ab1[:, 2] == b[:, 2]).all() and (ab1[:, 0] == a[:, 0]).all()
    assert (ba0[:, 0] == a[:, 0]).all() and (ba0[:, 2] == b[:, 2]).all() and (ba1[:, 2] == a[:, 2]).all() and (ba1[:, 0] == b[:, 0]).all()
    assert (design.vectors(7, 9) == design.vectors(0, design.rows)[7:16]).all()


@pytest.mark.parametrize("rows", [1, 255, 1000])
def test_draws_of_all_slices_are_exactly_the_rows(rows):
    slices = -(-rows // 64)
    counts = np.hstack([D.drawn_counts(s * 64, min(64, rows - s * 64), slices, 64, rows, 300, 9) for s in range(slices)])
    assert counts.shape == (300, rows) and (counts.sum(axis=1) == rows).all()
    assert abs(counts.mean() - 1) < 1e-9 and (rows == 1 or abs(counts.var() - (1 - 1 / rows)) < 0.05)


# indices


def outputs(spark, design, model):
    rows = M.design_rows(spark, design, span=1000)
    return M.by_sample(rows.select((F.col("sample") * design.matrices + F.col("matrix")).alias("row"), model(F.col("x")).alias("y")), design.matrices)


def test_ishigami(spark):
    design = D.Saltelli(4096, [-math.pi] * 3, [math.pi] * 3)
    rows = outputs(spark, design, lambda x: F.sin(x[0]) + 7 * F.pow(F.sin(x[1]), F.lit(2)) + 0.1 * F.pow(x[2], F.lit(4)) * F.sin(x[0]))
    singles, pairs = M.indices_with_pairs(rows, ["x1", "x2", "x3"])
    s = {r.name: r for r in singles.collect()}
    s2 = {(r.first, r.second): r.s2 for r in pairs.collect()}
    for name, first, total in (("x1", 0.3139, 0.5576), ("x2", 0.4424, 0.4424), ("x3", 0.0, 0.2437)):
        assert abs(s[name].s1 - first) < 0.02 and abs(s[name].st - total) < 0.02
    assert abs(s2["x1", "x3"] - 0.2437) < 0.03 and abs(s2["x1", "x2"]) < 0.03 and abs(s2["x2", "x3"]) < 0.03
    assert s["x3"].share > 0.9 and s["x2"].share < 0.05
    assert [tuple(r)[:2] for r in M.pairs_involving(pairs, "x3", 1).collect()] == [("x1", "x3")]


def test_additive_and_flat_functions_have_no_pairs(spark):
    design = D.Saltelli(1024, [0] * 3, [1] * 3)
    singles, pairs = M.indices_with_pairs(outputs(spark, design, lambda x: x[0] + 2 * x[1] + F.lit(0.0) * x[2]), ["a", "b", "c"])
    assert all(abs(r.s2) < 0.02 for r in pairs.collect())
    assert [round(r.s1, 2) for r in singles.orderBy("name").collect()] == [0.2, 0.8, 0.0]
    flat, none = M.indices_with_pairs(outputs(spark, design, lambda x: x[0] * 0 + 3), ["a", "b", "c"])
    assert all(r.s1 == r.st == 0 for r in flat.collect()) and all(r.s2 == 0 for r in none.collect())


def test_product_is_interaction_only(spark):
    design = D.Saltelli(2048, [-1] * 2, [1] * 2)
    rows = outputs(spark, design, lambda x: x[0] * x[1])
    _, pairs = M.indices_with_pairs(rows, ["a", "b"])
    assert abs(pairs.first().s2 - 1) < 0.05
    told = M.resampled_indices(rows, ["a", "b"], 2048, [(0, 1)], resamples=200).withColumn("clear", M.supported(F.col("low"), F.col("high")))
    held = {(r.kind, r.name): r for r in told.collect()}
    assert held["s2", "a"].clear and held["s2", "a"].low < 1 < held["s2", "a"].high and not held["s1", "a"].clear


def test_intervals_equal_plain_resampling(spark):
    design = D.Saltelli(300, [0] * 2, [1] * 2)
    rows = outputs(spark, design, lambda x: x[0] + x[0] * x[1])
    got = {(r.kind, r.name): (r.low, r.high) for r in M.resampled_indices(rows, ["a", "b"], 300, resamples=100, slice_rows=64).collect()}
    y = np.array([r.y for r in rows.orderBy("sample").collect()])
    counts = np.hstack([D.drawn_counts(s * 64, min(64, 300 - s * 64), 5, 64, 300, 100, 5) for s in range(5)])
    values = []
    for c in counts:
        z = np.repeat(y, c, axis=0)
        assert len(z) == 300
        v = np.var(np.concatenate([z[:, 0], z[:, 1]]), ddof=1)
        values.append([np.mean(z[:, 1] * (z[:, 2] - z[:, 0])) / v, np.mean((z[:, 0] - z[:, 3]) ** 2) / v / 2])
    want = np.percentile(values, [2.5, 97.5], axis=0)
    assert np.allclose(got["s1", "a"], want[:, 0]) and np.allclose(got["st", "b"], want[:, 1])


# replay


def a_query(rng, diversity=False, candidates=14):
    kinds = ("conversation", "ingested", "journal", "profile", "reflection")
    c = []
    for place in range(candidates):
        kind = rng.choice(kinds)
        reflection = kind == "reflection"
        pick = lambda prefix: rng.choice([P.INDEX[n] for n in P.NAMES if n.startswith(prefix)])
        maybe = lambda prefix: pick(prefix) if rng.random() < 0.6 else -1
        arms = [maybe("ret.intent.task"), maybe("ret.intent.reflective_user"), pick("tier."), maybe("auth."), maybe("prior.policy"), maybe("prior.project"),
                maybe("prior.kind"), maybe("prior.len"), pick("prior.recency"), P.INDEX["prior.reflection_discount"] if reflection else -1]
        c.append(dict(
            _order=1, place=place, vec_id=place, reflection=reflection, profile=kind == "profile", cosine=rng.uniform(0.1, 0.9), whole=rng.random() < 0.2, hits=rng.randint(0, 8),
            names=rng.randint(0, 3), weight=rng.choice([0.7, 1.0, 1.2]), arms=arms, closed=(shut := rng.random() < 0.1) or rng.random() < 0.1, shut=shut, eligible=rng.random() < 0.9, filtered=rng.random() < 0.2, exact=0.0, earlier=rng.choice([0.1, -0.2]),
            kind=kind, tier=rng.choice(("hot", "warm", "cold")), doc=rng.choice("ab"), title=rng.choice("xyz"), tokens=rng.sample("abcdefgh", rng.randint(0, 5)),
        ))
    return dict(query_id=rng.randint(0, 9), diversity=diversity, memory_weight=0.9, memory_limit=rng.choice([3, 6]), reflection_limit=2, candidates=c)


class Row:
    def __init__(self, **k):
        self.__dict__.update(k)


def plain(query, x):
    """Stage scores and what is shown, one candidate at a time."""
    p = dict(zip(P.NAMES, x, strict=True))
    rows = []
    for c in query["candidates"]:
        named = {a: P.NAMES[k] if k >= 0 else None for a, k in zip(P.ARMS, c["arms"], strict=True)}
        found = c["cosine"] + (c["whole"] * p["ret.lexical.substring"] + min(c["hits"] * p["ret.lexical.term_hit"], p["ret.lexical.term_cap"]))
        found += (min(c["names"] * p["ret.lexical.entity_hit"], p["ret.lexical.entity_cap"]) if c["names"] else 0) + p.get(named["intent"], 0) + p.get(named["prefix"], 0)
        prior = math.prod(p[named[a]] for a in P.ARMS[4:] if named[a])
        score = found * c["weight"] * p[named["tier"]] * (p[named["author"]] if named["author"] else 1) * min(max(prior, R.PRIOR_MIN), R.PRIOR_MAX)
        rows.append(Row(**c, found=found, score=round(score, 9), final=score))
    gated = [r for r in rows if not r.closed and (r.profile or (r.eligible and r.found >= 0.25))]
    memory = [r for r in gated if not r.reflection]
    memory = [r for r in memory if not r.filtered] or memory
    memory.sort(key=lambda r: -r.score)
    others, most = [r for r in memory if not r.profile], query["memory_limit"]
    if query["diversity"]:
        chosen = R.pick_in_turns(others, most, p["div.same_type"], p["div.same_doc"], p["div.same_title"]) if p["div.similarity_share"] == 1 else None
    else:
        chosen = others[:most]
    echoes = sorted((r for r in gated if r.reflection and not r.filtered), key=lambda r: -r.score)
    shown = [r.vec_id for r in memory if r.profile] + [r.vec_id for r in chosen[:4]] + [r.vec_id for r in echoes[:1]]
    return rows, sorted(shown)


def some_vectors(rng, n, share=True):
    low, high = (np.array([r[k] for r in P.parameter_ranges()]) for k in (2, 3))
    x = low + rng.random((n, len(low))) * (high - low)
    if share:
        x[:, P.INDEX["div.similarity_share"]] = 1
    return x


@pytest.mark.parametrize("diversity", [False, True])
def test_matrices_equal_one_candidate_at_a_time(diversity):
    rng = random.Random(4)
    for k in range(40):
        row = a_query(rng, diversity, rng.randint(1, 19))
        query = P.Query(row)
        x = np.vstack([P.DEFAULT, some_vectors(np.random.default_rng(k), 20)])
        stages = query.compose(x)
        shown = query.rendered(x, stages)
        for r, values in enumerate(x):
            rows, ids = plain(row, values)
            assert np.allclose(stages["final"][r], [c.final for c in rows], rtol=0, atol=1e-12)
            assert sorted(np.array(query.ids)[shown[r]].tolist()) == ids


def test_flips_equal_ranking_again():
    rng = random.Random(5)
    for k in range(12):
        query = P.Query(a_query(rng))
        for at, (_, _, low, high, _) in enumerate(P.parameter_ranges()):
            cuts = P.flips(query, at, low, high)
            assert cuts[0] == low and cuts[-1] == high
            x = np.repeat(P.DEFAULT[None], 60, axis=0)
            x[:, at] = values = np.sort(np.random.default_rng(k).uniform(low, high, 60))
            shown = query.rendered(x, query.compose(x))
            middle = np.repeat(P.DEFAULT[None], 60, axis=0)
            cell = np.searchsorted(cuts, values, side="right") - 1
            middle[:, at] = (cuts[cell] + cuts[cell + 1]) / 2
            near = np.abs(values[:, None] - cuts).min(axis=1) < 1e-7
            assert (shown == query.rendered(middle, query.compose(middle)))[~near].all()


def test_replay_jobs_equal_the_matrices(spark):
    rng = random.Random(6)
    rows = [a_query(rng, k % 3 == 0) | {"query_id": k} for k in range(70)]
    kinds = P.CANDIDATE.replace(", ", ",\n")
    trace = spark.createDataFrame(rows, f"query_id long, diversity boolean, memory_weight double, memory_limit int, reflection_limit int, candidates array<struct<_order:int,place:int,{','.join(f.strip().replace(' ', ':', 1) for f in kinds.split(chr(10)))}>>".replace(",,", ","))
    listed = D.Listed(P.DEFAULT, [[], [(P.INDEX["tier.cold"], 0.95), (3, 0.1)], [(0, 0.2)]])
    queries = [P.Query(r) for r in rows]
    got = {r.row: r for r in P.endpoints(trace, listed).collect()}
    base = [q.rendered(P.DEFAULT[None], q.compose(P.DEFAULT[None]))[0] for q in queries]
    for k, x in enumerate(listed.table):
        stages = [q.compose(x[None]) for q in queries]
        shown = [q.rendered(x[None], s)[0] for q, s in zip(queries, stages, strict=True)]
        assert math.isclose(got[k].score, np.mean([s["final"].mean() for s in stages]), rel_tol=1e-12)
        assert math.isclose(got[k].delivery, np.mean([(a ^ b).sum() / max((a | b).sum(), 1) for a, b in zip(shown, base, strict=True)]), abs_tol=1e-12)
    wide = D.Saltelli(20, *(np.array([r[k] for r in P.parameter_ranges()]) for k in (2, 3)), default=P.DEFAULT, varied=[0, 12, 35])
    assert P.endpoints(trace, wide, block=7, span=50).count() == wide.rows
    again = P.replayed(trace, listed).where("row = 1").collect()
    assert len(again) == 70 and sum(r.changed for r in again) == sum((q.rendered(listed.table[1:2], q.compose(listed.table[1:2]))[0] ^ b).sum() for q, b in zip(queries, base, strict=True))
    # a sweep by intervals says what replay at the values says
    plain_ = trace.where("NOT diversity")
    swept = {(r.name, round(r.value, 9)): r.changed for r in P.swept(P.sweeps(plain_), 3).collect()}
    points = [(n, low + (high - low) * k / 4) for n, _, low, high, _ in P.parameter_ranges() for k in (1, 2, 3)]
    for r in P.one_at_a_time(plain_, points).collect():
        assert swept[r.name, round(r.value, 9)] == r.changed
    flat = {r.name for r in P.no_solo_effect(trace).where("flat").collect()}
    ends = P.one_at_a_time(trace, [(n, e) for n, _, low, high, _ in P.parameter_ranges() for e in (low, high)]).groupBy("name").agg(F.max("changed").alias("c"), F.max("moved").alias("m")).collect()
    assert flat == {r.name for r in ends if r.c == 0 and (r.m > 0 or r.name.startswith("div."))}
    assert {r.name for r in P.coverage(trace).where("moved = 0").collect()} <= {r.name for r in ends if r.m == 0 or r.name.startswith("div.")} | {"tier.hot", "tier.profile_bypass"}


def test_treatments():
    """Each switch moves what it should: by hand, on one query."""
    base = dict(_order=1, reflection=False, profile=False, whole=False, hits=0, names=0, weight=1.0, closed=False, shut=False, eligible=True, filtered=False, exact=0.0, earlier=0.0,
                kind="journal", tier="hot", doc="", title="", tokens=[])
    none = [-1] * len(P.ARMS)
    arms = lambda **k: [P.INDEX[k[a]] if a in k else -1 for a in P.ARMS]
    c = [
        base | dict(place=0, vec_id=0, cosine=0.50, arms=arms(tier="tier.hot")),
        base | dict(place=1, vec_id=1, cosine=0.52, arms=arms(tier="tier.cold"), tier="cold"),
        base | dict(place=2, vec_id=2, cosine=0.45, arms=arms(tier="tier.hot", intent="ret.intent.reflective_conversation"), kind="conversation"),
        base | dict(place=3, vec_id=3, cosine=0.30, hits=9, arms=arms(tier="tier.hot"), kind="ingested"),
        base | dict(place=4, vec_id=4, cosine=0.90, arms=arms(tier="tier.hot"), closed=True),
        base | dict(place=5, vec_id=5, cosine=0.48, arms=arms(tier="tier.hot", length="prior.len.lt50"), earlier=0.3),
        base | dict(place=6, vec_id=6, cosine=0.27, profile=True, kind="profile", arms=arms(tier="tier.profile_bypass"), tier="cold"),
        base | dict(place=7, vec_id=7, cosine=0.46, reflection=True, kind="reflection", weight=2.0, arms=arms(tier="tier.hot")),
        base | dict(place=8, vec_id=8, cosine=0.60, eligible=False, arms=none),
    ]
    query = P.Query(dict(query_id=1, diversity=False, memory_weight=1.0, memory_limit=3, reflection_limit=1, candidates=c))
    got = {name: query.under(arm) for name, arm in P.TREATMENTS.items()}
    assert got["full"][1] == [6, 2, 0, 1, 7]
    assert got["type_scoring_off"][1] == [6, 0, 1, 3, 7] and got["type_scoring_off"][0][7] == 0.46
    assert got["type_policy_off"][1] == [8, 0, 1, 7]
    assert got["tier_off"][1] == [6, 2, 1, 0, 7]
    assert got["prior_off"][0][5] == 0.48 and got["full"][0][5] < 0.48
    assert got["role_off"][1] == [6, 4, 2, 0, 7]
    assert got["before"][1] == [6, 5, 2, 0, 7]
    assert got["lexical_off"][0][3] == 0.3 and got["full"][0][3] == 0.48
    assert got["naive_cosine"][1] == [4, 8, 1, 0] and got["naive_lexical"][1] == [4, 8, 1, 0]


def test_trajectories_move_one_parameter_at_a_time(spark):
    design = D.Morris(20, [0, -1, 5], [1, 1, 6], varied=[0, 1])
    x = design.vectors(0, design.rows).reshape(20, 3, 3)
    assert ((np.abs(np.diff(x, axis=1)) > 1e-12).sum(axis=2) == 1).all() and (x[:, :, 2] == 5).all()
    assert x[:, :, 0].min() >= -1e-12 and x[:, :, 0].max() <= 1 + 1e-12 and (design.vectors(4, 5) == x.reshape(60, 3)[4:9]).all()
    flat = x.reshape(60, 3)
    y = (flat[:, 0] - 0.5) * flat[:, 1]
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(3 * flat[:, 0] - 2 * flat[:, 1])], "row long, y double")
    got = {r.name: r for r in M.screening(rows, design, ["a", "b"]).collect()}
    assert math.isclose(got["a"].mu, 3) and math.isclose(got["b"].mu_star, 4) and got["b"].sigma < 1e-9 and got["a"].distinguishable and not got["a"].interaction
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "row long, y double")
    got = {r.name: r for r in M.screening(rows, design, ["a", "b"]).collect()}
    assert got["b"].interaction and not got["b"].no_effect
