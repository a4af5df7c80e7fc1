"""Operators with one right answer, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import decontamination, fingerprints, jaccard_join, lm_scoring, packing, pii, queries, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, items string"
LONG = " ".join(f"word{i % 977} more" for i in range(30_000))


def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    near = [f"w{i}" for i in range(60)]
    rows = [
        (1, " ".join(near), "en", "a", 5, 9, "x"),
        (2, " ".join(near[:58] + ["x", "y"]), "en", "a", None, None, None),
        (3, "one two", "en", None, 1, 1, "y"),
        (3, "one two", "en", None, 1, 1, "y"),
        (4, "ONE  two", None, "b", 1, 1, "y"),
        (5, "", "en", "b", 0, 0, ""),
        (6, None, None, None, None, None, None),
        (None, "null id text of some words here", "en", "c", 1, 1, "z"),
        (None, None, None, None, None, None, None),
        (7, LONG, "en", "c", len(LONG), 0, "q"),
        (8, LONG + " end", "en", "c", len(LONG), 0, "q"),
        (9, "é ü 日本 😀 a", "fr", "a", 8, 0, "q"),
        (5, "same id other text", "de", "b", 1, 0, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern):
    return re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))


# sharding


def test_sharding_laws(spark):
    rows = sharding.shard_proportionally(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source"), slice_rows=16).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    by_source = Counter(r.source for r in rows)
    for (source, _), n in Counter((r.source, r.shard) for r in rows).items():
        assert abs(n - by_source[source] / 8) <= 2


def test_sharding_ranks(spark):
    """Shards and slots of the whole table from the definition: fractional ranks of seeded hashes within sources, cut evenly."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    hashed = docs.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id", crc).alias("h"), crc.alias("crc")).collect()
    # a slice of the hash comes before the hash itself, which is signed
    by_source = {}
    for r in hashed:
        by_source.setdefault(r.source, []).append(((r.h % 2**64 >> 1) % 2**62, r.h, r.doc_id, r.crc))
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_proportionally(docs, slice_rows=1 << 20).collect()}
    placed = []
    for source, rows in by_source.items():
        for rank, (_, h, doc_id, c) in enumerate(sorted(rows, key=lambda x: x[1:])):
            placed.append(((2 * rank + 1) / (2 * len(rows)), h, doc_id, c, "=" + source))
    placed.sort()
    n = len(placed)
    want, first = {}, {}
    for at, row in enumerate(placed):
        shard = at * 8 // n
        want[row[2]] = (shard, at - first.setdefault(shard, at))
    assert got == want


def test_sharding_edges(spark):
    rows = sharding.shard_proportionally(edge_docs(spark)).collect()
    texts = Counter((r.doc_id, r.text) for r in edge_docs(spark).collect())
    assert len(rows) == sum(texts.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for (d, t), n in texts.items() for _ in range(n)
    )
    assert sharding.shard_proportionally(empty_docs(spark)).count() == 0


# fingerprints


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = fingerprints.fingerprint_documents(docs, target_rows=8).orderBy(F.desc("doc_id")).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.orderBy(F.desc("doc_id")).collect()]
    assert [r.doc_id for r in got] == [d for d, _ in texts]
    prints = {}
    for k, (r, (_, text)) in enumerate(zip(got, texts, strict=True)):
        following = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in got if r.n_chars > 1500]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.3


def brute_digest(text, ranks):
    """Features of one text by the definition: in every neighbourhood of window places the least (rank, place) wins; enough wins make a feature."""
    from palimpsest.llm.words import segment_hashes

    data = text.encode()
    n, size, span, never = len(data), fingerprints.WINDOW, fingerprints.NEIGHBOURS, int(fingerprints.NEVER)

    def rank(at):
        if not 0 <= at <= n - size:
            return never
        window = data[at : at + size]
        return int(ranks[sum(window[i] == window[j] for i in range(size) for j in range(i))])

    worth = {at: rank(at) for at in range(-span, n + span)}
    wins = Counter()
    for begin in range(-span, n + 1):
        best = min((worth.get(at, never), at) for at in range(begin, begin + span))
        if best[0] < never:
            wins[best[1]] += 1
    places = [at for at in range(n) if wins[at] >= fingerprints.WINS]
    spans = [(at, at + size) for at in places] or ([(0, n)] if n else [])
    array = np.frombuffer(data, np.uint8)
    hashes = segment_hashes(array, np.array([a for a, _ in spans]), np.array([b for _, b in spans])) if spans else []
    filters = []
    for k, h in enumerate(hashes):
        if k % fingerprints.FILTER_FEATURES == 0:
            filters.append(set())
        filters[-1] |= {int(h) >> 11 * j & fingerprints.FILTER_BITS - 1 for j in range(fingerprints.HASHES)}
    return filters


def brute_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    bits = fingerprints.FILTER_BITS

    def overlap(x, y):
        chance = len(x) * len(y) / bits
        return min(1.0, max(0.0, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9)))

    return sum(max(overlap(x, y) for y in b) for x in a) / len(a)


def test_fingerprints_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "COMPARED_WORDS", 40)
    monkeypatch.setattr(fingerprints, "FILTER_FEATURES", 3)
    rnd = random.Random(8)
    docs = [(k, "".join(rnd.choice("abcdefgh é") for _ in range(n))) for k, n in enumerate((0, 10, 31, 32, 200, 500, 700))]
    docs.append((7, docs[6][1][:400] + "tail"))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    ranks = fingerprints.rarity_ranks(fingerprints.pair_counts(df))
    down = docs[::-1]
    texts = [t for _, t in down]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, texts[1:] + texts[:1], strict=True)]
    digests = fingerprints.Digests([t.encode() for t in texts] + [t.encode() for t in edited], ranks)
    brute = [brute_digest(t, ranks) for t in texts + edited]
    for i, filters in enumerate(brute):
        mine = np.unpackbits(digests.packed[digests.first[i] : digests.first[i + 1]], axis=1)
        assert [set(np.flatnonzero(m).tolist()) for m in mine] == filters, i
    n = len(texts)
    for i in range(n):
        for j in (n + i, (i + 1) % n):
            assert abs(digests.likeness(i, j) - brute_likeness(brute[i], brute[j])) < 1e-12


def test_repeated_and_null_ids_are_ordered_by_their_texts(spark):
    docs = [(5, f"text {k} " * 9) for k in range(300)] + [(None, f"none {k} " * 5) for k in range(200)] + [(9, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), -hashed[d[1]]))
    want = Counter()
    for (d, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        want[(d, hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest())] += 1
    got = fingerprints.fingerprint_documents(df, target_rows=16).select("doc_id", "edited_sha256").collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_long_texts_in_pieces_have_the_features_of_the_whole(monkeypatch):
    rng = random.Random(8)
    ranks = fingerprints.rarity_ranks(np.random.default_rng(2).integers(0, 1000, fingerprints.PAIRS + 1))
    texts = [bytes(rng.choice(b"abcdefgh the") for _ in range(n)) for n in (0, 5, 31, 32, 33, 200, 5000, 12_345)] + [b"a" * 300, b"a" * 9000]
    whole = fingerprints.Digests(texts, ranks)
    for piece in (100, 1000, 4096):
        monkeypatch.setattr(fingerprints, "PIECE", piece)
        cut = fingerprints.Digests(texts, ranks)
        assert (cut.features == whole.features).all()
        assert [cut.text(i) for i in range(8)] == [whole.text(i) for i in range(8)] and cut.text(9) != cut.text(8)


def test_long_chains_are_compared_in_parts():
    rnd = np.random.default_rng(1)
    text = bytes(rnd.integers(97, 123, 3_000_000, dtype=np.uint8))
    ranks = fingerprints.rarity_ranks(np.bincount(fingerprints.equal_pairs(np.frombuffer(text, np.uint8)), minlength=fingerprints.PAIRS + 1))
    digests = fingerprints.Digests([text, text[: len(text) // 2], text[::-1]], ranks)
    assert digests.likeness(0, 1) > 0.95 and digests.likeness(0, 2) < 0.5


def test_fingerprint_edges(spark):
    got = fingerprints.fingerprint_documents(edge_docs(spark)).collect()
    assert len(got) == 13
    assert fingerprints.fingerprint_documents(empty_docs(spark)).count() == 0
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1


# decontamination


def brute_hits(docs, bench, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = {}
    for item, text in bench:
        w = words(text, pattern)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words(text, pattern)
        hit, items = set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                found = wins.get(tuple(w[i : i + k]))
                if found:
                    hit |= set(range(i, i + k))
                    items |= found
        out.append((doc, len(w), len(hit), ",".join(sorted(items))))
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 24, 40])
def test_contamination(spark, broadcast_bytes):
    rnd = random.Random(5)
    vocabulary = ["a", "B", "c", "é", "9"]
    docs = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for k in range(60)] + [(99, None), (None, "a b c"), (7, "a-b,c"), (7, "a-b,c")]
    bench = [(k, " ".join(rnd.choice(vocabulary) for _ in range(n))) for k, n in enumerate((3, 12, 11, 0, 4, 10))] + [(50, None), (2, "c a b")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = [(r.doc_id, r.n_words, len(r.hit_words), ",".join(r["items"])) for r in decontamination.find_contamination(d, b, broadcast_bytes=broadcast_bytes).collect()]
    want = brute_hits(docs, bench)
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontamination.remove_contaminated(d.withColumn("items", F.lit(1)), b, broadcast_bytes=broadcast_bytes)
    assert kept.columns == ["doc_id", "text", "items"]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(row for row, w in zip(docs, want, strict=True) if not w[2])


def test_longest_match(spark):
    item = " ".join(f"t{i}" for i in range(30))
    d = spark.createDataFrame([(1, "x y " + " ".join(item.split()[5:25]) + " z")], "doc_id long, text string")
    match = decontamination.find_contamination(d, spark.createDataFrame([(4, item)], "item_id long, text string")).first().matches
    assert [(m.item_id, m.item_word, m.doc_word, m.length) for m in match] == [("4", 5, 2, 20)]


def test_contamination_edges(spark):
    b = spark.createDataFrame([(1, "null id text of some words here")], "item_id long, text string")
    assert decontamination.find_contamination(edge_docs(spark), b).where(F.size("hit_words") > 0).count() == 1
    assert decontamination.find_contamination(edge_docs(spark), b.limit(0)).where(F.size("hit_words") > 0).count() == 0
    assert decontamination.find_contamination(empty_docs(spark), b).count() == 0


# Jaccard join


def brute_components(docs):
    def shingles(text):
        w = words(text, r"[^\x20\x09-\x0D]+")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if sets[i]:
            ids.setdefault(root(i), []).append(d)
    return sorted(((d, len(sets[i]), min((x for x in ids[root(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def components(df):
    own = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component.doc_id"))
    found = jaccard_join.document_components(df)
    return sorted(((r.doc_id, r.n_shingles, r.c) for r in found.select("doc_id", "n_shingles", own.alias("c")).collect()), key=str)


def test_components(spark):
    rnd = random.Random(2)
    docs = []
    for family in range(12):
        base = [f"f{family}w{rnd.randint(0, 400)}" for _ in range(rnd.choice((6, 8, 9, 12, 30, 200)))]
        for _ in range(rnd.choice((1, 3, 8, 25))):
            copy = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 4))):
                k = rnd.randrange(len(copy))
                copy[k : k + 1] = rnd.choice(([], ["new%d" % rnd.randint(0, 30)], [copy[k], "in"]))
            docs.append((len(docs), " ".join(copy)))
    common = " ".join(f"c{i}" for i in range(40))
    docs += [(1000 + k, common + " " + " ".join(f"own{k}x{i}" for i in range(9))) for k in range(40)]
    assert components(spark.createDataFrame(docs, "doc_id long, text string")) == brute_components(docs)


def test_light_sets_are_joined_by_subsets(spark, monkeypatch):
    rnd = random.Random(4)
    docs = [(k, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12)))) for k in range(150)]
    want = brute_components(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for light in (0, 4, 8):
        monkeypatch.setattr(jaccard_join, "light_boundary", lambda *_, x=light: x)
        assert components(df) == want


def test_component_edges(spark):
    docs = [(r.doc_id, r.text) for r in edge_docs(spark).collect()]
    assert components(edge_docs(spark)) == brute_components(docs)
    assert components(empty_docs(spark)) == []
    kept = jaccard_join.keep_one(edge_docs(spark))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 5, 5, 6, None, None, 7, 9])
    assert jaccard_join.keep_one(empty_docs(spark)).count() == 0


def test_names_that_the_join_uses_may_be_columns(spark):
    names = ["set", "kept_set", "_kept_set", "_kept_id", "kept_id", "n", "component"]
    df = spark.createDataFrame([(1, "a b c d e f", *range(7)), (2, "a b c d e f", *range(7)), (3, None, *range(7))], ["doc_id", "text", *names])
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_hot_texts_and_families(spark):
    """A text that a third of all rows hold, a family of near copies, and many parcels and buckets."""
    family = [[f"w{i}" for i in range(120)] for _ in range(60)]
    for k, words_ in enumerate(family):
        words_[(k * 7) % 120] = f"own{k}"
    docs = [(k, "hot text of a third of all rows") for k in range(60)] + [(100 + k, " ".join(w)) for k, w in enumerate(family)]
    docs += [(300 + k, " ".join(f"s{k}x{i}" for i in range(20))) for k in range(60)] + [(400 + k, " " * k) for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert components(df) == brute_components(docs)


def test_parcels_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_SHINGLES", 40)
    monkeypatch.setattr(jaccard_join, "PARCEL_SETS", 7)
    test_components(spark)


def test_ascending_hashes_travel_whole():
    rnd = np.random.default_rng(3)
    for n, most in ((0, 9), (1, 2**63), (5, 2**63), (1000, 2**63), (1000, 2**40)):
        hashes = np.unique(rnd.integers(0, most, n, dtype=np.uint64) & ~np.uint64(0xFFFF))
        assert (jaccard_join.unpack_ascending(jaccard_join.pack_ascending(hashes), len(hashes)) == hashes).all() or not n


# sums


def test_sums_are_exact_beyond_float32(spark):
    from palimpsest.llm.common import add_up

    big = 2**24 + 1
    rows = [(t % 3, t, np.array([float(big), t], np.float64).tobytes()) for t in range(700)]
    df = spark.createDataFrame(rows, "piece int, task long, sums binary")
    got = {r.piece: np.frombuffer(r.sums).tolist() for r in add_up(df, ["piece"], fan=16).collect()}
    assert got == {p: [float(big * len(range(p, 700, 3))), float(sum(range(p, 700, 3)))] for p in range(3)}


# language model


def check_base(rows, docs, folds=5):
    tokens = lambda t: [*words(t, r"[^\x20\x09-\x0D]+"), "\n"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % folds == 1
    c = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(d), held(d), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 5)) for d, t in docs
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want


def test_lm_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = lm_scoring.score_documents(docs).collect()
    check_base(rows, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_edges(spark):
    rows = lm_scoring.score_documents(edge_docs(spark)).collect()
    check_base(rows, [(r.doc_id, r.text) for r in edge_docs(spark).collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm_scoring.score_documents(empty_docs(spark)).count() == 0


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda digits=digits: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda digits=digits: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), list(BASE).index(kind), m.end()))
    return [f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_personal_data(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab1 23.4@+-5()é\n😀_%0678 ") for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    texts += ["4111 1111 1111 1111 4111-1111-1111-1111", "x@y.z_w@v.u", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "a" * 20_000, "1" * 20_000, None, ""]
    texts += [f"tel: +1 {k} 555 {k + 1000}" for k in range(200, 230)] + ["tel: 321-555-1355 now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(df)).collect()}
    for k, text in enumerate(texts):
        base = base_spans(text)
        assert got[k].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(b.startswith(kind) for b in base) for kind in BASE]
        assert set(base) <= set(got[k].spans.split(",")) | {""}
    assert got[len(texts) - 1].spans == "phone:5:17"  # discovered by its context


def test_grouped_numbers_are_discovered(spark):
    """Numbers in groups, and after words with digits, have the text before them as context."""
    seeds = [f"{key} +1 ({k}) 555-7{k}" for k in range(200, 240) for key in ("phone:", "tel2")]
    seeds += [f"card: 4111 1111 1111 {k}" for k in range(1000, 1400) if luhn(f"411111111111{k}")]
    cases = {
        "phone: (415) 555-2671": ["phone:7:21"],
        "phone: 415 555 2671, now": ["phone:7:20"],
        "phone: 415 - 555.2671 extra 12": ["phone:7:21"],
        "x1 phone:\t(415)555 2671": ["phone:10:23"],
        "Tel2 5551234567": ["phone:5:15"],
        "card: 4111 1111 1111 1112 12": ["card:6:28"],
        "phone: 5551234567 2025": ["phone:7:17"],
        "phone: 415 555\n2671": ["phone:7:14"],
        "phone: 415 555 +1 (487) 555-7209": ["phone:7:14", "phone:15:32"],
        "phone: 12 34": [""],
    }
    df = spark.createDataFrame(list(enumerate([*cases, *seeds])), "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.digest(pii.find_personal_data(df)).collect()}
    assert {text: got[k] for k, text in enumerate(cases)} == cases


def test_unseen_identifiers_are_found_by_their_contexts(spark):
    """Of identifiers that no base pattern fits, in contexts that seeds share, nearly all are discovered, and hardly a token beside."""
    rnd = random.Random(6)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    contexts = ["phone:", "call me at", "tel.", "my number is"]
    seeds = [f"word {rnd.choice(contexts)} +1 ({digits(3)}) {digits(3)}-{digits(4)} more {digits(2)} words" for _ in range(400)]
    hidden = [(c, f"{digits(3)} {digits(3)} {digits(4)}") for c in contexts for _ in range(25)]
    clean = [f"in {1900 + k % 100} the order {digits(7)} came on page {k}" for k in range(300)]
    texts = seeds + [f"so {c} {h} then" for c, h in hidden] + clean
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    found = 0
    for k, (c, h) in enumerate(hidden, len(seeds)):
        at = texts[k].index(h)
        found += got[k] == f"phone:{at}:{at + len(h)}"
    assert found / len(hidden) > 0.9
    assert sum(got[k] != "" for k in range(len(texts) - len(clean), len(texts))) == 0


def test_many_identifiers_in_one_text(spark):
    """100,000 tokens with digits, and mails, in one text: linear work, right offsets, whole redaction."""
    text = " ".join(f"a{k}@b.cd" if k % 10 == 0 else f"n{k}" for k in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.digest(pii.find_personal_data(df)).first()
    assert row.n_email == 10_000
    begin, end = map(int, row.spans.split(",")[-1].split(":")[1:])
    assert text[begin:end] == "a99990@b.cd"
    assert pii.redact_documents(df).first().text == re.sub(r"a\d+@b\.cd", "<email>", text)


def test_redaction(spark):
    df = edge_docs(spark).union(spark.createDataFrame([(20, "mail a.b@c.de or 1.2.3.4!", "en", "s", 1, 1, "i")], SCHEMA))
    out = pii.redact_documents(df)
    assert out.columns == df.columns and out.count() == 14
    row = out.where("doc_id = 20").first()
    assert row.text == "mail <email> or <ip>!" and row.n_chars == len(row.text) and row.shard == 1
    assert out.where("doc_id = 6").first().text is None
    assert pii.redact_documents(empty_docs(spark)).count() == 0


# packing


def test_long_stretches_are_encoded(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    long = ["x" + " " * 1_000_000 + "y", "\n" * 300_000 + " b c" * 60_000, "a" * 400_000, "é_1 <|endoftext|> z " * 20_000, "lorem ipsum " * 100_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(5)
    ids = {}
    for r in queries.packed(df).collect():
        ids.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for k, text in enumerate(long):
        want = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(part for _, part in sorted(ids[k])) == want, k



def check_packing(rows, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    want = Counter()
    for d, t in docs:
        want[(d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)] += 1
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[(d, len(ids))])
        assert sum(n for _, n, _ in own) == len(ids) * want[(d, len(ids))]
        if want[(d, len(ids))] == 1:
            at = 0
            for start, n, crc in own:
                assert start == at and crc == zlib.crc32(ids[start : start + n].tobytes())
                at += n
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    return filled


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = queries.packed(docs.repartition(3)).collect()
    filled = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    tokens = sum(n for parts in filled.values() for _, n in parts)
    assert tokens / (2048 * len(filled)) > 0.97


def test_packing_edges(spark):
    df = edge_docs(spark).union(spark.createDataFrame([(30, "a <|endoftext|> b  c\n\n d ", "en", "s", 1, 1, "i")], SCHEMA))
    check_packing(queries.packed(df).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert queries.packed(empty_docs(spark)).count() == 0


def test_windows_place_by_squared_counts():
    rnd = random.Random(1)
    windows = packing.Windows(16, 0)
    for _ in range(300):
        s = rnd.randint(1, 15)
        n = windows.count.copy()
        cost = {}
        for level in range(0, 17 - s):
            if level == 0 or n[level]:
                after = n.copy()
                if level:
                    after[level] -= 1
                if level + s < 16:
                    after[level + s] += 1
                cost[level] = int((after**2).sum())
        windows.place((0, 0, s, bytes(4 * s), s))
        assert int((windows.count**2).sum()) == min(cost.values())
