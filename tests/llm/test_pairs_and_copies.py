"""Hard negatives, exact duplicates and spelling variants against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, hard_negatives, queries, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row string, key string, _part int"

# hard negatives


def brute_negatives(rows, every=50, positives=5, negatives=3):
    """rows of (vec_id, label, vector)."""
    known = [
        (i, y, [math.floor(256 * float(x)) for x in v])
        for i, y, v in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    place = lambda e: (-e[0], e[1] is None, e[1] or 0)
    out = []
    for at, (i, y, v) in enumerate(known):
        if i is None or i % every:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, z) for k, (j, z, w) in enumerate(known) if k != at]
        same, other = sorted((e for e in score if e[2] == y), key=place), sorted((e for e in score if e[2] != y), key=place)
        for p in same[:positives]:
            fit = [e for e in other if 50 * p[0] <= 100 * e[0] <= 95 * p[0]]
            out += [(i, p[1], k + 1, e[1], p[0], e[0]) for k, e in enumerate(fit[:negatives])]
    return sorted(out, key=str)


def mined(df, **bounds):
    return sorted((tuple(r) for r in hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 50 == 0, **bounds).collect()), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, row int, id string"


def test_hard_negatives(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).tolist(), int(rng.integers(3)), 0, "x") for i in range(400)]
    rows += rows[50:53] + rows[100:103]  # copies of anchors and others
    rows += [(None, rows[7][1], 1, 1, None), (450, [], 1, 1, "y"), (451, [1.0] * 20, 2, 1, "y"), (452, None, 1, 1, "y")]
    rows += [(500, [math.nan] * 12, 1, 0, ""), (501, [math.inf] * 12, 1, 0, ""), (502, [None] * 12, 1, 0, ""), (550, [1.0] * 12, None, 0, "")]
    df = spark.createDataFrame(rows, VECTORS).repartition(7)
    want = brute_negatives([(r[0], r[2], r[1]) for r in rows])
    assert len(want) > 50 and mined(df) == want
    # several parts of anchors, and more tasks
    assert mined(df, part_bytes=512, task_blocks=1) == want


def test_hard_negatives_of_wide_numbers_and_ties(spark):
    rng = random.Random(3)
    wide = [(i, [rng.choice([-3e5, 2.5e5, 1e5]) for _ in range(8)], i % 2, 0, "") for i in range(60)]
    assert mined(spark.createDataFrame(wide, VECTORS)) == brute_negatives([(r[0], r[2], r[1]) for r in wide])
    tied = [(i, [0.5, 0.5] if i % 3 else [0.4, 0.4], i % 3 % 2, 0, "") for i in range(200)]
    assert mined(spark.createDataFrame(tied, VECTORS)) == brute_negatives([(r[0], r[2], r[1]) for r in tied])


def test_no_anchors(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1, 0, "")], VECTORS)) == []


def test_scores_from_bit_planes():
    rng = np.random.default_rng(1)
    for top in (1, 300, 2**40):
        a, c = rng.integers(-top, top, (5, 16)), rng.integers(-top, top, (33, 16))
        got = hard_negatives.scores_of(hard_negatives.subset_tables(a, np.int64), hard_negatives.bit_planes(c))
        assert (got == c @ a.T).all()  # modulo 2**64, both
    assert hard_negatives.as_integers(np.array([1e300, -1e300, -0.001])).tolist() == [2**63 - 1, -(2**63), -1]


# exact duplicates


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    out = []
    for text, members in groups.items():
        order = sorted(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[0], order[0][0], len(members), k == 0, sha) for k, m in enumerate(order)]
    return sorted(out, key=str)


def edge_texts():
    rows = [(1, "a b", None, "k", 1), (2, "ab ", "r", None, 2), (3, "a\tb\n", "r", "", None), (None, "ab  ", "r", "", None), (4, None, None, None, None)]
    rows += [(5, "", "x", "y", 0), (6, " \r\x0b\x0c", "x", "y", 0), (7, "é 😀", "", "", 0), (7, "é 😀", "", "", 0), (8, "\xa0", "", "", 0), (9, "A B", "", "", 0)]
    rows += [(10 + i, f"text {i}", "", "", 0) for i in range(300)] + [(1000 + i, "hot text", "", "", 0) for i in range(200)]
    return rows + [(2000, "long " * 300_000, "", "", 0), (2001, "long" * 300_000, "", "", 0)]


@pytest.mark.parametrize("max_bits", [1 << 28, 64])
def test_exact_groups(spark, max_bits):
    """Also with a filter so small that nearly all rows are possibly repeated."""
    rows = edge_texts()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted((tuple(r) for r in exact_dedup.mark_duplicates(df, max_bits).collect()), key=str)
    assert got == brute_groups([r[:2] for r in rows])
    kept = exact_dedup.remove_duplicates(df, max_bits)
    assert kept.columns == df.columns
    want = [(g[1]) for g in got if g[3]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, want))


def test_single_texts_pass_the_filter(spark):
    rows = spark.range(20_000).select((F.col("id") % 19_000).cast("string").alias("key"))
    maybe, single = exact_dedup.split_rows(rows, "key", *exact_dedup.repeated_bits(rows, "key"))
    assert maybe.count() + single.count() == 20_000
    assert single.groupBy("key").count().where("count > 1").isEmpty()
    assert 2_000 <= maybe.count() < 4_500  # 2,000 repeated rows, and some by chance


def test_no_texts(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.mark_duplicates(none).collect() == [] and exact_dedup.remove_duplicates(none).collect() == []


# spelling variants


def brute_words(docs, least=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= least}


def edits(w, letters):
    yield from (w[:k] + w[k + 1 :] for k in range(len(w)))
    yield from (w[:k] + x + w[k:] for k in range(len(w) + 1) for x in letters)
    yield from (w[:k] + x + w[k + 1 :] for k in range(len(w)) for x in letters)


def brute_variants(n, ratio=5):
    letters = {x for w in n for x in w}
    near = {w: {x for x in edits(w, letters) if x in n and x != w} for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= ratio * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def variants(df, **bounds):
    return sorted((tuple(r) for r in spelling.group_variants(df, **bounds).collect()), key=str)


def test_spelling_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = brute_words([(r.doc_id, r.text) for r in docs.collect()])
    got = variants(spelling.count_words(docs))
    assert len(got) > 100 and got == brute_variants(n)
    assert sorted(map(str, queries.op13_spelling_variants(spark, SF).collect())) == sorted(map(str, spelling.group_variants(spelling.count_words(docs)).collect()))


def test_counted_words(spark):
    rows = [(1, "Straße straße STRASSE naïveté_naïveté 日本naïveté\x00abcdef " * 9, "", "", 0), (None, "abcdef, ghijkl " * 300, None, None, None), (3, None, "", "", 0), (4, "", "", "", 0)]
    rows += [(5, "x" * 70_000 + " " + "y" * 90, "", "", 0)] * 6 + [(i, f"abcdef{'ghi' * (i % 40)} ×÷×÷×÷", "", "", 0) for i in range(2000)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == brute_words([r[:2] for r in rows])
    assert spelling.count_words(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("most_words", [4096, 3])
def test_variants(spark, most_words):
    """Repeated letters, ends, chains of forms, ties; with tiny partitions all of them are split on."""
    rng = random.Random(7)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(250)]
    n = {w: rng.choice([5, 5, 7, 30, 150, 151, 800]) for w in base}
    n |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 200, "chained": 5, "chaine": 25, "chain": 5, "k" * 400: 9, "k" * 401: 90, "k" * 199 + "m" + "k" * 200: 6}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    assert variants(df, most_words=most_words) == brute_variants(n)


def test_many_words_of_one_beginning(spark):
    """A third of all words and more share their first half."""
    n = {"prefix" + a + b + c: 5 + 50 * (a == b) for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefgh"}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert variants(df, most_words=20) == brute_variants(n)


def test_acceptor_is_minimal():
    words = [a + b + c for a in "abc" for b in "xy" for c in ("", "ing", "ed")]
    made = spelling.Acceptor(words)
    assert len(made.next) == 1 + 1 + 1 + 4  # start, after one letter, after two, i-n-g and e-d share their last letter's target


def test_no_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert variants(none) == [] and variants(spark.createDataFrame([(None, 5), ("abcdef", None)], "word string, n long")) == []
