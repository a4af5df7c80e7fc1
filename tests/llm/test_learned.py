"""Operators that learn: held-out accuracy, edges, and the pipeline."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import langid, quality, queries, toxicity
from test_exact import SCHEMA, edge_docs, empty_docs

SF = "/root/testdata/sf0.1"


def labels_of(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(name).cast("int").alias("y"))


def held_out_accuracy(rows, labels):
    return rows.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]


def test_quality_accuracy(spark):
    rows = queries.op3_quality(spark, SF)
    assert held_out_accuracy(rows, labels_of(spark, "quality")) > 0.97


def test_normal_equations_by_brute_force(spark):
    """Sums over tasks equal the products of the whole matrices, and the ridge weights solve them."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 3)), rng.integers(0, 2, 500)
    features = quality.Features(x.mean(axis=0), x.std(axis=0), 16, 4.0, 7)
    df = spark.createDataFrame([(row.tolist(), int(label)) for row, label in zip(x, y, strict=True)], "x array<double>, y int").repartition(7)
    zz, zy = quality.normal_equations(df, features, 3)
    z = np.column_stack([np.cos((x - x.mean(axis=0)) / x.std(axis=0) @ features.weight + features.phase) * np.sqrt(2 / 16), np.ones(500)])
    assert np.allclose(zz, z.T @ z) and np.allclose(zy, z.T @ y)


def test_random_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    z = quality.Features(np.zeros(5), np.ones(5), 20_000, 2.0, 3)(x)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-far / (2 * 2.0**2))).max() < 0.05


def test_isotonic_by_brute_force():
    """Pools are the means that no merge of neighbours improves: the greatest of least upper means."""
    rng = np.random.default_rng(5)
    sums, weight = rng.integers(0, 5, 30).astype(float), np.full(30, 4.0)
    _, fitted = quality.isotonic(np.arange(30.0), sums, weight)
    prior = sums.sum() / weight.sum()
    mean = lambda a, b: sums[a:b].sum() / weight[a:b].sum()
    want = np.array([max(min(mean(a, b) for b in range(i + 1, 31)) for a in range(i + 1)) for i in range(30)])
    groups = {v: np.flatnonzero(np.isclose(want, v)) for v in want}
    for v, own in groups.items():
        w = weight[own].sum()
        assert np.allclose(fitted[own], (v * w + prior) / (w + 1), atol=0.02)


def test_language_vectors_by_brute_force(spark):
    """Bundles of bound, permuted letter vectors, one by one; prototypes summed over tasks."""
    binder = langid.Binder(64, 11)
    text = "Ab, cé!! d"
    p = [binder.place[ord(c)] if c.isalpha() else 0 for c in f" {text.lower()} "]
    p = [v for k, v in enumerate(p) if v or k == 0 or p[k - 1]]
    letters = binder.third
    want = sum(np.roll(letters[a], 2).astype(int) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(p, p[1:], p[2:], strict=False) if b)
    assert (binder.vector(*binder.trigrams(text)) == want).all()
    rows = spark.createDataFrame([("ab cd", "x"), ("ef", "x"), ("gh ij", "y")] * 5, "text string, lang string").repartition(6)
    names, prototypes = langid.language_prototypes(rows, 64, 11)
    own = sum(langid.Binder(64, 11).vector(*langid.Binder(64, 11).trigrams(t)) for t in ("ab cd", "ef"))
    assert names == ["x", "y"] and np.allclose(prototypes[0], own / np.linalg.norm(own), atol=1e-6)


def test_toxicity_accuracy(spark):
    """As good as the bare rule that some chosen word occurs, which is learned from the same rows."""
    rows = queries.op10_toxicity(spark, SF).cache()
    labels = labels_of(spark, "toxic")
    assert held_out_accuracy(rows, labels) > 0.92
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    learn = docs.join(labels, "doc_id").where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) != 0)
    words = learn.select("doc_id", "y", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w"))
    odds = words.groupBy("w").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")).where("n1 >= 5 AND n1 > 3 * n0").select("w")
    hit = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w")).join(odds, "w", "left_semi").select("doc_id").distinct()
    control = rows.join(hit.withColumn("c", F.lit(1)), "doc_id", "left").where("held_out").join(labels, "doc_id")
    bare = control.agg(F.avg((F.coalesce("c", F.lit(0)) == F.col("y")).cast("double"))).first()[0]
    assert held_out_accuracy(rows, labels) > bare - 0.02


def test_language_accuracy(spark):
    rows = langid.identify_languages(spark.read.parquet(f"{SF}/documents.parquet"))
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    assert rows.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.98


def test_language_edges(spark):
    rows = langid.identify_languages(edge_docs(spark)).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    texts = edge_docs(spark).where("text IS NULL OR text = ''").count()
    assert sum(r.lang_pred == "und" for r in rows) == texts
    assert langid.identify_languages(empty_docs(spark)).count() == 0
    unlabelled = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify_languages(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifier_edges(spark, score):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (None, 1), (77, 0), (4, None)], "doc_id long, y int")
    rows = score(edge_docs(spark), labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    # without labels: no opinion of quality, no claim of toxicity; predicted follows the score by the contract's threshold
    least = 0.5 if score is toxicity.score_toxicity else 0.3
    unlabelled = score(edge_docs(spark), labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == ({0.0} if score is toxicity.score_toxicity else {0.5})
    assert all(r.predicted == (r.score >= least) for r in rows + unlabelled)
    assert score(empty_docs(spark), labels).count() == 0


def test_toxic_removal_keeps_columns(spark):
    labels = labels_of(spark, "toxic", "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = toxicity.remove_toxic(docs, labels)
    gone = toxicity.score_toxicity(docs, labels).where("predicted = 1").select("doc_id")
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - gone.count() and kept.join(gone, "doc_id").count() == 0
    assert toxicity.remove_toxic(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_toxic_words_that_ordinary_text_holds_too(spark):
    """Innocent uses and wrong labels don't make a telling word count for nothing."""
    def text(k, word):
        return " ".join([f"plain{k * j % 97}" for j in range(1, 30)] + [word] * (word != ""))

    words = ["trash", "clown", "stupid"]
    rows = [(k, text(k, words[k % 3]), 1) for k in range(300)]
    rows += [(k, text(k, words[k % 3] if k % 50 == 0 else ""), 0) for k in range(300, 1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(4)
    out = toxicity.score_toxicity(df, df.select("doc_id", "y")).join(df.select("doc_id", "y"), "doc_id").where("held_out")
    r = out.agg(F.avg(F.when(F.col("y") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("y") == 0, F.col("predicted"))).alias("wrong")).first()
    assert r.recall > 0.9 and r.wrong < 0.1


def test_removal_keeps_all_where_nothing_was_learned(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, y int")
    for known in (labels, labels.limit(0)):
        assert toxicity.remove_toxic(docs, known).count() == 13
        assert {r.predicted for r in toxicity.score_toxicity(docs, known).collect()} == {0}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    run = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in run.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_entry_without_the_folders(tmp_path):
    """The rest imports and lists its queries when this subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['palimpsest.llm'] = None\n"
        "import __spark_entry__ as e\nassert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def pipeline_folder(tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.sparkSession.createDataFrame([(1, " ".join(f"bench{k}" for k in range(12))), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_with_edge_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, very long texts and clashing columns: copies, benchmark passages and personal data go, all else stays."""
    leak = spark.createDataFrame([(50, "so " + " ".join(f"bench{k}" for k in range(12)) + " it is", "en", "a", 1, 1, "x"), (51, "write to someone@example.org now please, or do not", "en", "a", 1, 1, "x")], edge_docs(spark).schema)
    docs = edge_docs(spark).unionByName(leak)
    labels = spark.createDataFrame([(1, 0, 0), (2, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    sf = pipeline_folder(tmp_path / "edge", docs, labels)
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, sf), name)
        assert kept.columns == docs.columns, name
    rows = kept.collect()
    ids = sorted((r.doc_id for r in rows), key=str)
    assert 50 not in ids and {5, 6, 51, None} <= set(ids)
    assert ids.count(3) + ids.count(4) == 1  # one of the texts that are equal in words
    assert ids.count(1) + ids.count(2) == 1 and ids.count(7) + ids.count(8) == 1
    assert "someone@example.org" not in next(r.text for r in rows if r.doc_id == 51)
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, pipeline_folder(tmp_path / "none", empty_docs(spark), labels)).count() == 0
