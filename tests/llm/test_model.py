"""The language model: probabilities sum up to 1, and scores are those of a model told token by token."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import lm_scoring

SF = "/root/testdata/sf0.001"


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def caught(spark, monkeypatch, docs, **sizes):
    """The scores, and the model that gave them."""
    held = []
    train = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a, **k: held.append(train(*a, **k)) or held[-1])
    return lm_scoring.score_documents(docs, **sizes).collect(), held[0]


@pytest.mark.parametrize("sizes, kind", [({"heads": 40}, np.uint16), ({"heads": 30, "growth": 40.0}, np.uint16), ({"heads": 40_000}, np.uint32)])
def test_scores_equal_a_model_told_token_by_token(spark, monkeypatch, sizes, kind):
    """With few ids, with more as the corpus grows, and with more than 16 bits hold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    if kind == np.uint32:
        docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k * 6000, k * 6000 + 7000))) for k in range(7)], docs.schema)
    rows, model = caught(spark, monkeypatch, docs, **sizes)
    vocabulary, texts = model.vocabulary, {r.doc_id: r.text for r in docs.collect()}
    assert vocabulary.kind is kind and (vocabulary.end == 40 or len(sizes) > 1 or kind == np.uint32)

    def hashed(word):
        return int(lm_scoring.hashed_words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())])).hashes[0])

    # probabilities of all ids after some histories
    ids = np.arange(vocabulary.size)
    for before, skip in ((vocabulary.start, vocabulary.start), (3, vocabulary.start), (vocabulary.end - 1, 5)):
        p = np.exp(model.token_logs(ids, np.full(len(ids), before), np.full(len(ids), skip)))
        assert math.isclose(p.sum(), 1, rel_tol=1e-4) and (p > 0).all()

    counts, id_counts, kinds = Counter(), Counter(), Counter()
    known = {w: int(vocabulary.ids(np.array([hashed(w)], np.uint64))[0]) for t in texts.values() for w in tokens_of(t)}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens_of(t))
            id_counts.update([*(known[w] for w in tokens_of(t)), vocabulary.end])
    for w in counts:
        kinds[known[w]] += 1
    for r in rows:
        before = skip = vocabulary.start
        total = 0.0
        for w in [*tokens_of(texts[r.doc_id]), None]:
            at = vocabulary.end if w is None else known[w]
            logits = model.bias + model.by_before[before] + model.by_skip[skip] + model.by_pair[(before * 40503 + skip * 10007) % vocabulary.pairs]
            logits = logits.astype(float)
            c = model.class_of[at]
            total += logits[c] - math.log(sum(math.exp(v) for v in logits)) + model.id_logs[model.class_of[before], at]
            if at > vocabulary.end:  # the word's share of its id
                total += math.log((counts[w] + 0.5) / (id_counts[at] + 0.5 * (kinds[at] + 1)))
            before, skip = at, before
        assert math.isclose(r.score, total / math.log(10), rel_tol=2e-4, abs_tol=1e-3)
