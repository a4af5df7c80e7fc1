"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is bound by the product of
its letters' vectors, each permuted (rotated) by its place; a text is the bundle
(sum) of its trigrams' vectors.  A language's prototype bundles all its training
text, and a text gets the language whose prototype has the greatest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_up, fold_of, record_batch, text_blocks

#: Letters: code points below the limit have a place of their own, others share by hash.
OWN_LETTERS, LETTERS = 0x500, 2048


class Binder:
    """Letter vectors and the vectors of texts."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.size = size
        letters = rng.choice(np.array([-1, 1], np.int8), (LETTERS, size))
        self.first, self.second, self.third = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
        self.place = np.zeros(OWN_LETTERS, np.int64)
        for c in range(1, OWN_LETTERS):
            if chr(c).isalpha():
                self.place[c] = c
        self.rare: dict[int, int] = {}

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Letters' places; 0 for what is no letter."""
        out = self.place[np.minimum(codes, OWN_LETTERS - 1)]
        far = np.flatnonzero(codes >= OWN_LETTERS)
        if len(far):
            for c in np.unique(codes[far]).tolist():
                if c not in self.rare:
                    self.rare[c] = OWN_LETTERS + c * 2654435761 % (LETTERS - OWN_LETTERS) if chr(c).isalpha() else 0
            out[far] = [self.rare[c] for c in codes[far].tolist()]
        return out

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams with a letter in the middle, a word's ends being one non-letter, and their counts."""
        p = self.places(np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32))
        gap = p == 0
        p = p[~gap | np.append(True, ~gap[:-1])]  # a run of non-letters is one
        code = (p[:-2] * LETTERS + p[1:-1]) * LETTERS + p[2:]
        return np.unique(code[p[1:-1] > 0], return_counts=True)

    def vector(self, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        total = np.zeros(self.size, np.float32)
        for a in range(0, len(code), 4096):
            c, n = code[a : a + 4096], count[a : a + 4096]
            bound = self.first[c // (LETTERS * LETTERS)] * self.second[c // LETTERS % LETTERS]
            bound *= self.third[c % LETTERS]
            total += n.astype(np.float32) @ bound.astype(np.float32)
        return total


def language_prototypes(training: DataFrame, size: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Languages and unit prototypes from columns text and lang.

    Each task bundles all trigrams of each language; the sums, a vector for each language and task,
    are added by language, those of some hundred tasks first.
    """
    schema = pa.schema([("lang", pa.string()), ("task", pa.int64()), ("sums", pa.binary())])

    def partial(batches):
        binder = Binder(size, seed)
        total: dict[str, np.ndarray] = {}
        for block, _, _ in text_blocks(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(block.column("lang").to_pylist(), block.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                total[lang] = total.get(lang, 0) + binder.vector(*binder.trigrams(" ".join(texts))).astype(np.float64)
        task = TaskContext.get().partitionId()
        yield record_batch(schema, [list(total), [task] * len(total), [v.tobytes() for v in total.values()]])

    parts = training.mapInArrow(partial, "lang string, task long, sums binary")
    rows = add_up(parts, ["lang"]).orderBy("lang").collect()
    vectors = np.array([np.frombuffer(r.sums) for r in rows]).reshape(len(rows), size)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return [r.lang for r in rows], (vectors / np.maximum(norms, 1e-12)).astype(np.float32)


def identify_languages(
    docs: DataFrame, folds: int = 3, held_out_fold: int = 1, size: int = 512, seed: int = 11, unknown: str = "und"
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from text and non-null lang of the rows whose crc32(doc_id) mod folds
    isn't the held-out fold.  Null texts and texts without a letter, and all texts
    where nothing was learned, are ``unknown`` with score 0; equal cosines go to
    the language first by name.  The score is the cosine, 0 at least.  Null ids
    count as the empty id; repeated rows get repeated results.  Texts of any length are read whole; an empty table gives an
    empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = fold_of(F.col("doc_id"), folds) == held_out_fold
    training = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    languages, prototypes = language_prototypes(training, size, seed)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        binder = Binder(size, seed)
        for block, _, _ in text_blocks(batches):
            names, scores = [], []
            for text in pc.fill_null(block.column("text"), "").to_pylist():
                code, count = binder.trigrams(text)
                best, score = unknown, 0.0
                if len(code) and languages:
                    v = binder.vector(code, count)
                    cosines = prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                    k = int(np.argmax(cosines))
                    best, score = languages[k], float(np.clip(cosines[k], 0, 1))
                names.append(best)
                scores.append(score)
            yield record_batch(schema, [block.column("doc_id"), names, scores])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out_fold).alias("held_out"), "lang_pred", "score")
