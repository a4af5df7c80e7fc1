"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text.  A text is cut
into windows of one word or some; a window's distance is how many bytes shorter it gets
with the toxic dictionary than with the ordinary one.  Thresholds on the
distances are calibrated on all labelled rows.

Whole windows of raw text don't tell toxic documents: most of their words are as ordinary as
any, and which of two dictionaries happens to hold a longer piece of an ordinary word outweighs the
few bytes that a toxic word saves (the README has the figures).  So the windows are made of chosen words: a text's
words, once each, that the ordinary training text doesn't hold often or the toxic training
text holds more often.  The toxic dictionary learns from those of them that go with toxic
documents.

The dictionaries are fitted on a bounded sample of labelled rows (``sample`` of
each label, by hash); calibration takes all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold_of, free_name, materialize, record_batch, text_blocks, tidy_batches
from .quality import calibrate

#: Lengths of word beginnings that count as words when toxic words are sought.
STEMS = (4, 5, 6)
LEVEL = 9
#: The highest distances of a text that make its own: toxic words are few in a text, however long it is.
HIGHEST = 3


def _stems(word: bytes) -> list[bytes]:
    return [word[:k] + b"\0" for k in STEMS if len(word) > k]


def _words(text: bytes) -> list[bytes]:
    """Distinct words, lower-cased, in order."""
    return list(dict.fromkeys(text.lower().split()))


def _word_counts(sample: DataFrame) -> DataFrame:
    """word (or stem), and the ordinary and toxic documents of the sample with it."""
    schema = pa.schema([("word", pa.binary()), ("n0", pa.int64()), ("n1", pa.int64())])

    def run(batches):
        counts: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = _words((text or "").encode())
                for w in {*words, *(s for w in words for s in _stems(w))}:
                    counts.setdefault(w, [0, 0])[y] += 1
            if len(counts) > 300_000:
                yield record_batch(schema, [list(counts), [c[0] for c in counts.values()], [c[1] for c in counts.values()]])
                counts = {}
        yield record_batch(schema, [list(counts), [c[0] for c in counts.values()], [c[1] for c in counts.values()]])

    rows = sample.select("text", "y").mapInArrow(tidy_batches(run), "word binary, n0 long, n1 long")
    return rows.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def windows(words: list[bytes], k: int) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + k]) + b" " for i in range(0, len(words), k)]


class Detector:
    """Ordinary vocabulary, dictionaries and window size; what tasks need to score.  ``learned`` says if both labels were there."""

    def __init__(self, ordinary: frozenset, dictionaries: tuple[bytes, bytes], window_words: int, learned: bool):
        self.ordinary, self.dictionaries, self.window_words, self.learned = ordinary, dictionaries, window_words, learned

    def open(self) -> Detector:
        packers = []
        for content in self.dictionaries:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            packers.append(
                zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress
            )
        ordinary, toxic = packers
        # a task meets many words again
        self.shorter = lru_cache(1 << 16)(lambda window: len(ordinary(window)) - len(toxic(window)))
        return self

    def distance(self, text: bytes) -> float:
        """The greatest window distance, and a part of the next two as a finer order."""
        known = self.ordinary
        found = [self.shorter(w) for w in windows([w for w in _words(text) if w not in known], self.window_words)]
        if not found:
            return -20.0
        top = sorted(found)[-HIGHEST:]
        return top[-1] + sum(top[:-1]) / 8


def train_detector(
    sample: DataFrame,
    window_words: int = 1,
    training_words: int = 10,
    dictionary_bytes: int = 8192,
    least_lift: float = 1.0,
    weight_share: float = 0.03,
    chance: float = 3.0,
    rare_share: float = 1 / 1500,
    ordinary_windows: int = 40_000,
    toxic_windows: int = 20_000,
) -> Detector:
    """From a bounded sample with text and y: all that is collected is bounded by the sample and the parameters.

    An ordinary word is one that a ``rare_share`` of the sample's ordinary documents hold (three at least).  A dictionary is trained on at most ``ordinary_windows`` or ``toxic_windows`` windows of ``training_words`` words of
    its label, by hash.
    A word (or stem) goes with toxic documents by n1 * log(share of toxic / share
    of ordinary documents with it), and counts if it has ``weight_share`` of the greatest such weight and chance doesn't give it.
    An ordinary word is left out of windows unless toxic documents hold it more often by over ``chance`` standard errors.
    """
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counts = materialize(_word_counts(sample), "words")
    least = max(3, int(n0 * rare_share))
    whole = F.substring("word", -1, 1) != F.lit(b"\0")
    # documents with the word beyond what ordinary text's share of it gives: a word that toxic text holds more often, chance aside, stays
    ratio = n1 / max(n0, 1)
    beyond = (F.col("n1") - ratio * F.col("n0")) / F.sqrt(F.col("n1") + ratio * ratio * F.col("n0"))
    common = counts.where(whole & (F.col("n0") >= least) & (beyond <= chance))
    ordinary = frozenset(bytes(r.word) for r in common.select("word").collect())
    lift = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    weight = F.col("n1") * lift
    # more often in toxic text than chance gives any of all the words: a likelihood ratio beyond their number
    expected = ratio * (F.col("n0") + 0.5)
    surely = F.col("n1") * F.log(F.col("n1") / expected) - (F.col("n1") - expected) > F.log(F.lit(max(counts.count(), 2)))
    telling = counts.where((lift > least_lift) & (F.col("n1") > 0) & surely).select("word", weight.alias("weight"))
    rows = telling.collect()
    greatest = max((r.weight for r in rows), default=0.0)
    marked = frozenset(bytes(r.word) for r in rows if r.weight >= weight_share * greatest)
    detector = Detector(ordinary, (b"", b""), window_words, n0 > 0 and n1 > 0)

    schema = pa.schema([("y", pa.int32()), ("window", pa.binary())])

    def run(batches):
        for batch in batches:
            ys, out = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                rest = [w for w in _words((text or "").encode()) if w not in ordinary]
                told = [w for w in rest if w in marked or any(s in marked for s in _stems(w))]
                if not y:
                    told = [w for w in rest if w not in set(told)]
                for w in windows(told, training_words):
                    ys.append(y)
                    out.append(w)
            yield record_batch(schema, [ys, out])

    cut = materialize(sample.select("text", "y").mapInArrow(tidy_batches(run), "y int, window binary"), "windows")
    per_label = {}
    for y, most in ((0, ordinary_windows), (1, toxic_windows)):
        picked = cut.where(F.col("y") == y).orderBy(F.xxhash64("window"), "window").limit(most)
        per_label[y] = [bytes(r.window) for r in picked.select("window").collect()]

    def trained(samples: list[bytes]) -> bytes:
        # a trained dictionary begins with its tables and its least valuable content
        try:
            return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()[-dictionary_bytes * 3 // 4 :]
        except zstandard.ZstdError:  # too few samples: they are the dictionary
            return b"".join(samples)[: dictionary_bytes * 3 // 4]

    detector.dictionaries = (trained(per_label[0]), trained(per_label[1]))
    return detector


@dataclass
class Calibrated:
    """The isotonic points of distances."""

    points: np.ndarray
    values: np.ndarray

    def score(self, distance: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(distance, self.points, self.values), 0, 1)


def _with_distances(docs: DataFrame, detector: Detector, name: str) -> DataFrame:
    """All columns and rows, and the distance of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        opened = sent.value.open()
        for block, data, offsets in text_blocks(batches):
            raw = data.tobytes()
            found = [opened.distance(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found, pa.float64())], [*block.schema.names, name])

    return docs.mapInArrow(tidy_batches(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def _known(labels: DataFrame, folds: int, held_out_fold: int) -> DataFrame:
    known = labels.where("y IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"))
    return known.where(fold_of(F.col("doc_id"), folds) != held_out_fold)


def _detector(docs: DataFrame, known: DataFrame, sample: int) -> Detector:
    # 2 * sample ids at most: bounded, so they are broadcast
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = materialize(rows.join(F.broadcast(parts[0].union(parts[1])), "doc_id"), "sample")
    return train_detector(chosen)


def _calibrated(distances: DataFrame, known: DataFrame) -> Calibrated:
    return Calibrated(*calibrate(distances.join(known, "doc_id"), "distance", "y", 1 / 8))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    held_out_fold: int = 0,
    sample: int = 8_000,
    threshold: float = 0.5,
) -> DataFrame:
    """doc_id, held_out, distance, score and predicted for every document.

    ``labels`` has doc_id and y (0 or 1, other rows are left out); only those whose
    crc32(doc_id) mod folds isn't the held-out fold are learned from.  Null and
    empty texts, and texts of ordinary words only, have the least distance.
    Null ids are scored and never labelled; repeated rows get repeated results.
    Equal distances have equal scores; texts of any length are read whole.  Where a label is missing nothing
    was learned, and all scores are 0; without documents the result is empty.
    """
    known = _known(labels, folds, held_out_fold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    detector = _detector(docs, known, sample)
    found = _with_distances(rows, detector, "distance").drop("text")
    distances = materialize(found, "distances")
    fitted, learned = _calibrated(distances, known), float(detector.learned)

    def final(batches):
        for batch in batches:
            score = fitted.score(np.asarray(batch.column("distance"))) * learned
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], ["doc_id", "distance", "score"])

    scored = distances.mapInArrow(final, "doc_id long, distance double, score double")
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id"), folds) == held_out_fold).alias("held_out"),
        "distance",
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def remove_toxic(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    held_out_fold: int = 0,
    sample: int = 8_000,
    threshold: float = 0.5,
) -> DataFrame:
    """The documents that ``score_toxicity`` doesn't predict to be toxic, with all their columns.

    All stay where a label is missing.  Null and empty texts have the least distance and stay, unless the calibration finds
    even that toxic; null ids are judged by their texts, repeated rows alike.  Extra columns may have any
    names.  An empty table gives an empty result.
    """
    known = _known(labels, folds, held_out_fold)
    name = free_name(docs, "distance")
    detector = _detector(docs, known, sample)
    if not detector.learned:
        return docs
    tagged = materialize(_with_distances(docs, detector, name), "tagged")
    distances = tagged.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("distance"))
    fitted = _calibrated(distances, known)
    # scores rise with the distance: keep what lies below the threshold's distance
    grid = np.arange(-2000, 2001) / 64
    toxic = grid[fitted.score(grid) >= threshold]
    return (tagged.where(F.col(name) < float(toxic[0])) if len(toxic) else tagged).drop(name)
