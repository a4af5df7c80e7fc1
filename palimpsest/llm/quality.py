"""Quality classifier: random Fourier features of document statistics.

Statistics of whole texts are standardised by their mean and deviation over all
documents and mapped to random cosines that approximate a Gaussian kernel.  Each
partition sums its part of the normal equations; their sum, of fixed size, gives
the ridge weights.  Raw scores become probabilities by isotonic regression on
the labelled rows, grouped by rounded score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_up, fold_of, materialize, record_batch, text_blocks
from .words import NOT_SPACE, words_of

_CODES = np.arange(256)
_CLASS = np.zeros(256, np.int64)  # 0: other symbols
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-", b"!", b"|", b"*#$%&"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
N_CLASSES = 11
_NOT_NEWLINE = _CODES != 0x0A
_LETTER_END = (_CLASS == 1) | (_CLASS == 2) | (_CLASS == 10)
#: Statistics of a text; shares are of its bytes, words or lines.
STATISTICS = (
    "log_bytes", "other", "lower", "upper", "digits", "space", "newlines", "marks", "shouts", "bars", "junk", "beyond_ascii",
    "log_words", "word_bytes", "word_spread", "distinct_words", "plain_words", "upper_words", "repeated_lines", "line_bytes",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each document; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    share = np.bincount(doc * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(size, 1)[:, None]
    words = words_of(data, offsets, NOT_SPACE)
    many = np.diff(words.first)
    owner = np.repeat(np.arange(n), many)
    length = (words.ends - words.starts).astype(np.float64)
    per = np.maximum(many, 1)
    mean = np.bincount(owner, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / per - mean**2, 0))
    last = data[words.ends - 1] if len(length) else np.empty(0, np.uint8)
    plain = np.bincount(owner, _LETTER_END[last], n) / per
    capital = (_CLASS[data] == 2).astype(np.int64)
    capitals = np.concatenate([[0], np.cumsum(capital)])
    small = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
    shouted = (capitals[words.ends] - capitals[words.starts] > 1) & (small[words.ends] == small[words.starts])
    lines = words_of(data, offsets, _NOT_NEWLINE)
    distinct, repeated = np.zeros(n), np.zeros(n)
    for i in range(n):
        a, b = words.first[i], words.first[i + 1]
        if b > a:
            distinct[i] = len(np.unique(words.hashes[a:b])) / (b - a)
        a, b = lines.first[i], lines.first[i + 1]
        if b > a:
            repeated[i] = 1 - len(np.unique(lines.hashes[a:b])) / (b - a)
    n_lines = np.diff(lines.first)
    line_bytes = np.log1p(size / np.maximum(n_lines, 1))
    return np.column_stack(
        [np.log1p(size), share, np.log1p(many), mean, spread, distinct, plain, np.bincount(owner, shouted, n) / per, repeated, line_bytes]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of the whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for block, data, offsets in text_blocks(batches):
            x = statistics(data, offsets)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield record_batch(schema, [block.column("doc_id"), lists])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


class Features:
    """Standardised statistics to random cosines and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1)
        self.weight = rng.normal(0, 1 / width, (len(mean), size))
        self.phase = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weight + self.phase
        return np.column_stack([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones(len(z))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def normal_equations(labelled: DataFrame, features: Features, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over columns x and y."""
    size = len(features.phase) + 1
    schema = pa.schema([("row", pa.int32()), ("task", pa.int64()), ("sums", pa.binary())])

    def partial(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = features(_matrix(batch.column("x"), width))
                y = np.asarray(batch.column("y"), np.float64)
                total += z.T @ np.column_stack([z, y])
        if total.any():
            task = TaskContext.get().partitionId()
            yield record_batch(schema, [np.arange(size, dtype=np.int32), [task] * size, [r.tobytes() for r in total]])

    parts = labelled.select("x", "y").mapInArrow(partial, "row int, task long, sums binary")
    rows = add_up(parts, ["row"]).orderBy("row").collect()
    total = np.array([np.frombuffer(r.sums) for r in rows]) if rows else np.zeros((size, size + 1))
    return total[:, :-1], total[:, -1]


def isotonic(score: np.ndarray, label_sum: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; ``score`` ascending.  Scores and fitted values of the pools' members."""
    pools: list[list[float]] = []
    for s, w in zip(label_sum.tolist(), weight.tolist(), strict=True):
        pools.append([s, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, w2, k2 = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += w2
            pools[-1][2] += k2
    # a pool's value leans a little to the prior, so that few rows don't give 0 or 1
    prior = label_sum.sum() / max(weight.sum(), 1)
    fitted = [v for s, w, k in pools for v in [(s + prior) / (w + 1)] * k]
    return score, np.maximum.accumulate(np.array(fitted))


def calibrate(scored: DataFrame, score: str, label: str, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic points from all rows, by rounded score (clipped to 2,000 steps either side)."""
    place = F.greatest(F.least(F.round(F.col(score) / step), F.lit(2000)), F.lit(-2000))
    rows = scored.groupBy(place.cast("int").alias("p")).agg(F.sum(label).cast("double").alias("s"), F.count("*").alias("n")).orderBy("p").collect()
    if not rows:
        return np.array([0.0]), np.array([0.5])
    p, s, n = (np.array(c, np.float64) for c in zip(*rows, strict=True))
    return isotonic(p * step, s, n)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    held_out_fold: int = 0,
    size: int = 256,
    width: float = 4.0,
    ridge: float = 1e-3,
    seed: int = 7,
    threshold: float = 0.3,
) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    ``labels`` has doc_id and y (0 or 1; other rows are left out); only those
    whose crc32(doc_id) mod folds isn't the held-out fold are learned from.
    Labels of an id that repeats count each; null ids have no label and are
    scored.  Null and empty texts have zeros as statistics.  Without labels
    all scores are 0.5; without documents the result is empty.  Texts of any length are read whole (a text's statistics take some
    80 times its bytes while they are made); equal texts have equal scores; other columns are ignored.
    """
    width_x = len(STATISTICS)
    stats = materialize(document_statistics(docs), "statistics")
    sums = stats.agg(*[f(F.col("x")[i]) for i in range(width_x) for f in (F.avg, F.stddev_pop)]).first()
    moments = np.array([v if v is not None else 0.0 for v in sums]).reshape(width_x, 2)
    features = Features(moments[:, 0], moments[:, 1], size, width, seed)

    known = labels.where("y IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "y")
    known = known.where(fold_of(F.col("doc_id"), folds) != held_out_fold)
    labelled = materialize(stats.join(known, "doc_id"), "labelled")
    zz, zy = normal_equations(labelled, features, width_x)
    weights = np.linalg.solve(zz + ridge * max(zz[-1, -1], 1) * np.eye(size + 1), zy)

    def raw(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), width_x) if batch.num_rows else np.empty((0, width_x))
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "x"]
            names = [name for name in batch.schema.names if name != "x"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(features(x) @ weights)], [*names, "raw"])

    points, values = calibrate(labelled.select("x", "y").mapInArrow(raw, "y int, raw double"), "raw", "y", 1 / 500)

    def final(batches):
        for batch in raw(batches):
            score = np.clip(np.interp(np.asarray(batch.column("raw")), points, values), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = stats.mapInArrow(final, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id"), folds) == held_out_fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
