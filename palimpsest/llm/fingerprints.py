"""Improbable-feature digests of whole texts, and their likeness.

Every window of ``WINDOW`` bytes has a collision entropy, -log2 of the chance
that two of its bytes are equal; the number of equal pairs in a window is an
exact integer form of it.  Windows are ranked by how rare their entropy is over all
documents.  The rarest window of each neighbourhood is a candidate; those that win
enough neighbourhoods are the features.  They fill a chain of Bloom filters, and two
digests are compared by the bits they share beyond what chance gives.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record_batch, text_blocks
from .words import segment_hashes

WINDOW = 32
PAIRS = WINDOW * (WINDOW - 1) // 2
#: Windows with more equal pairs than this are runs of few bytes and say nothing.
WEAK_PAIRS = PAIRS // 3
NEIGHBOURS = 64
WINS = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
NEVER = np.uint64(PAIRS + 1)
#: Windows of a text that are worked on at once.
PIECE = 1 << 20
#: Words of two chains that are compared at once.
COMPARED_WORDS = 1 << 20


def equal_pairs(data: np.ndarray) -> np.ndarray:
    """Equal pairs of bytes in each window of ``data``."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        equal = (data[k:] == data[:-k]).view(np.uint8)
        ahead[:-k] += equal
        behind[k:] += equal
    pairs = np.empty(n - WINDOW + 1, np.int64)
    pairs[0] = int(behind[:WINDOW].sum())
    pairs[1:] = pairs[0] + np.cumsum(behind[WINDOW:].astype(np.int64) - ahead[: n - WINDOW])
    return pairs


def pair_counts(docs: DataFrame) -> np.ndarray:
    """Windows with each number of equal pairs, over all documents."""

    def run(batches):
        total = np.zeros(PAIRS + 1, np.int64)
        for _, data, offsets in text_blocks(batches):
            for begin in range(0, max(1, len(data) - WINDOW + 1), PIECE):  # a block is one text, if that is long
                pairs = equal_pairs(data[begin : begin + PIECE + WINDOW - 1])
                # windows that cross a document's end don't count
                inside = np.ones(len(pairs), bool)
                for cut in (offsets[1:-1] - begin).tolist():
                    inside[max(0, cut - WINDOW + 1) : max(0, cut)] = False
                total += np.bincount(pairs[inside], minlength=PAIRS + 1)
        schema = pa.schema([("pairs", pa.int32()), ("n", pa.int64())])
        yield record_batch(schema, [np.arange(PAIRS + 1, dtype=np.int32), total])

    rows = docs.select("text").mapInArrow(run, "pairs int, n long").groupBy("pairs").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(PAIRS + 1, np.int64)
    for pairs, n in rows:
        counts[pairs] = n
    return counts


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each number of equal pairs, 0 for the rarest; weak windows never win."""
    ranks = np.empty(PAIRS + 1, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(PAIRS + 1, dtype=np.uint64)
    ranks[WEAK_PAIRS + 1 :] = NEVER
    return ranks


def _features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the features of texts, in order of owner and place.

    Texts are worked on some at a time, long ones in pieces of ``PIECE`` windows: a piece has the bytes that the neighbourhoods of its
    windows reach into, so its windows win what they would win in the whole text, and memory doesn't follow a text's length.
    """
    owners, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    pieces: list[tuple[int, int, int, bytes]] = []
    size = 0

    def work() -> None:
        owner, found = _piece_features(pieces, ranks)
        owners.append(owner)
        hashes.append(found)
        pieces.clear()

    for i, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - WINDOW + 1), PIECE):
            context = min(begin, NEIGHBOURS - 1)
            end = min(begin + PIECE, max(0, len(text) - WINDOW + 1))
            part = text[begin - context : end + NEIGHBOURS + WINDOW - 2] if end > begin else b""
            pieces.append((i, context, context + end - begin, part))
            size += len(part)
            if size >= PIECE:
                work()
                size = 0
    work()
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    # a text without a feature is one as a whole
    without = [i for i in np.flatnonzero(np.bincount(owner, minlength=len(texts)) == 0).tolist() if texts[i]]
    whole = np.array([_whole_hash(texts[i]) for i in without], np.uint64)
    owner, found = np.concatenate([owner, np.array(without, np.int64)]), np.concatenate([found, whole])
    order = np.argsort(owner, kind="stable")
    return owner[order], found[order]


def _whole_hash(text: bytes) -> int:
    """Of the bytes, or for a long text of its pieces' hashes."""
    parts = [np.frombuffer(text[a : a + PIECE], np.uint8) for a in range(0, len(text), PIECE)]
    found = np.array([segment_hashes(p, np.array([0]), np.array([len(p)]))[0] for p in parts], np.uint64)
    return int(found[0]) if len(found) == 1 else _whole_hash(found.tobytes())


def _piece_features(pieces: list[tuple[int, int, int, bytes]], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces (owner, first and end of the windows that count, bytes)."""
    gap = bytes(NEIGHBOURS + WINDOW)
    lengths = np.array([len(p[3]) for p in pieces], np.int64)
    data = np.frombuffer(gap + b"".join(p[3] + gap for p in pieces), np.uint8)
    if not len(lengths):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    begins = len(gap) + np.cumsum(np.append(0, lengths[:-1] + len(gap)))
    windows = np.maximum(lengths - WINDOW + 1, 0)
    rank = np.full(len(data), NEVER, np.uint64)
    inside = np.repeat(begins, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    rank[inside] = ranks[equal_pairs(data)[inside]]
    # least (rank, place) of each neighbourhood, by doubling
    best = (rank << np.uint64(32)) | np.arange(len(data), dtype=np.uint64)
    span = 1
    while span < NEIGHBOURS:
        best[:-span] = np.minimum(best[:-span], best[span:])
        span *= 2
    winner = best[best < (NEVER << np.uint64(32))] & np.uint64(0xFFFFFFFF)
    chosen = np.flatnonzero(np.bincount(winner.astype(np.int64), minlength=len(data)) >= WINS)
    at = np.searchsorted(begins, chosen, side="right") - 1
    first, end = (np.array([p[k] for p in pieces], np.int64) for k in (1, 2))
    counts = (chosen - begins[at] >= first[at]) & (chosen - begins[at] < end[at])
    chosen, at = chosen[counts], at[counts]
    return np.array([p[0] for p in pieces], np.int64)[at], segment_hashes(data, chosen, chosen + WINDOW)


class Digests:
    """Filters of the texts of a block: those of text i are first[i]:first[i + 1]."""

    def __init__(self, texts: list[bytes], ranks: np.ndarray):
        owner, hashes = _features(texts, ranks)
        self.features = np.bincount(owner, minlength=len(texts))
        chain = -(-self.features // FILTER_FEATURES)
        self.first = np.concatenate([[0], np.cumsum(chain)])
        before = np.cumsum(self.features) - self.features
        row = self.first[owner] + (np.arange(len(owner)) - before[owner]) // FILTER_FEATURES
        bits = np.zeros((self.first[-1], FILTER_BITS), bool)
        for k in range(HASHES):
            bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        self.packed = np.packbits(bits, axis=1)
        self.words = self.packed.view(np.uint64) if len(bits) else np.empty((0, FILTER_BITS // 64), np.uint64)
        self.ones = bits.sum(axis=1)

    def text(self, i: int) -> str:
        """features:filters, the filters in base 64."""
        part = self.packed[self.first[i] : self.first[i + 1]]
        return f"{self.features[i]}:{base64.b64encode(part.tobytes()).decode()}"

    def likeness(self, i: int, j: int) -> float:
        """Mean over the filters of the shorter chain of the best normalised overlap with the other's."""
        a, b = slice(self.first[i], self.first[i + 1]), slice(self.first[j], self.first[j + 1])
        x, y, p, q = self.words[a], self.words[b], self.ones[a], self.ones[b]
        if not len(x) or not len(y):
            return float(len(x) == len(y))
        if len(x) > len(y):
            x, y, p, q = y, x, q, p
        best = np.zeros(len(x))
        step = max(1, COMPARED_WORDS // (len(x) * x.shape[1]))  # long chains a part at a time
        for a in range(0, len(y), step):
            part = slice(a, a + step)
            common = np.bitwise_count(x[:, None] & y[None, part]).sum(axis=2, dtype=np.int64)
            chance = p[:, None] * q[None, part] / FILTER_BITS
            most = np.minimum(p[:, None], q[None, part])
            best = np.maximum(best, ((common - chance) / np.maximum(most - chance, 1e-9)).max(axis=1))
        return float(np.minimum(best, 1).mean())


def _ordered(docs: DataFrame, target_rows: int, max_slices: int) -> DataFrame:
    """Rows dealt to slices by descending id, with the row that follows a slice's
    last one added at its end (``ahead`` 1).

    Slices come from quantiles of the ids, cut evenly between two quantiles.  An id that
    spans quantiles, and the null id, are cut by the hash of the text, so only equal rows must
    share a slice.  Only the first row of each slice, ``max_slices`` at most, is broadcast.
    """
    quantiles = F.percentile_approx("doc_id", [k / 256 for k in range(257)], 2000)
    stats = docs.agg(F.count("*"), quantiles).first()
    found = stats[1] or [0]
    hot = {a for a, b in zip(found[:-1], found[1:], strict=True) if a == b}
    bounds = sorted(set(found) | {b + 1 for b in hot})
    parts = max(1, min(max_slices // 520, -(-stats[0] // (target_rows * max(1, len(bounds) - 1)))))
    rows = docs.withColumn("h", F.xxhash64("text"))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    coarse = F.greatest(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(edges, coarse), F.coalesce(F.try_element_at(edges, coarse + 1), F.element_at(edges, coarse) + 1)
    by_hash = F.col("h") / F.lit(2.0**64) + 0.5
    share = F.when(high - low == 1, by_hash).otherwise((F.col("doc_id") - low) / (high - low))
    fine = F.greatest(F.least(F.floor(share * parts), F.lit(parts - 1)), F.lit(0))
    none = F.least(F.floor(by_hash * parts), F.lit(parts - 1)) - parts
    rows = rows.withColumn("slice", F.when(F.col("doc_id").isNull(), none).otherwise(coarse * parts + fine).cast("int"))
    firsts = rows.groupBy("slice").agg(F.max(F.struct("doc_id", "h")).alias("f"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("slice"))
    every = Window.partitionBy(F.lit(0))
    # the slice before in the order; the first row of all follows the last slice
    firsts = firsts.withColumn("to", F.coalesce(F.lag("slice").over(down), F.min("slice").over(every)))
    firsts = firsts.select(F.col("slice").alias("of"), F.col("f.doc_id").alias("first_id"), F.col("f.h").alias("first_h"), "to")
    same = (F.col("slice") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    marked = rows.join(F.broadcast(firsts), same, "left")
    own = F.struct(F.col("slice"), F.lit(0).alias("ahead"))
    ahead = F.struct(F.col("to").alias("slice"), F.lit(1).alias("ahead"))
    dealt = marked.select("doc_id", "text", "h", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, ahead))).alias("s"))
    dealt = dealt.select("doc_id", "text", "h", "s.slice", "s.ahead")
    return dealt.repartition("slice").sortWithinPartitions("slice", "ahead", F.desc("doc_id"), F.desc("h"))


def fingerprint_documents(docs: DataFrame, target_rows: int = 4096, max_slices: int = 1 << 16) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    A text's edited text has its last floor(n / 2) code points replaced by the
    first as many (or all) of the next document's, in descending order of ids,
    the first following the last; equal ids go by a hash of their texts, null ids come
    last.  Null text is empty.  Empty texts have no features; two of them are alike (1),
    one is unlike any other (0).  Equal texts have equal fingerprints.  Texts of any length are read whole, in pieces.  Repeated
    rows are rows of their own; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranks = rarity_ranks(pair_counts(docs))
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text) in order; the last one is only the next of the one before."""
        texts = [t for _, t in rows]
        edited = []
        for text, following in zip(texts[:-1], texts[1:], strict=True):
            half = len(text) // 2
            edited.append((text[: len(text) - half] + following[:half]).encode())
        n = len(edited)
        digests = Digests([t.encode() for t in texts] + edited, ranks)
        prints = [digests.text(i) for i in range(2 * n + 1)]
        return record_batch(
            schema,
            [
                [d for d, _ in rows[:-1]],
                [len(t) for t in texts[:-1]],
                [hashlib.sha256(e).hexdigest() for e in edited],
                prints[:n],
                prints[n + 1 :],
                [digests.likeness(i, n + 1 + i) for i in range(n)],
                [digests.likeness(i, i + 1) for i in range(n)],
            ],
        )

    def run(batches):
        held: list[tuple] = []
        size, current, done = 0, None, False
        for batch in batches:
            for doc_id, text, at, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "slice", "ahead")), strict=True):
                if at != current:
                    held, size, current, done = [], 0, at, False
                if done:  # rows equal to the one that follows the slice
                    continue
                done = bool(ahead)
                held.append((doc_id, text))
                size += len(text)
                if len(held) > 1 and (ahead or size > 1 << 20):
                    yield rows_of(held)
                    held, size = held[-1:], len(text)

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _ordered(docs, target_rows, max_slices).mapInArrow(run, ddl)
