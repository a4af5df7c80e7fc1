"""Hard negatives by exact integer scores, computed the Four Russians' way.

Components become integers, floor(256 x).  For a block of anchors, tables hold the sum of an
anchor's components over each of the 256 subsets of every eight dimensions.  Candidates
are packed once: bit plane b of eight dimensions is one byte.  A score is then the sum,
shifted by b, of what the tables give for the candidate's bytes; the highest plane is the sign.

Rows are packed in blocks and written.  Anchors go in parts of ``anchor_part`` at most: a part
is broadcast (some 256 bytes an anchor at 64 dimensions), every task scores its candidates
against it, and keeps the best few for each anchor in arrays; those of all tasks meet by
anchor.  A first round finds positives, a second one negatives in the score ranges that the
positives set.  Work is anchors times rows, as asked; nothing is a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, materialize_parts

#: rows of a packed block, and anchors whose tables a task holds at once
BLOCK, TABLES = 1024, 128
_PACKED = "ids binary, labels binary, rows binary, planes int, bits binary"
_BEST = "anchor_row long, slot int, score long, row long, id long"
#: stands for a null id in arrays
_NO_ID = np.iinfo(np.int64).max
_LOW = np.iinfo(np.int64).min


def as_integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x); what doesn't fit 64 bits becomes the nearest that does."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * 256)
    out = np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    out[scaled >= 2.0**63] = np.iinfo(np.int64).max
    return out


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """Two's complement bits of (rows, dims), dims a multiple of eight, as bytes of eight dimensions: (planes, dims / 8, rows)."""
    rows, dims = vectors.shape
    reach = int(max(vectors.max(initial=0), ~vectors.min(initial=0))).bit_length()
    planes = np.empty((reach + 1, dims // 8, rows), np.uint8)
    for b in range(reach + 1):
        bits = ((vectors >> min(b, 63)) & 1).astype(np.uint8)
        planes[b] = np.packbits(bits.reshape(rows, dims // 8, 8), axis=2, bitorder="little")[:, :, 0].T
    return planes


def subset_tables(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(dims / 8, 256, anchors): sums of an anchor's components over the subsets of eight dimensions."""
    parts = anchors.reshape(len(anchors), -1, 8).transpose(1, 2, 0).astype(kind)
    tables = np.zeros((len(parts), 256, len(anchors)), kind)
    for d in range(8):
        tables[:, 1 << d : 2 << d] = tables[:, : 1 << d] + parts[:, d, None]
    return tables


def scores_of(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): sums of looked-up subsets, each plane shifted by its place, the last one taken away."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    plane = np.empty_like(total)
    for b in range(len(planes) - 1, -1, -1):
        plane[:] = 0
        for table, picks in zip(tables, planes[b], strict=False):  # dimensions that one side lacks add nothing
            np.take(table, picks, axis=0, out=found, mode="clip")
            plane += found
        # shift-add from the top: the total so far counts twice a lower plane
        total <<= 1
        if b == len(planes) - 1:
            total -= plane
        else:
            total += plane
    return total


def as_matrix(column: pa.Array) -> np.ndarray:
    """Lists of doubles as integers, (rows, dims): shorter ones are filled up with zeros to a multiple of eight."""
    lengths = column.value_lengths().to_numpy().astype(np.int64)
    dims = max(8, -(-int(lengths.max(initial=0)) // 8) * 8)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = as_integers(column.flatten().to_numpy(zero_copy_only=False))
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: their ids, labels and numbers, and their bit planes."""
    for whole in batches:
        for begin in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(begin, BLOCK)
            planes = bit_planes(as_matrix(batch.column("vector")))
            row = {name: batch.column(key).fill_null(int(_NO_ID)).to_numpy().tobytes() for name, key in (("ids", "id"), ("labels", "label"), ("rows", "row"))}
            yield pa.RecordBatch.from_pylist([row | {"planes": len(planes), "bits": planes.tobytes()}], pa.schema(
                [("ids", pa.binary()), ("labels", pa.binary()), ("rows", pa.binary()), ("planes", pa.int32()), ("bits", pa.binary())]
            ))


class Best:
    """The best entries of each slot, by score, then id: a few arrays that are cut to ``most`` a slot whenever they have doubled."""

    def __init__(self, most: int):
        self.most, self.kept = most, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, slots: np.ndarray, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((slots, scores, rows, ids))
        if sum(len(p[0]) for p in self.parts) > 2 * self.kept + (1 << 16):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        columns = [np.concatenate(p) for p in zip(*self.parts, strict=True)]
        slots, scores, rows, ids = columns
        order = np.lexsort((rows, ids, ~scores, slots))
        ordered = slots[order]
        order = order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < self.most]
        self.parts, self.kept = [tuple(c[order] for c in columns)], len(order)
        return self.parts[0]

    def floors(self, slots: int) -> np.ndarray:
        """The score that a slot's next entry must reach: that of its last place, where all places are taken."""
        out = np.full(slots, _LOW)
        if self.parts:
            at, scores, *_ = self.cut()
            counts = np.bincount(at, minlength=slots)
            last = np.cumsum(counts) - 1
            full = counts >= self.most
            out[full] = scores[last[full]]
        return out


def search(blocks: Iterator[tuple], anchors: dict, most: int) -> tuple[np.ndarray, ...]:
    """slot, score, row and id of the ``most`` best allowed rows of each slot.

    ``anchors`` has rows, labels and vectors; ``same`` says whether a slot's rows are those of the anchor's
    label, itself left out, or those of all others; ``low`` and ``high``, (anchors, slots of each), bound the scores.
    """
    low, high = anchors["low"], anchors["high"]
    vectors, count = anchors["vectors"], low.shape[1]
    reach = float(np.abs(vectors.astype(np.float64)).sum(axis=1).max(initial=0))
    best = Best(most)
    for ids, labels, rows, planes in blocks:
        floors = np.maximum(low, best.floors(low.size).reshape(low.shape))
        kind = np.int32 if reach * 2.0 ** len(planes) < 2**31 else np.int64
        for begin in range(0, len(vectors), TABLES):
            part = slice(begin, begin + TABLES)
            scores = scores_of(subset_tables(vectors[part], kind), planes).astype(np.int64)
            allowed = labels[:, None] == anchors["labels"][part]
            if anchors["same"]:
                allowed &= rows[:, None] != anchors["rows"][part]
            else:
                allowed = ~allowed
            for k in range(count):
                at, anchor = np.nonzero(allowed & (scores >= floors[part, k]) & (scores <= high[part, k]))
                if len(at):
                    best.add((anchor + begin) * count + k, scores[at, anchor], rows[at], ids[at])
    return best.cut()


def _search_task(shared, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                for b in batch.to_pylist():
                    ids, labels, rows = (np.frombuffer(b[c], np.int64) for c in ("ids", "labels", "rows"))
                    yield ids, labels, rows, np.frombuffer(b["bits"], np.uint8).reshape(b["planes"], -1, len(ids))

        anchors = shared.value
        slot, score, row, ids = search(blocks(), anchors, most)
        count = anchors["low"].shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchors["rows"][slot // count]), pa.array((slot % count).astype(np.int32)), pa.array(score),
                pa.array(row), pa.array(ids, mask=ids == _NO_ID),
            ],
            names=["anchor_row", "slot", "score", "row", "id"],
        )

    return run


def _best_of_tasks(blocks: DataFrame, anchors: dict, most: int) -> DataFrame:
    """The best of all tasks, with their ``rank`` from 1: anchor_row, slot, score, row, id, rank."""
    shared = blocks.sparkSession.sparkContext.broadcast(anchors)
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    found = blocks.mapInArrow(_search_task(shared, most), _BEST)
    out = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most), "best")
    shared.unpersist()
    return out


def _score_ranges(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer of low to high percent of each score, without overflow."""
    whole, rest = scores // 100, scores % 100
    return whole * low - (-(rest * low) // 100), whole * high + rest * high // 100


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, part_bytes: int = 16 << 20, task_blocks: int = 64
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, embedding, label).

    Anchors are the rows where ``is_anchor`` holds.  An anchor's positives are the ``positives`` best other rows of its
    label; for each, its negatives are the ``negatives`` best rows of other labels whose score is ``low`` to ``high``
    percent of the positive's.  Ties go by vec_id, nulls last; anything equal beyond that gives the same result rows.

    Rows with a null label or vector, or a null or non-finite component, take no part.  Repeated rows are
    rows of their own: a copy of an anchor is another row, and an anchor as well.  A null id takes part.  Vectors of other lengths are
    filled up with zeros.  Scores are exact where they fit 64 bits, and modulo 2**64 beyond.
    An empty table, or one without anchors, gives an empty result; further columns are ignored.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    taking = rows.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
    taking = materialize(taking.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, of_anchors, dims = taking.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector"))).first()
    parts = max(1, -(-of_anchors * (dims or 0) * 8 // part_bytes))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // (BLOCK * task_blocks)))
    blocks = materialize(taking.select("id", "label", "vector", "row").mapInArrow(_pack, _PACKED), "planes").repartition(tasks)

    def of_part(part: int) -> DataFrame:
        chosen = taking.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(parts)) == part)).select("row", "id", "label", "vector")
        data = chosen.toArrow().combine_chunks()
        n = data.num_rows
        column = data.column("vector").combine_chunks()
        anchors = {"rows": data.column("row").to_numpy(), "labels": data.column("label").to_numpy(), "vectors": as_matrix(column), "same": True}
        everything = np.iinfo(np.int64)
        bounds = {"low": np.full((n, 1), everything.min), "high": np.full((n, 1), everything.max)}
        found = _best_of_tasks(blocks, anchors | bounds, positives)
        # the positives of a part are few, five an anchor; their scores bound those of the negatives
        known = found.select("anchor_row", "rank", "score").toArrow()
        order = np.argsort(anchors["rows"])
        at = order[np.searchsorted(anchors["rows"][order], known.column("anchor_row").to_numpy())]
        slot = known.column("rank").to_numpy() - 1
        bounds = {"low": np.full((n, positives), everything.max), "high": np.full((n, positives), everything.min)}
        bounds["low"][at, slot], bounds["high"][at, slot] = _score_ranges(known.column("score").to_numpy(), low, high)
        worse = _best_of_tasks(blocks, anchors | bounds | {"same": False}, negatives)
        mine = found.select("anchor_row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        worse = worse.select("anchor_row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        ids = chosen.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
        return worse.join(mine, ["anchor_row", "slot"]).join(ids, "anchor_row").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        )

    return materialize_parts(rows.sparkSession, (of_part(k) for k in range(parts)), "negatives")
