"""Exact cosine search for many queries, and what builds on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the corpus holds, scores that a task computes at once, and rows that it multiplies at least.
QUERY_BLOCK, SCORES, ROWS = 4096, 1 << 18, 1024
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64()), ("grp", pa.string())])


class Best:
    """The k best ids of each query so far, in running arrays; among equal scores the smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, score: np.ndarray, ids: np.ndarray, queries: slice = slice(None)) -> None:
        """score: a row for each of ``queries``, a column for each id; -inf counts as none."""
        score = np.concatenate([self.score[queries], score], axis=1)
        ids = np.concatenate([self.id[queries], np.broadcast_to(ids, (len(score), len(ids)))], axis=1)
        place = np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
        edge = np.take_along_axis(score, place, 1).min(axis=1)
        for q in np.flatnonzero(((score >= edge[:, None]).sum(axis=1) > self.k) & (edge > -np.inf)):
            near = np.flatnonzero(score[q] >= edge[q])
            place[q] = near[np.lexsort((ids[q, near], -score[q, near]))][: self.k]
        self.score[queries], self.id[queries] = np.take_along_axis(score, place, 1), np.take_along_axis(ids, place, 1)

    def rows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, j = np.nonzero(self.score > -np.inf)
        return queries[q], self.id[q, j], self.score[q, j]


def _blocks(queries: DataFrame, id_: str):
    """The queries in parts of about QUERY_BLOCK, by hash."""
    passes = max(1, -(-queries.count() // QUERY_BLOCK))
    for turn in range(passes):
        yield queries if passes == 1 else queries.where(F.pmod(F.xxhash64(id_), F.lit(passes)) == turn)


def nearest_of(ids: np.ndarray, q: np.ndarray, k: int, batches):
    """The k best of Arrow batches (vec_id, embedding, grp) for each query and group, as one batch a group.

    Scores are made for some queries and some rows at a time, so memory beside the k best doesn't follow the number of either."""
    width, norms = q.shape[1], np.linalg.norm(q, axis=1)
    best: dict[str, Best] = {}
    step = max(ROWS, SCORES // max(1, len(ids)))
    part = max(1, SCORES // step)
    for whole in batches:
        for a in range(0, whole.num_rows, step) if len(ids) else ():
            batch = whole.slice(a, step)
            column = batch.column("embedding")
            fits = np.asarray(pc.equal(pc.fill_null(pc.list_value_length(column), -1), width))
            x = np.zeros((batch.num_rows, width))
            if width and fits.any():
                x[fits] = np.asarray(pc.fill_null(column.filter(pa.array(fits)).flatten(), 0.0), np.float64).reshape(-1, width)
            lengths = np.linalg.norm(x, axis=1)
            vec, names = np.asarray(batch.column("vec_id")), np.array(batch.column("grp").to_pylist(), object)
            owned = {name: names == name for name in set(names.tolist())}
            for b in range(0, len(ids), part):
                some = slice(b, b + part)
                scale = norms[some, None] * lengths[None]
                cosine = q[some] @ x.T
                np.divide(cosine, scale, out=cosine, where=scale > 0)
                cosine[~(scale > 0)] = 0.0
                for name, own in owned.items():
                    if name not in best:
                        best[name] = Best(len(ids), k)
                    best[name].add(cosine if own.all() else cosine[:, own], vec[own], some)
    for name, b in best.items():
        query, vec, cosine = b.rows(ids)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(cosine), pa.array([name] * len(query), pa.string())], schema=FOUND)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, floor: float | None = None, group: str | None = None) -> DataFrame:
    """query_id, vec_id, cosine and rank of the k nearest vectors of each query, or with a ``group`` column of the k nearest in each group.

    ``queries`` (query_id, embedding) is the bounded side: it is broadcast in blocks of
    QUERY_BLOCK vectors, one pass over the corpus each.  Every task multiplies
    matrices and keeps its own k best for each query and group, and only those are shuffled.
    Ties go to the smaller vec_id.  Null, empty, zero or unequal vectors have cosine 0.
    """
    spark = corpus.sparkSession
    found = None
    named = F.col(group).cast("string") if group else F.lit("")
    for block in _blocks(queries.select("query_id", "embedding"), "query_id"):
        rows = block.collect()
        width = max((len(r[1] or []) for r in rows), default=0)
        vectors = np.array([r[1] if len(r[1] or []) == width else [0.0] * width for r in rows], np.float64).reshape(len(rows), width)
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), vectors))

        def nearest(batches, sent=sent):
            yield from nearest_of(*sent.value, k, batches)

        part = corpus.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", named.alias("grp"))
        part = part.mapInArrow(nearest, "query_id long, vec_id long, cosine double, grp string")
        found = part if found is None else found.union(part)
    by = ["query_id", "grp"] if group else ["query_id"]
    w = Window.partitionBy(*by).orderBy(F.desc("cosine"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    found = found.withColumnRenamed("grp", group) if group else found.drop("grp")
    return found.where(F.col("cosine") >= floor) if floor is not None else found


def budgeted(rows: DataFrame, key: str, order: list, tokens: Column, limit: int, most: int) -> DataFrame:
    """The first ``most`` rows of each key, up to the first that would pass ``limit`` tokens."""
    w = Window.partitionBy(key).orderBy(*order)
    running = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).withColumn("_over", (running > limit).cast("int"))
    over = F.max("_over").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_stop", over).where("_stop = 0").drop("_n", "_over", "_stop")


def spread(ranked: DataFrame, k: int) -> DataFrame:
    """Per query: best and worst cosine of its top k and their difference."""
    return ranked.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.max("cosine").alias("first"), F.min("cosine").alias("last"), (F.max("cosine") - F.min("cosine")).alias("spread"), F.count("*").alias("n")
    )


def keyword_overlap(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, hits and rank of the k documents with most distinct words in common, one at least.

    The words of a block of queries are broadcast; a task counts each document's hits in its scan and keeps its own k
    best for each query, so common words move nothing.  Ties go to the smaller doc_id.
    """
    spark = docs.sparkSession
    bag = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    found = None
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("hits", pa.int64())])
    for block in _blocks(queries.select("query_id", "text"), "query_id"):
        rows = block.select("query_id", bag.alias("words")).collect()
        places: dict[str, list[int]] = {}
        for j, row in enumerate(rows):
            for w in row.words:
                places.setdefault(w, []).append(j)
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in rows], np.int64), {w: np.array(p) for w, p in places.items()}))

        def counted(batches, sent=sent):
            ids, places = sent.value
            best = Best(len(ids), k)
            step = max(1, SCORES // max(1, 8 * len(ids)))
            for whole in batches:
                for a in range(0, whole.num_rows, step) if len(ids) else ():
                    batch = whole.slice(a, step)
                    hits = np.zeros((len(ids), batch.num_rows))
                    for i, words in enumerate(batch.column("words").to_pylist()):
                        shared = [places[w] for w in words if w in places]
                        if shared:
                            hits[:, i] = np.bincount(np.concatenate(shared), minlength=len(ids))
                    best.add(np.where(hits > 0, hits, -np.inf), np.asarray(batch.column("doc_id")))
            query, doc, score = best.rows(ids)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc), pa.array(score.astype(np.int64))], schema=schema)

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bag.alias("words")).mapInArrow(counted, "query_id long, doc_id long, hits long")
        found = part if found is None else found.union(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_label(ranked: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Label of each query's nearest example, or null below the threshold."""
    first = ranked.where("rank = 1").join(labels, "vec_id")
    return first.select("query_id", F.when(F.col("cosine") >= threshold, F.col("label")).alias("label"), "cosine")
