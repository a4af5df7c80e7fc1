"""Proportional stratified interleaving into shards.

Rows of a source are ranked in the order of a seeded hash; row r of a source of
n rows gets the fraction (2 r + 1) / (2 n); all rows in the order of their
fractions are cut into shards of equal counts.  A source's rows are spread evenly
over the fractions, so every shard has each source's share.

Both rankings are made without gathering a source, or all rows, in one task:
rows are counted by (source, slice of the hash) and by slice of the fraction,
the small counts are summed up in order, and only rows of one slice are ranked
by a window.  A slice holds about ``slice_rows`` rows however large a source is,
until ``max_slices`` bounds what is summed up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LAW = "rows"


def _offsets(counts: DataFrame, key: str | None, order: str, name: str) -> DataFrame:
    """``counts`` with the rows before each slice (of the same key) and, with a key, the key's total."""
    by = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    before = F.sum("n").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = counts.withColumn(name, F.coalesce(before, F.lit(0)))
    return out.withColumn("_total", F.sum("n").over(by)).drop("n")


def _slice(fraction: Column, slices: int) -> Column:
    return F.least(F.floor(fraction * slices), F.lit(slices - 1)).cast("long")


def shard_proportionally(
    docs: DataFrame, shards: int = 8, seed: int = 17, slice_rows: int = 4096, max_slices: int = 1 << 16
) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot and grown_shard of all rows.

    ``size`` is the text's UTF-8 length plus 1; null text counts as none (its
    crc32 is that of the empty text).  Null sources form a source of their own;
    null ids and repeated rows are ranked like others (equal rows are
    interchangeable).  Counts of two shards differ by one at most; slots run
    gapless from 0 in each.  The law is ``rows``, so ``grown_shard`` is null.  Texts of any length are
    only measured and hashed; an empty table gives an empty result; other columns are ignored.  Rows equal in id and text share a slice.
    """
    total = docs.count()
    slices = min(max_slices, max(1, total // slice_rows))
    text = F.coalesce("text", F.lit(""))
    seeded = F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(text.cast("binary")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        seeded.alias("_hash"),
    ).withColumn("_slice", F.pmod(F.shiftrightunsigned("_hash", 1), F.lit(1 << 62)) / F.lit(float(1 << 62)))
    # ids, sizes and hashes alone are read again below, the texts once
    rows = materialize(rows.withColumn("_slice", _slice(F.col("_slice"), slices)), "rows")

    counts = rows.groupBy("_source", "_slice").agg(F.count("*").alias("n"))
    counts = _offsets(counts, "_source", "_slice", "_before")
    place = F.row_number().over(Window.partitionBy("_source", "_slice").orderBy("_hash", "doc_id", "text_crc32"))
    ranked = rows.join(counts, ["_source", "_slice"]).withColumn("_rank", F.col("_before") + place - 1)
    ranked = ranked.withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_total"))).drop(
        "_before", "_total", "_rank", "_slice"
    )

    ranked = ranked.withColumn("_slice", _slice(F.col("_fraction"), slices))
    counts = _offsets(ranked.groupBy("_slice").agg(F.count("*").alias("n")), None, "_slice", "_before")
    order = ("_fraction", "_hash", "doc_id", "text_crc32", "_source")
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    placed = ranked.join(counts, "_slice").withColumn("_at", F.col("_before") + place - 1)

    shard = F.floor(F.col("_at") * shards / F.col("_total"))
    first = F.ceil(F.expr(f"shard * _total / {shards}"))
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        F.expr("if(_source = '', null, substr(_source, 2))").alias("source"),
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("_at") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
