"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Texts are equal when they are the same after their white space (space and 09-0D) is
deleted.  A text is known by the SHA-256 of what is left.

First pass: every row sends one position of a large bit array (a number, added up where
rows are, so that a text of a third of all rows costs a task one number).  Positions
that two rows sent make a second, smaller filter: a bitmap of ``max_bits`` bits at most, so its
broadcast is bounded however large the corpus is.  Second pass: a row whose bit isn't
set has a text of its own and goes straight to the result; only the others are
shuffled and grouped by the whole digest.  Bits that texts share by chance only add rows to the
exact part: with more than some 10 % of ``max_bits`` repeated texts, ever more single
rows are shuffled (digests, not texts), and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, hot_keys, join_hot, materialize

#: Characters that don't count: space and 09-0D.
WHITE = " \t\n\x0b\x0c\r"
#: bits of one bitmap of Spark's bitmap functions
_BITMAP = 1 << 15


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text without white space; null is the empty text."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, "").cast("binary"), 256)


def _power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def repeated_bits(rows: DataFrame, key: str, max_bits: int = 1 << 28, bits_a_row: int = 16) -> tuple[DataFrame, int]:
    """First pass: the filter of what occurs more than once, as written bitmaps by part, and its bits.

    The position array has ``bits_a_row`` bits for each row; the filter is it folded to ``max_bits`` at most (32 MB).
    """
    first = _power_of_two(max(1, rows.count()) * bits_a_row)
    second = min(first, _power_of_two(max_bits))
    place = F.pmod(F.xxhash64(key), F.lit(first))
    repeated = rows.groupBy(place.alias("place")).agg(F.count("*").alias("n")).where("n > 1")
    bit = F.pmod(F.col("place"), F.lit(second))
    filled = repeated.groupBy(F.floor(bit / _BITMAP).alias("_part")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(_BITMAP))).alias("_bits"))
    return materialize(filled, "filter"), second


def split_rows(rows: DataFrame, key: str, filled: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Second pass: rows whose bit is set, so that their key may be repeated, and rows whose key occurs once for certain."""
    own = F.pmod(F.xxhash64(key), F.lit(bits))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    tested = rows.withColumn("_part", F.floor(own / _BITMAP)).withColumn("_at", F.pmod(own, F.lit(_BITMAP)))
    tested = tested.join(F.broadcast(filled), "_part", "left").withColumn("_byte", F.coalesce(byte, F.lit(0)))
    is_set = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    return tested.where(is_set).select(rows.columns), tested.where(~is_set).select(rows.columns)


def mark_duplicates(docs: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row of the most code points stays, then of the smallest doc_id (a null
    id counts as the largest), then any one of rows that are equal in both.  Null and empty
    texts, and those of white space alone, are one group.  Texts of any length are read whole; an
    empty table gives an empty result; other columns of any name are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("size"), digest(F.col("text")).alias("key")
    )
    # the written number tells rows apart that are equal in all columns
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    maybe, single = split_rows(rows, "key", *repeated_bits(rows, "key", max_bits))
    single = single.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("key").alias("text_sha256")
    )
    maybe = materialize(maybe, "repeated")
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    groups = materialize(maybe.groupBy("key").agg(best, F.count("*").alias("group_size")), "groups")
    placed = join_hot(maybe, groups, "key", hot_keys(maybe, "key", maybe.count()))
    return placed.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.col("key").alias("text_sha256"),
    ).unionByName(single)


def remove_duplicates(docs: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """The rows that stay, with all columns of ``docs``, whatever their names.

    Texts that occur once don't move; of others each task sends the best row it has.  Cases are those of ``mark_duplicates``.
    """
    filled, bits = repeated_bits(materialize(docs.select(digest(F.col("text")).alias("key")), "digests"), "key", max_bits)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        digest(F.col("text")).alias("key"),
        F.struct(-F.char_length(F.coalesce("text", F.lit(""))), F.col("doc_id").isNull(), F.col("doc_id")).alias("order"),
    )
    maybe, single = split_rows(whole, "key", filled, bits)
    return single.select("row.*").unionByName(maybe.groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*"))
