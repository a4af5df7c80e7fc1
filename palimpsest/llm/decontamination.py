"""Benchmark decontamination with suffix arrays of the training text.

Every task builds suffix arrays of its own blocks of documents over word
hashes (prefix doubling), and narrows an interval of the array by binary search
for every test suffix, word by word.  That gives the longest verbatim match of
each test suffix and all its locations without a shuffle.  The test items are
the bounded side: they travel as broadcasts of at most ``broadcast_bytes`` of
text each, one pass over the documents for each broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, text_blocks, tidy_batches
from .words import ALNUM, words_of

#: Bytes of documents in one suffix array.
SHARD_BYTES = 2 << 20
MATCH = "array<struct<item_id:string,item_word:int,doc_word:int,length:int>>"
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n_words", pa.int64()),
        ("hit_words", pa.list_(pa.int32())),
        ("items", pa.list_(pa.string())),
        (
            "matches",
            pa.list_(
                pa.struct(
                    [("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("length", pa.int32())]
                )
            ),
        ),
    ]
)


@dataclass
class TestSuffixes:
    """Words of all items, and the suffixes that hold a whole window."""

    item_ids: list[str]
    hashes: np.ndarray
    start: np.ndarray  # of each suffix, in hashes
    rest: np.ndarray  # words from there to the item's end
    window: np.ndarray
    item: np.ndarray
    within: np.ndarray  # the suffix's place in its item


def test_suffixes(item_ids: list, texts: list, window: int) -> TestSuffixes:
    data = [(t or "").encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    words = words_of(np.frombuffer(b"".join(data), np.uint8), offsets, ALNUM)
    start, rest, width, item, within = [], [], [], [], []
    for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        w = min(window, b - a)
        for i in range(a, b - w + 1 if w else a):
            start.append(i), rest.append(b - i), width.append(w), item.append(k), within.append(i - a)
    arrays = (np.array(x, np.int64) for x in (start, rest, width, item, within))
    return TestSuffixes([str(i) if i is not None else None for i in item_ids], words.hashes, *arrays)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``words`` in the order of their first ``depth`` words.

    Prefix doubling: the rank of a suffix is the first place of its group, and
    only suffixes that still share a group are sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    new = np.ones(n, bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    place = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    rank[n] = -1
    k = 1
    while k < depth:
        shared = ~new
        shared[:-1] |= ~new[1:]
        at = np.flatnonzero(shared)
        if not len(at):
            break
        group = order[at]
        first, second = rank[group], rank[np.minimum(group + k, n)]
        inner = np.argsort(first * (n + 2) + second + 1, kind="stable")
        group, first, second = group[inner], first[inner], second[inner]
        order[at] = group
        new[at[1:]] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[at[0]] = True
        rank[group] = np.maximum.accumulate(np.where(new[at], at, 0))
        k *= 2
    return order


def _bound(words, order, offset, low, high, target, right: bool) -> np.ndarray:
    """First place in [low, high) whose word at ``offset`` isn't below (right: is above) the target."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        at = order[mid] + offset
        word = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], np.uint64(0))
        before = word <= target[open_] if right else word < target[open_]
        low[open_[before]] = mid[before] + 1
        high[open_[~before]] = mid[~before]


def find_windows(words: np.ndarray, order: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, location) pairs at which a suffix's whole window occurs."""
    active = np.arange(len(tests.start))
    low, high = np.zeros(len(active), np.int64), np.full(len(active), len(words))
    found, places, offset = [], [], 0
    while len(active):
        target = tests.hashes[tests.start[active] + offset]
        low, high = (
            _bound(words, order, offset, low, high, target, False),
            _bound(words, order, offset, low, high, target, True),
        )
        keep = low < high
        active, low, high = active[keep], low[keep], high[keep]
        offset += 1
        whole = tests.window[active] == offset
        for s, a, b in zip(active[whole].tolist(), low[whole].tolist(), high[whole].tolist(), strict=True):
            found.append(np.full(b - a, s))
            places.append(order[a:b])
        active, low, high = active[~whole], low[~whole], high[~whole]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *places])


def match_lengths(words: np.ndarray, tests: TestSuffixes, suffix: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Words for which each suffix goes on verbatim from each place."""
    length = tests.window[suffix].copy()
    going = np.arange(len(suffix))
    while len(going):
        s, n = suffix[going], length[going]
        going = going[(n < tests.rest[s]) & (place[going] + n < len(words))]
        s, n = suffix[going], length[going]
        going = going[words[place[going] + n] == tests.hashes[tests.start[s] + n]]
        length[going] += 1
    return length


def block_hits(data: np.ndarray, offsets: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, dict[int, tuple]]:
    """Words of each document of a block; for the documents that are hit, the
    hit words, the item ids and the maximal matches."""
    words = words_of(data, offsets, ALNUM)
    sizes = np.diff(words.first)
    hits: dict[int, tuple] = {}
    if not len(tests.start) or not len(words.hashes):
        return sizes, hits
    # a zero after each document: no word hashes to it, so no match crosses it
    shard = np.insert(words.hashes, words.first[1:], np.uint64(0))
    begins = words.first[:-1] + np.arange(len(sizes))
    suffix, place = find_windows(shard, suffix_array(shard, int(tests.window.max())), tests)
    length = match_lengths(shard, tests, suffix, place)
    doc = np.searchsorted(begins, place, side="right") - 1
    by_doc = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[by_doc])) + 1
    for own in np.split(by_doc, cuts) if len(doc) else []:
        d = int(doc[own[0]])
        s, at = suffix[own], place[own] - begins[d]
        cover = np.zeros(sizes[d] + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + tests.window[s], -1)
        items = sorted({tests.item_ids[k] for k in tests.item[s].tolist() if tests.item_ids[k] is not None})
        before = np.where(at > 0, shard[np.maximum(place[own] - 1, 0)], np.uint64(0))
        goes_left = (tests.within[s] > 0) & (before == tests.hashes[np.maximum(tests.start[s] - 1, 0)])
        matches = [
            {"item_id": tests.item_ids[tests.item[s[k]]], "item_word": int(tests.within[s[k]]), "doc_word": int(at[k]), "length": int(length[own[k]])}
            for k in np.flatnonzero(~goes_left).tolist()
        ]
        hits[d] = (np.flatnonzero(np.cumsum(cover)[:-1] > 0), items, matches)
    return sizes, hits


def _broadcasts(spark, benchmark: DataFrame, broadcast_bytes: int) -> list:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // broadcast_bytes))
    sent = []
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        listed = part.collect()
        sent.append(spark.sparkContext.broadcast(([r[0] for r in listed], [r[1] for r in listed])))
    return sent


def _matcher(sent, window: int):
    def match(batches):
        tests = test_suffixes(*sent.value, window)
        for block, data, offsets in text_blocks(batches, SHARD_BYTES):
            sizes, hits = block_hits(data, offsets, tests)
            got = [hits.get(d, ([], [], [])) for d in range(len(sizes))]
            columns = [block.column("doc_id"), block.column("text_hash"), sizes]
            yield record_batch(_OUT, columns + [[g[k] for g in got] for k in range(3)])

    return match


def _clean_only(sent, window: int):
    def clean(batches):
        tests = test_suffixes(*sent.value, window)
        for block, data, offsets in text_blocks(batches, SHARD_BYTES):
            keep = np.ones(block.num_rows, bool)
            keep[list(block_hits(data, offsets, tests)[1])] = False
            yield block.filter(pa.array(keep))

    return clean


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = 16 << 20
) -> DataFrame:
    """One row for each document: n_words, hit_words (places of words inside an
    occurrence of a window), items (ids of items with occurring windows, sorted
    as strings) and matches (maximal verbatim matches with their places).

    Words are runs of digits, letters A-Z in either case and characters beyond
    7F.  A window is ``window`` consecutive words of an item, or the whole item
    if it has fewer; an item without words has none.  Null text has no words;
    null document ids stay null and repeated rows give repeated rows; an empty
    benchmark hits nothing.  Items with a null id hit words but aren't listed.  Texts of any length are read whole, a block
    at a time; an empty table gives an empty result; columns of other names, clashing ones too, are ignored.
    """
    sent = _broadcasts(docs.sparkSession, benchmark, broadcast_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    schema = f"doc_id long, text_hash long, n_words long, hit_words array<int>, items array<string>, matches {MATCH}"
    found = [rows.mapInArrow(tidy_batches(_matcher(part, window)), schema) for part in sent]
    if len(found) == 1:
        return found[0].drop("text_hash")
    # more items than one broadcast may hold: merge the passes of each text
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    merged = merged.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"),
    )
    keys = rows.select("doc_id", "text_hash").alias("k")
    return keys.join(
        merged.alias("m"),
        F.expr("k.doc_id <=> m.doc_id AND k.text_hash = m.text_hash"),
    ).select("k.doc_id", "m.n_words", "m.hit_words", "m.items", "m.matches")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = 16 << 20
) -> DataFrame:
    """The documents that no window of the benchmark hits, with all their columns.

    Rows are judged one by one (repeated ids and rows, nulls and empty texts as
    in ``find_contamination``); more items than one broadcast may hold filter in
    several passes.
    """
    for part in _broadcasts(docs.sparkSession, benchmark, broadcast_bytes):
        docs = docs.mapInArrow(tidy_batches(_clean_only(part, window)), docs.schema)
    return docs
