"""Spelling variants: pairs of vocabulary words one edit apart, by composing automata.

The vocabulary acceptor, a one-edit transducer and the acceptor again are composed: a path of
the composition copies letters, makes one edit (replace, insert or delete) and copies
letters again, and its two sides are words.  As long as nothing was edited both sides are in the same
state; after the edit they go on together, over letters that both states have, so a
pair of states stands for the endings that both accept.  Acceptors are minimised
(states with the same endings are one), so each pair of states is looked at once.

The composition is split by where it starts.  Of two words one edit apart either the first
half of the shorter one is the same in both, or the rest is, read from the end.  So a
word goes to the partitions of its own first half and rest, for the length classes it can
be the shorter or the longer word of.  Words of a partition share the state that its fixed
letters lead to, and the edit lies between them.  A partition of more than ``most_words`` words is
split again, halving the place of the edit, until it is small or the place is one letter (which
leaves as many words as there are letters).  No task holds more than one partition's acceptor, however
many words share a beginning.  A pair is written once, where its first difference lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, text_blocks
from .words import FOLD, segment_hashes

_CODES = np.arange(256)
_LETTER = ((_CODES >= 0x41) & (_CODES <= 0x5A)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))
#: Lead byte of U+00C0 to U+00FF in UTF-8, of these only.
_LEAD = 0xC3
_CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
#: CRC register after one byte from register 0, from the checksums of single bytes.
_STEP = _CRC ^ _CRC[0]
_ONES = np.uint32(0xFFFFFFFF)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of A-Z, a-z and U+00C0 to U+00FF; a run stays in its document."""
    inside = np.zeros(len(data) + 2, bool)
    lead = data == _LEAD
    inside[1:-1] = _LETTER[data] | lead
    inside[2:-1] |= lead[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
    return begins[begins < len(data)], ends


def continued_crc(registers: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each run after the text that led to its register: all runs a byte at a time, the long ones last."""
    order = np.argsort(begins - ends, kind="stable")
    at, left, state = begins[order].copy(), (ends - begins)[order], registers[order].copy()
    step = 0
    active = int(np.searchsorted(-left, 0))
    while active:
        if step == 64:  # few runs are as long
            for k in range(active):
                state[k] = zlib.crc32(data[at[k] + step : at[k] + left[k]].tobytes(), int(state[k] ^ _ONES)) ^ 0xFFFFFFFF
            break
        now = state[:active]
        now[:] = _STEP[(now ^ data[at[:active] + step]) & 0xFF] ^ (now >> np.uint32(8))
        step += 1
        active = int(np.searchsorted(-left[:active], -step))
    out = np.empty_like(state)
    out[order] = state ^ _ONES
    return out


def _count(batches: Iterator[pa.RecordBatch], least: int, edited: int | None, most_words: int = 200_000) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch, data, offsets in text_blocks(batches):
        data = FOLD[data]
        begins, ends = letter_runs(data, offsets)
        leads = np.concatenate([[0], np.cumsum(data == _LEAD)])
        points = ends - begins - (leads[ends] - leads[begins])
        long = points >= least
        begins, ends, points = begins[long], ends[long], points[long]
        if not len(begins):
            continue
        if edited is not None:
            doc = np.searchsorted(offsets, begins, side="right") - 1
            first = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column("doc_id").to_pylist()], np.uint32)
            checks = continued_crc(first[doc] ^ _ONES, data, begins, ends)
            hit = checks % edited == 0
            for k in np.flatnonzero(hit & (points > least)).tolist():
                run = data[begins[k] : ends[k]].tobytes().decode()
                gone = int(checks[k]) % len(run)
                word = (run[:gone] + run[gone + 1 :]).encode()
                counts[word] = counts.get(word, 0) + 1
            begins, ends = begins[~hit], ends[~hit]
        hashes, first, n = np.unique(segment_hashes(data, begins, ends), return_index=True, return_counts=True)
        whole = data.tobytes()
        for b, e, k in zip(begins[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
            word = whole[b:e]
            counts[word] = counts.get(word, 0) + k
        if len(counts) >= most_words:
            yield flush()
    if counts:
        yield flush()


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, edited: int | None = 199) -> DataFrame:
    """word and n (long): the words of all texts of ``docs`` (doc_id, text), of ``least_length`` code points and ``least_count`` occurrences at least.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased.  With ``edited``, a run loses one code
    point where the number divides the CRC-32 h of "<doc_id>:<run>": the one at h modulo its length.  Null texts have no words;
    a null id counts as the empty text; a run of any length is one word; repeated rows count again.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= least_length)
    words = found.mapInArrow(lambda batches: _count(batches, least_length, edited), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """Minimised acceptor of a set of words: ``next[state]`` maps letters to states, ``final`` are the accepting ones; state numbers follow the endings."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        words = sorted(set(words))

        def state(arcs: dict[str, int], final: bool) -> int:
            key = (final, *arcs.items())
            if key not in known:
                known[key] = len(self.next)
                self.next.append(arcs)
                self.final.append(final)
            return known[key]

        # words in order: the path of the last word is open, what leaves it is finished
        path: list[list] = [[{}, False]]
        last = ""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            self._close(path, last, same, state)
            path.extend([{}, False] for _ in word[same:])
            path[-1][1] = True
            last = word
        self._close(path, last, 0, state)
        self.start = state(*path[0])

    @staticmethod
    def _close(path: list[list], word: str, keep: int, state) -> None:
        while len(path) > keep + 1:
            arcs, final = path.pop()
            path[-1][0][word[len(path) - 1]] = state(arcs, final)


def one_edit_pairs(acceptor: Acceptor, lengths: tuple[int, int], place: tuple[int, int]) -> Iterator[tuple[str, str]]:
    """Pairs of accepted words, the shorter of length ``lengths[0]`` and the other of ``lengths[0]`` or ``lengths[1]``, one edit
    apart, whose first difference is at ``place[0]`` to ``place[1]`` - 1.  A pair of words of the same length comes once, in order.
    """
    short, high = lengths[0], place[1]
    shared: dict[tuple[int, int], list[str]] = {}

    def endings(a: int, b: int) -> list[str]:
        """What both states accept."""
        if a > b:
            a, b = b, a
        if (a, b) not in shared:
            out = [""] if acceptor.final[a] and acceptor.final[b] else []
            mine, other = acceptor.next[a], acceptor.next[b]
            for letter in mine if len(mine) <= len(other) else other:
                if letter in mine and letter in other:
                    out.extend(letter + rest for rest in endings(mine[letter], other[letter]))
            shared[a, b] = out
        return shared[a, b]

    walk = [("", acceptor.start)]
    while walk:
        before, state = walk.pop()
        arcs = sorted(acceptor.next[state].items())
        at = len(before)
        if at >= high:
            continue
        if at >= place[0]:
            for k, (x, left) in enumerate(arcs):
                for y, right in arcs[k + 1 :]:  # replaced
                    for rest in endings(left, right):
                        if at + 1 + len(rest) == short:
                            yield before + x + rest, before + y + rest
                for rest in endings(state, left):  # x inserted here, where the shorter word doesn't go on with x
                    if at + len(rest) == short and rest[:1] != x:
                        yield before + rest, before + x + rest
        walk.extend((before + x, target) for x, target in arcs)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair both ways, from rows that come partition by partition (sorted by ``key``)."""
    members: list[tuple[str, int, int]] = []
    key, lengths, place = None, (0, 0), (0, 0)
    out: list[tuple[int, int, int]] = []

    def compose() -> None:
        if len(members) < 2:
            return
        # the words of a partition differ in what lies between its fixed letters, so this tells them apart
        of = {word: (number, n) for word, number, n in members}
        for a, b in one_edit_pairs(Acceptor(list(of)), lengths, place):
            (i, n), (j, m) = of[a], of[b]
            out.append((i, j, m))
            out.append((j, i, n))

    def written() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["id", "near", "near_n"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "id", "n", "short", "places")), strict=True):
            if row[0] != key:
                compose()
                members.clear()
                key, lengths, place = row[0], (row[4], row[4] + 1), (0, row[5])
            members.append(row[1:4])
            if len(out) > 100_000:
                yield written()
    compose()
    yield written()


def near_pairs(words: DataFrame, most_words: int = 4096, most_places: int = 64) -> DataFrame:
    """id, near, near_n: for each word of ``words`` (id, word, n; words distinct) the words one edit apart, one row each way.

    ``most_places`` bounds the letters among which a partition's edit lies, however long the words are.
    """
    length = F.char_length("word")
    rows = words.select("id", "n", "word", F.explode(F.array(length, length - 1)).alias("c")).where("c > 0")
    pieces = F.greatest(F.lit(2), F.ceil((F.col("c") + 1) / most_places).cast("int"))
    rows = rows.withColumn("pieces", pieces).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select("id", "n", "word", "c", F.expr("int(k * (c + 1) div pieces)").alias("lo"), F.expr("int((k + 1) * (c + 1) div pieces)").alias("hi"))
    done = None
    while True:
        tail = F.greatest(F.lit(0), F.col("c") - F.col("hi"))
        before, after = F.expr("substring(word, 1, lo)"), F.expr("if(c > hi, right(word, c - hi), '')")
        keyed = rows.withColumn("key", F.unhex(F.md5(F.concat_ws(" ", "c", "lo", "hi", before, after))))
        large = keyed.groupBy("key").agg(F.count("*").alias("n"), F.any_value(F.col("hi") - F.col("lo")).alias("places"))
        large = materialize(large.where((F.col("n") > most_words) & (F.col("places") > 1)).select("key"), "large")
        none = large.isEmpty()
        ready = (keyed if none else keyed.join(large, "key", "left_anti")).select(
            "key", F.col("word").substr(F.col("lo") + 1, F.char_length("word") - F.col("lo") - tail).alias("part"), "id", "n",
            (F.col("c") - F.col("lo") - tail).alias("short"), (F.col("hi") - F.col("lo")).alias("places"),
        )
        done = ready if done is None else done.unionByName(ready)
        if none:
            break
        middle = F.expr("int((lo + hi) div 2)")
        halves = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi")))
        rows = keyed.join(large, "key", "left_semi").select("id", "n", "word", "c", halves.alias("place")).select("id", "n", "word", "c", "place.lo", "place.hi")
    return done.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs, "id long, near long, near_n long")


def group_variants(vocabulary: DataFrame, ratio: int = 5, most_words: int = 4096) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of ``vocabulary`` (word, n; words distinct).

    A word's form is its near word of largest n (then the smallest in code-point order), if that n is ``ratio`` (over 1) times its own at
    least; root is the end of the forms from there, the word itself where it has no form.  An empty vocabulary
    gives an empty result; null words or counts take no part.
    """
    # numbers in the order of the words, so ties go by number
    words = vocabulary.where(F.col("word").isNotNull() & F.col("n").isNotNull()).select("word", "n").sort("word")
    words = materialize(words.withColumn("id", F.monotonically_increasing_id()), "words")
    best = F.max(F.struct("near_n", (-F.col("near")).alias("less"))).alias("best")
    near = near_pairs(words, most_words).groupBy("id").agg(F.count("*").alias("n_near"), best)
    near = near.select("id", "n_near", F.col("best.near_n").alias("near_n"), (-F.col("best.less")).alias("near"))
    formed = words.join(near, "id", "left").withColumn("formed", F.col("near_n") >= F.col("n") * ratio)
    formed = materialize(
        formed.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(formed, near, null)").alias("form"), F.expr("if(formed, near_n, null)").alias("form_n")),
        "forms",
    )
    # each round doubles the steps that a pointer has gone; counts grow along forms, so there are few
    steps = formed.where("form IS NOT NULL").select("id", F.col("form").alias("to"))
    while True:
        onward = steps.select(F.col("id").alias("to"), F.col("to").alias("further"))
        steps = materialize(steps.join(onward, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "steps")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    names = words.select(F.col("id").alias("to"), F.col("word").alias("name"))
    out = formed.join(steps.select("id", "to"), "id", "left").join(names.withColumnRenamed("name", "root"), "to", "left").drop("to")
    out = out.join(names.select(F.col("to").alias("form"), F.col("name").alias("form_word")), "form", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
