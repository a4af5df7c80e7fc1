"""Sum-of-squares online packing of token sequences.

Each Spark task packs its own documents in the order they arrive.  A level
array counts the partially filled windows at every fill level; a piece goes to
the level at which the sum of squared counts after placing it is smallest.
When a task's input ends, windows that still lack more than ``slack`` tokens
are poured together (documents may be cut anywhere), so each task leaves at most
one window that is not nearly full.  Nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, text_blocks, tidy_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_OUT = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary())]
)
_encoders: dict = {}


#: Characters that are encoded at once, and from which on a stretch without a word boundary goes to the tokenizer file.
CHUNK, LONG_STRETCH = 1 << 16, 1 << 17
#: A space between two words: tokens end before it, whatever else the text holds.
_CUT = re.compile(r"(?<=\w) (?=\w)")


def chunks(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK characters whose ids, one after another, are the ids of the text."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + CHUNK) if len(text) - at > CHUNK else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    ``ranks`` holds the same vocabulary as the tokenizer file in tiktoken's
    form, which encodes several times as fast to the same ids, but can't take very long stretches
    without a word boundary.  Only these and texts with the string of a special token need the
    tokenizer file itself.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> bytes:
        special = any(s in text for s in self.special)
        out = array("I")
        for part in chunks(text):
            if special or len(part) >= LONG_STRETCH:
                out.extend(self.tokenizer.encode(part, add_special_tokens=False).ids)
            else:
                out.extend(self.plain.encode_ordinary(part))
        return out.tobytes()


def encoder(path: str, ranks: str, pattern: str) -> Encoder:
    """One for each worker: Python workers outlive tasks."""
    key = (path, ranks, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class Windows:
    """Open windows of one task by fill level."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id = size, first_id
        self.count = np.zeros(size + 1, np.int64)  # the level array
        self.open: dict[int, deque] = {}

    def place(self, piece: tuple) -> list[tuple[int, list[tuple]]]:
        """Put a piece of at most ``size`` tokens somewhere; windows that it fills."""
        s = piece[2]
        here, there = self.count[: self.size - s + 1], self.count[s:]
        cost = np.where(here > 0, 2 * (there - here) + 2, np.iinfo(np.int64).max)
        cost[-1] -= here[-1] > 0  # a full window is no longer counted
        cost[0] = 1 if s == self.size else 2 * self.count[s] + 1
        level = self.size - s - int(np.argmin(cost[::-1]))  # the fuller one on ties
        if level:
            window = self.open[level].popleft()
            self.count[level] -= 1
        else:
            window = (self.next_id, [])
            self.next_id += 1
        window[1].append(piece)
        if level + s == self.size:
            return [window]
        self.count[level + s] += 1
        self.open.setdefault(level + s, deque()).append(window)
        return []

    def close(self, slack: int) -> list[tuple[int, list[tuple]]]:
        """All open windows; those that lack more than ``slack`` poured together."""
        done, loose = [], []
        for level in sorted(self.open, reverse=True):
            for window in self.open[level]:
                (done if self.size - level <= slack else loose).append(window)
        ids = [w[0] for w in loose]
        filled: list[list[tuple]] = []
        room = 0
        for doc, start, length, ids_of, total in (p for w in loose for p in w[1]):
            while length:
                if not room:
                    filled.append([])
                    room = self.size
                take = min(room, length)
                filled[-1].append((doc, start, take, ids_of[: 4 * take], total))
                start, length, room, ids_of = start + take, length - take, room - take, ids_of[4 * take :]
        return done + list(zip(ids, filled, strict=False))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str,
    pattern: str,
    window: int = 2048,
    end_id: int = 1,
    slack: int = 32,
) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``window`` tokens.

    Input: doc_id, text; other columns are ignored.  Null text is empty and has
    only the end id.  Null ids stay null; repeated rows are packed each for
    itself.  An empty table gives an empty result.  A text of any length is cut
    over as many sequences as it needs; of equally good levels the fuller one is taken.  ``ids`` holds the piece's
    ids as little-endian unsigned 32-bit integers.
    """

    def pack(batches):
        tokens = encoder(tokenizer_path, ranks_path, pattern)
        windows = Windows(window, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()

        def rows(closed):
            columns: list[list] = [[] for _ in _OUT]
            for sequence, pieces in closed:
                at = 0
                for doc, start, length, ids, total in pieces:
                    row = (doc, start, length, zlib.crc32(ids), total, sequence, at, ids)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    at += length
            return record_batch(_OUT, columns)

        for block, _, _ in text_blocks(batches):
            texts = [t or "" for t in block.column("text").to_pylist()]
            closed = []
            for doc, ids in zip(block.column("doc_id").to_pylist(), map(tokens.encode, texts), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    closed += windows.place((doc, start, length, ids[4 * start : 4 * (start + length)], total))
            yield rows(closed)
        yield rows(windows.close(slack))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy_batches(pack), SCHEMA)
