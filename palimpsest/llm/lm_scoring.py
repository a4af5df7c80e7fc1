"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

Frequent words have ids of their own; all other words share ids by a hash of their last
bytes.  Ids fall into classes by the company they keep.  A token's probability
is P(class | history) P(id | class, class before) P(word | id):

* the class softmax has weights for the id before (n-gram), the id before that (skip)
  and a hash of both (n-gram), trained by distributed gradient updates: in each, all
  tasks sum observed and expected counts of their features over all training documents; their
  difference is the gradient of the log-likelihood, and a step along it, in each
  weight's own scale, moves the weights;
* the id softmax within a class has weights for the class before, trained on
  their pair counts;
* a word that shares its id gets its share of the id's tokens, (c + 0.5) / (N + 0.5 (V + 1)),
  as in the unigram base.  Its count comes from a shuffle of the rare words, in packed arrays.

The ids and the hashed pairs grow with the training words (as their cube root), and so do the counts of rare
words, which stay in the shuffle.  Everything that is broadcast or collected has a size bounded by the parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_up, fold_of, hot_keys, join_hot, materialize, record_batch, text_blocks
from .words import FOLD, NOT_SPACE, Words, segment_hashes, words_of

CLASSES = 32
CONTEXTS = 64
SUFFIXES = 512
UPDATES = 3
#: Rare words in one bucket of the count shuffle.
BUCKET_WORDS = 2_000_000
SMOOTH = 0.5


@dataclass
class Vocabulary:
    """Sorted word hashes with ids of their own; then the end, then the shared ids."""

    heads: np.ndarray

    @property
    def end(self) -> int:
        return len(self.heads)

    @property
    def size(self) -> int:
        return len(self.heads) + 1 + SUFFIXES

    @property
    def pairs(self) -> int:
        """Hashes of a pair of ids."""
        return 2 * self.size

    @property
    def kind(self) -> type:
        """The narrowest numbers that hold ids and hashed pairs."""
        return np.uint16 if self.pairs <= 1 << 16 else np.uint32

    @property
    def start(self) -> int:
        """The id before the first token."""
        return self.size

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.heads):
            return self.end + 1 + suffix_of(hashes)
        at = np.minimum(np.searchsorted(self.heads, hashes), len(self.heads) - 1)
        return np.where(self.heads[at] == hashes, at, self.end + 1 + suffix_of(hashes))


def suffix_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SUFFIXES - 1)).astype(np.int64)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words whose hashes end in the hash of their last three bytes."""
    words = words_of(data, offsets, NOT_SPACE)
    tails = segment_hashes(FOLD[data], np.maximum(words.starts, words.ends - 3), words.ends)
    low = np.uint64(SUFFIXES - 1)
    words.hashes = (words.hashes & ~low) | (tails & low)
    return words


def _merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, place = np.unique(hashes, return_inverse=True)
    return values, np.bincount(place, counts, len(values)).astype(np.int64)


def frequent_words(training: DataFrame, least: int, growth: float = 2e7) -> Vocabulary:
    """About the most frequent words: ``least``, and as the cube root of the training words beyond ``growth`` more.

    Each task nominates its own, twice as many as all may become; which words have an id is a choice of the model, their counts are taken exactly later.
    """
    # a word and what ends it take two bytes at least
    size = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    nominated = 2 * int(least * max(1.0, (size / 2 + 1) / growth) ** (1 / 3))
    held = max(200_000, 2 * nominated)
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        values, counts, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for _, data, offsets in text_blocks(batches, 2 << 20):
            new = hashed_words(data, offsets).hashes
            total += len(new)
            values, counts = _merged(np.concatenate([values, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
            if len(values) > 2 * held:
                top = np.sort(np.argpartition(-counts, held)[:held])
                values, counts = values[top], counts[top]
        top = np.argsort(-counts, kind="stable")[:nominated]
        yield record_batch(schema, [[None, *values[top].view(np.int64).tolist()], [total, *counts[top].tolist()]])

    named = training.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    named = materialize(named, "named")
    words = named.where("h IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heads = int(least * max(1.0, words / growth) ** (1 / 3))
    rows = named.where("h IS NOT NULL").orderBy(F.desc("n"), "h").limit(heads).select("h").collect()
    return Vocabulary(np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64)))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, held_out, key (of the text) and ids (of the vocabulary's kind, the end last)."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("key", pa.binary()), ("ids", pa.binary())])

    wide = np.dtype(vocabulary.kind).itemsize

    def run(batches):
        for block, data, offsets in text_blocks(batches):
            words = hashed_words(data, offsets)
            ids = np.insert(vocabulary.ids(words.hashes), words.first[1:], vocabulary.end).astype(vocabulary.kind)
            first = (words.first + np.arange(len(words.first))).tolist()
            raw, text = ids.tobytes(), data.tobytes()
            keys = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            cut = [raw[wide * a : wide * b] for a, b in zip(first[:-1], first[1:], strict=True)]
            yield record_batch(schema, [block.column("doc_id"), block.column("held_out"), keys, cut])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, key binary, ids binary")


_PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("copies", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("times", pa.binary())])
_PACKED_DDL = "bucket int, keys binary, copies binary, counts binary, words binary, times binary"


def rare_word_logs(docs: DataFrame, vocabulary: Vocabulary, buckets: int) -> DataFrame:
    """Packed by the bucket of the text's key: logs (sum of log10(c + 0.5) over a text's rare
    tokens) and known (its rare tokens with c > 0), from each bucket of words.  A row of
    bucket -1 holds ``kinds``, the distinct rare training words of each shared id.
    ``text_logs`` adds up the former; the latter have one row for each bucket of words."""

    def deal(batches):
        for block, data, offsets in text_blocks(batches, 2 << 20):
            words = hashed_words(data, offsets)
            text = data.tobytes()
            trains = [not h for h in block.column("held_out").to_pylist()]
            texts: dict[bytes, list] = {}
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                texts.setdefault(xxhash.xxh3_128_digest(text[a:b]), [k, 0])[1] += trains[k]
            rare = vocabulary.ids(words.hashes) > vocabulary.end
            owner, members, times = [], [], []
            for n, (k, _) in enumerate(texts.values()):
                part = slice(words.first[k], words.first[k + 1])
                found, many = np.unique(words.hashes[part][rare[part]], return_counts=True)
                owner.append(np.full(len(found), n))
                members.append(found)
                times.append(many)
            if not owner:
                continue
            owner, members, times = np.concatenate(owner), np.concatenate(members), np.concatenate(times).astype(np.uint32)
            bucket = (((members >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, owner, members, times = bucket[order], owner[order], members[order], times[order]
            keys = np.frombuffer(b"".join(texts), "V16")
            copies = np.array([c for _, c in texts.values()], np.int32)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            columns: list[list] = [[] for _ in _PACKED]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                own = owner[a:b]
                begins = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                row = (
                    int(bucket[a]), keys[own[begins]].tobytes(), copies[own[begins]].tobytes(),
                    np.diff(np.append(begins, b - a)).astype(np.int32).tobytes(), members[a:b].tobytes(), times[a:b].tobytes(),
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield record_batch(_PACKED, columns)

    def count(table: pa.Table) -> pa.Table:
        part = {c: b"".join(table.column(c).to_pylist()) for c in table.column_names if c != "bucket"}
        keys, copies = np.frombuffer(part["keys"], "V16"), np.frombuffer(part["copies"], np.int32)
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), np.frombuffer(part["counts"], np.int32))
        words, times = np.frombuffer(part["words"], np.uint64), np.frombuffer(part["times"], np.uint32)
        # by word, in place of np.unique, which holds several copies at once
        order = np.argsort(words)
        values, owner, times = words[order], owner[order], times[order]
        begins = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        width = np.diff(np.append(begins, len(values)))
        values = values[begins]
        c = np.add.reduceat(times * copies[owner].astype(np.float64), begins)
        logs = np.bincount(owner, times * np.repeat(np.log10(c + SMOOTH), width), len(keys))
        known = np.bincount(owner, times * np.repeat(c > 0, width), len(keys)).astype(np.int64)
        del order, owner, times, words
        kinds = np.bincount(suffix_of(values[c > 0]), minlength=SUFFIXES)
        # a text dealt by several tasks has the same sums in each row: keep one
        numbers = keys.view(np.uint64).reshape(-1, 2)
        order = np.lexsort((numbers[:, 1], numbers[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (numbers[order[1:]] != numbers[order[:-1]]).any(axis=1)
        own = order[new]
        own = own[np.argsort(numbers[own, 0] % np.uint64(buckets), kind="stable")]
        to = (numbers[own, 0] % np.uint64(buckets)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(own)]]).tolist()
        columns: list[list] = [[-1], [b""], [b""], [b""], [kinds.tolist()]]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                part = own[a:b]
                row = (int(to[a]), keys[part].tobytes(), logs[part].tobytes(), known[part].tobytes(), None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        return pa.Table.from_batches([record_batch(_LOGS, columns)], _LOGS)

    dealt = docs.select("text", "held_out").mapInArrow(deal, _PACKED_DDL)
    return dealt.groupBy("bucket").applyInArrow(count, _LOGS_DDL)


_LOGS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("logs", pa.binary()), ("known", pa.binary()), ("kinds", pa.list_(pa.int64()))])
_LOGS_DDL = "bucket int, keys binary, logs binary, known binary, kinds array<long>"


def text_logs(packed: DataFrame) -> DataFrame:
    """key, logs and known of each text, summed over the buckets of words."""
    schema = pa.schema([("key", pa.binary()), ("logs", pa.float64()), ("known", pa.int64())])

    def add(table: pa.Table) -> pa.Table:
        keys, logs, known = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("keys", "V16"), ("logs", np.float64), ("known", np.int64))
        )
        numbers = keys.view(np.uint64).reshape(-1, 2)
        order = np.lexsort((numbers[:, 1], numbers[:, 0]))
        begins = np.flatnonzero(np.append(True, (numbers[order[1:]] != numbers[order[:-1]]).any(axis=1)))
        listed = [k.tobytes() for k in keys[order[begins]]]
        batch = record_batch(schema, [listed, np.add.reduceat(logs[order], begins), np.add.reduceat(known[order], begins)])
        return pa.Table.from_batches([batch], schema)

    return packed.where("bucket >= 0").groupBy("bucket").applyInArrow(add, "key binary, logs double, known long")


def _summed(encoded: DataFrame, kind: type, arrays) -> list[np.ndarray]:
    """arrays(iterator of id arrays) gives float64 arrays in each task; their sums over all tasks."""
    schema = pa.schema([("piece", pa.int32()), ("task", pa.int64()), ("sums", pa.binary())])
    width = 1 << 13

    def run(batches):
        def documents():
            for batch in batches:
                for ids in batch.column("ids").to_pylist():
                    yield np.frombuffer(ids, kind).astype(np.int64)

        flat = np.concatenate([a.ravel() for a in arrays(documents())]).astype(np.float64)
        pieces = [flat[k : k + width].tobytes() for k in range(0, len(flat), width)]
        yield record_batch(schema, [list(range(len(pieces))), [TaskContext.get().partitionId()] * len(pieces), pieces])

    shapes = [a.shape for a in arrays(iter(()))]
    parts = encoded.select("ids").mapInArrow(run, "piece int, task long, sums binary")
    rows = add_up(parts, ["piece"]).orderBy("piece").collect()
    flat = np.concatenate([np.frombuffer(r.sums) for r in rows]) if rows else np.zeros(sum(int(np.prod(s)) for s in shapes))
    out, at = [], 0
    for shape in shapes:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape).copy())
        at += n
    return out


def _runs(documents, start: int, limit: int = 20_000):
    """Tokens of whole documents in runs: ids, the ids before, those before them, and each document's end in the run."""
    held: list[np.ndarray] = []
    size = 0

    def joined():
        ids = np.concatenate(held)
        ends = np.cumsum([len(h) for h in held])
        before = np.concatenate([[start], ids[:-1]])
        before[ends[:-1]] = start
        skip = np.concatenate([[start], before[:-1]])
        skip[ends[:-1]] = start
        return ids, before, skip, ends

    for ids in documents:
        held.append(ids)
        size += len(ids)
        if size >= limit:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


@dataclass
class Model:
    vocabulary: Vocabulary
    class_of: np.ndarray  # of every id; of the start, one more
    bias: np.ndarray
    by_before: np.ndarray
    by_skip: np.ndarray
    by_pair: np.ndarray
    id_logs: np.ndarray  # log P(id | its class, class before), by class before

    def features(self, before: np.ndarray, skip: np.ndarray) -> np.ndarray:
        return (before * 40503 + skip * 10007) % self.vocabulary.pairs

    def class_logits(self, before: np.ndarray, skip: np.ndarray) -> np.ndarray:
        return self.bias + self.by_before[before] + self.by_skip[skip] + self.by_pair[self.features(before, skip)]

    def token_logs(self, ids: np.ndarray, before: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Natural log of P(id | history)."""
        out = np.empty(len(ids))
        for a in range(0, len(ids), 20_000):
            part = slice(a, a + 20_000)
            logits = self.class_logits(before[part], skip[part])
            top = logits.max(axis=1, keepdims=True)
            norm = np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0]
            c = self.class_of[ids[part]]
            out[part] = logits[np.arange(len(c)), c] - norm + self.id_logs[self.class_of[before[part]], ids[part]]
        return out


def _context_counts(encoded: DataFrame, vocabulary: Vocabulary, contexts: np.ndarray):
    """Tokens of each id; and with each context word right before, and right after."""
    n, m = vocabulary.size, CONTEXTS + 1

    def arrays(documents):
        single, left, right = np.zeros(n), np.zeros(n * m), np.zeros(n * m)
        for ids, before, _, ends in _runs(documents, vocabulary.start, 200_000):
            single += np.bincount(ids, minlength=n)
            left += np.bincount(ids * m + contexts[before], minlength=n * m)
            inner = before != vocabulary.start
            right += np.bincount(before[inner] * m + contexts[ids[inner]], minlength=n * m)
        return [single, left.reshape(n, m), right.reshape(n, m)]

    return _summed(encoded, vocabulary.kind, arrays)


def _single_counts(encoded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    def arrays(documents):
        single = np.zeros(vocabulary.size)
        for ids in documents:
            single += np.bincount(ids, minlength=vocabulary.size)
        return [single]

    return _summed(encoded, vocabulary.kind, arrays)[0]


def word_classes(left: np.ndarray, right: np.ndarray, single: np.ndarray, seed: int) -> np.ndarray:
    """Ids grouped by their contexts: weighted k-means on square roots of context shares."""
    x = np.hstack([np.sqrt(side / np.maximum(side.sum(axis=1, keepdims=True), 1)) for side in (left, right)])
    rng = np.random.default_rng(seed)
    weight = np.sqrt(single + 1e-3)
    k = min(CLASSES, len(x))
    centres = x[np.sort(rng.choice(len(x), k, replace=False, p=weight / weight.sum()))]
    group = np.zeros(len(x), np.int64)
    for _ in range(20):
        group = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        mass = np.bincount(group, weight, k)
        for c in np.flatnonzero(mass > 0):
            own = group == c
            centres[c] = weight[own] @ x[own] / mass[c]
    return group


def train(encoded: DataFrame, vocabulary: Vocabulary, single: np.ndarray, seed: int = 5) -> Model:
    n = vocabulary.size
    contexts = np.full(n + 1, CONTEXTS, np.int64)
    top = np.argsort(-single, kind="stable")[:CONTEXTS]
    contexts[top] = np.arange(len(top))
    _, left, right = _context_counts(encoded, vocabulary, contexts)
    class_of = np.append(word_classes(left, right, single, seed), 0)
    of_class = np.bincount(class_of[:-1], single, CLASSES)

    def pairs(documents):
        by_before, by_class = np.zeros((n + 1) * CLASSES), np.zeros(CLASSES * n)
        for ids, before, _, _ in _runs(documents, vocabulary.start, 200_000):
            by_before += np.bincount(before * CLASSES + class_of[ids], minlength=len(by_before))
            by_class += np.bincount(class_of[before] * n + ids, minlength=len(by_class))
        return [by_before.reshape(n + 1, CLASSES), by_class.reshape(CLASSES, n)]

    by_before, by_class = _summed(encoded, vocabulary.kind, pairs)
    # a class without ids gets no share, so probabilities of all ids sum up to 1
    there = np.bincount(class_of[:-1], minlength=CLASSES) > 0
    share = np.where(there, of_class + 0.1, 1e-30)
    share /= share.sum()
    bias = np.log(share)
    # the start of training: the smoothed class bigram, as weights
    weights = np.log((by_before + 8 * share) / (by_before.sum(axis=1, keepdims=True) + 8)) - bias

    # the id softmax: weights for (class before, id) over the id's own weight
    own = np.log(single + 0.1)
    inner = np.zeros((CLASSES, n))
    members = [np.flatnonzero(class_of[:-1] == c) for c in range(CLASSES)]
    logs = np.zeros((CLASSES, n))
    for step in range(9):
        logits = own + inner
        for ids in members:
            if len(ids):
                part = logits[:, ids]
                top_ = part.max(axis=1, keepdims=True)
                logs[:, ids] = part - top_ - np.log(np.exp(part - top_).sum(axis=1, keepdims=True))
                if step < 8:
                    total = by_class[:, ids].sum(axis=1, keepdims=True)
                    inner[:, ids] += np.log((by_class[:, ids] + 1) / (total * np.exp(logs[:, ids]) + 1))

    model = Model(
        vocabulary, class_of, bias.astype(np.float32), weights.astype(np.float32),
        np.zeros((n + 1, CLASSES), np.float32), np.zeros((vocabulary.pairs, CLASSES), np.float32), logs,
    )
    sizes = (n + 1, n + 1, vocabulary.pairs)

    def observed(documents):
        seen = [np.zeros(k * CLASSES) for k in sizes]
        for ids, before, skip, _ in _runs(documents, vocabulary.start, 200_000):
            c = class_of[ids]
            for total, f in zip(seen, (before, skip, model.features(before, skip)), strict=True):
                total += np.bincount(f * CLASSES + c, minlength=len(total))
        return [total.reshape(-1, CLASSES) for total in seen]

    seen = _summed(encoded, vocabulary.kind, observed)
    for _ in range(UPDATES):
        sent = encoded.sparkSession.sparkContext.broadcast(model)

        def expected(documents, sent=sent):
            m = sent.value
            thought = [np.zeros((k, CLASSES)) for k in sizes]
            for _, before, skip, _ in _runs(documents, vocabulary.start, 500_000):
                # equal histories once, in the order of the id before
                history, times = np.unique(before * (n + 1) + skip, return_counts=True)
                for a in range(0, len(history), 20_000):
                    before, skip = np.divmod(history[a : a + 20_000], n + 1)
                    p = m.class_logits(before, skip)
                    p -= p.max(axis=1, keepdims=True)
                    np.exp(p, out=p)
                    p *= (times[a : a + 20_000] / p.sum(axis=1))[:, None].astype(np.float32)
                    for total, f in zip(thought, (before, skip, m.features(before, skip)), strict=True):
                        order = np.argsort(f.astype(vocabulary.kind), kind="stable")
                        ordered = f[order]
                        begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                        total[ordered[begins]] += np.add.reduceat(p[order], begins, axis=0)
            return thought

        # the gradient, observed less expected, each weight's by its own scale and a third for each of the three features of a token
        for table, is_, thought in zip((model.by_before, model.by_skip, model.by_pair), seen, _summed(encoded, vocabulary.kind, expected), strict=True):
            table += ((is_ - thought) / (3 * ((is_ + thought) / 2 + 2))).astype(np.float32)
    return model


def score_documents(docs: DataFrame, folds: int = 5, held_out_fold: int = 1, heads: int = 2048, growth: float = 2e7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from documents whose crc32(doc_id) mod folds isn't the held-out fold.
    Tokens are words between white space, A-Z folded, then one end.  Null and
    empty texts have the end alone; texts of any length are read whole.  ``heads`` words have ids of their own, more beyond ``growth`` training words.  ``base_score`` is the smoothed unigram's log10
    probability, ``score`` the model's.  Repeated rows are trained on and scored
    each; null ids count as the empty id.  Without training documents
    both scores follow from the smoothing alone; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", fold_of(F.col("doc_id"), folds) == held_out_fold)
    vocabulary = frequent_words(docs.where(~F.col("held_out")), heads, growth)
    encoded = materialize(encode(docs, vocabulary), "encoded")
    training = encoded.where(~F.col("held_out"))
    single = _single_counts(training, vocabulary)
    bytes_, total = encoded.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)), F.count("*")).first()
    tokens = bytes_ // np.dtype(vocabulary.kind).itemsize
    rare = materialize(rare_word_logs(docs, vocabulary, max(1, -(-tokens // (3 * BUCKET_WORDS)))), "rare")
    kinds = np.zeros(SUFFIXES)
    listed = rare.where("bucket < 0").select(F.posexplode("kinds")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    for pos, many in listed:
        kinds[pos] = many
    model = train(training, vocabulary, single)

    n_train = int(single.sum())
    end = vocabulary.end
    distinct = int((single[: end + 1] > 0).sum()) + int(kinds.sum())
    base_norm = float(np.log10(n_train + SMOOTH * (distinct + 1)))
    head_logs = np.zeros(vocabulary.size)
    head_logs[: end + 1] = np.log10(single[: end + 1] + SMOOTH)
    shared_norm = np.zeros(vocabulary.size)
    shared_norm[end + 1 :] = np.log10(single[end + 1 :] + SMOOTH * (kinds + 1))
    sent = docs.sparkSession.sparkContext.broadcast((model, head_logs, shared_norm, single))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("key", pa.binary()), ("n_tokens", pa.int64()), ("n_common", pa.int64()), ("n_head", pa.int64()), ("base", pa.float64()), ("model", pa.float64())]
    )

    def run(batches):
        model, head_logs, shared_norm, single = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                documents = (np.frombuffer(b, vocabulary.kind).astype(np.int64) for b in part.column("ids").to_pylist())
                sums: list[np.ndarray] = []
                for ids, before, skip, ends in _runs(documents, vocabulary.start):
                    begins = np.concatenate([[0], ends[:-1]])
                    logs = model.token_logs(ids, before, skip) / np.log(10) - shared_norm[ids]
                    own = ids <= end
                    each = (own.astype(np.int64), (own & (single[ids] > 0)).astype(np.int64), head_logs[ids], logs)
                    sums.append(np.array([np.diff(np.append(begins, len(ids))), *(np.add.reduceat(e, begins) for e in each)]))
                n, common, head, base, score = np.hstack(sums) if sums else np.zeros((5, 0))
                yield record_batch(
                    schema,
                    [part.column("doc_id"), part.column("held_out"), part.column("key"), n.astype(np.int64), common.astype(np.int64), head.astype(np.int64), base, score],
                )

    ddl = "doc_id long, held_out boolean, key binary, n_tokens long, n_common long, n_head long, base double, model double"
    scored = materialize(encoded.select("doc_id", "held_out", "key", "ids").mapInArrow(run, ddl), "scored")
    values = materialize(text_logs(rare), "logs")
    # a text without rare words has no value: its rows wait for none
    rare_rows, other = scored.where("n_tokens > n_common"), scored.where("n_tokens = n_common")
    hot = materialize(hot_keys(encoded, "key", total), "hot")
    joined = join_hot(rare_rows, values, "key", hot).unionByName(other, allowMissingColumns=True)
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + known).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * base_norm).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
