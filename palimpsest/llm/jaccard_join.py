"""Size-aware heavy-light join of documents on word shingles, by Jaccard.

1. Each document becomes its set of distinct shingle hashes.  Equal sets are one
   *set* from here on; it is known by the 128-bit hash of its members.
2. A task numbers the sets of a *parcel* of bounded size, adds up the shingles that
   several of its sets have, and deals the distinct ones into buckets by hash.  A bucket
   finds the shingles that two or more sets have, and how many, and answers each
   parcel; the others can't be in an intersection.  A set of n members needs ceil(t n)
   shared ones to have any partner, so most sets end here.
3. Light sets (up to x members) are joined by enumerating their subsets of the
   sizes that a partner within the light sizes must share: two light sets are
   linked if, and only if, they have such a subset in common.  Within the
   sets of one subset, the smallest is linked to all that any of them is linked to
   by that subset, so a star of links suffices.
4. Pairs with a heavy set are found by scanning the inverted lists of the rarest
   shingles of each set (any partner shares one of them).  A list isn't expanded
   into all its pairs: in rounds, one leader of each list is verified against the
   others, linked sets merge into components, and lists whose sets are all in one
   component are done.  What then remains are pairs of sets that are in different
   components, mostly because they aren't similar; they are verified pair by pair.
5. x is the size at which the rows of both parts, counted from the data, are
   fewest.

Links are exact: every candidate pair is verified on the whole sets, and no
list, bucket or group is cut.  A shingle that many sets have reaches its bucket once
for each parcel, however many sets of the parcel have it.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import free_name, join_hot, materialize, record_batch, text_blocks, tidy_batches, tidy_group
from .words import NOT_SPACE, mix, shingle_sets, words_of

#: Shingles in one bucket of step 2.
BUCKET_SHINGLES = 2_000_000
#: Shingles of a bucket that are sorted at once.
SLICE_SHINGLES = 250_000
#: Members and sets of a parcel.
PARCEL_MEMBERS, PARCEL_SETS = 1_000_000, 65_535
#: Instead of a set's number: several sets of the parcel have the shingle.
SEVERAL = 65_535
#: Largest size for which the light part's cost is counted.
LIGHT_SIZES = 24


def required_overlap(a: int, b: int, num: int, den: int) -> int:
    """Least intersection of sets of a and b members with den * i >= num * union."""
    return -(-num * (a + b) // (num + den))


def least_partner(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def set_key(members: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(members) if len(members) else None


def _sets_of_block(data, offsets, size: int) -> list[np.ndarray]:
    return shingle_sets(words_of(data, offsets, NOT_SPACE), size)


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (members) and set (null without members) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("set", pa.binary())])

    def run(batches):
        for block, data, offsets in text_blocks(batches):
            sets = _sets_of_block(data, offsets, size)
            yield record_batch(schema, [block.column("doc_id"), [len(s) for s in sets], [set_key(s) for s in sets]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy_batches(run), "doc_id long, n int, set binary")


# Shingles travel as the upper 48 bits of their hashes.  Two sets of 20,000 members
# agree by chance in one shingle of these in 700,000 such pairs.


def to_48(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def from_48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def pack_ascending(hashes: np.ndarray) -> bytes:
    """The first hash and the steps to the others in 4 bytes each, or 6 bytes each if a step is too long."""
    steps = np.diff(hashes >> np.uint64(16))
    if len(steps) and int(steps.max()) >> 32:
        return to_48(hashes)
    return to_48(hashes[:1]) + steps.astype("<u4").tobytes()


def unpack_ascending(raw: bytes, n: int) -> np.ndarray:
    if len(raw) == 6 * n:
        return from_48(raw)
    steps = np.concatenate([from_48(raw[:6]) >> np.uint64(16), np.frombuffer(raw, "<u4", offset=6).astype(np.uint64)])
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(16)


_SET = np.dtype([("key", "V16"), ("n", "<i4")])
# A row to a bucket: its shingles of a parcel in ascending order, the number of the set that has each (or SEVERAL),
# and how many sets these are for the latter.  A parcel's own row (bucket < 0): its sets, and owners and shingles for SEVERAL.
_DEALT = pa.schema(
    [("bucket", pa.int32()), ("parcel", pa.int64()), ("owners", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("sets", pa.binary())]
)
_DEALT_DDL = "bucket int, parcel long, owners binary, hashes binary, counts binary, sets binary"
# The answer to a parcel: its shared shingles, their owners, and their frequencies up to 255.
_SHARED_DDL = "parcel long, owners binary, hashes binary, ranks binary, sets binary"
_SHARED = pa.schema([("parcel", pa.int64()), ("owners", pa.binary()), ("hashes", pa.binary()), ("ranks", pa.binary()), ("sets", pa.binary())])


def _parcel_rows(parcel: int, keys: list[bytes], sets: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets])
    members = np.concatenate(sets)
    members &= ~np.uint64(0xFFFF)
    order = np.argsort(members, kind="stable")
    members, owner = members[order], np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
    del order
    begins = np.flatnonzero(np.append(True, members[1:] != members[:-1]))
    width = np.diff(np.append(begins, len(members)))
    several = np.repeat(width > 1, width)
    about = np.empty(len(sets), _SET)
    about["key"], about["n"] = np.frombuffer(b"".join(keys), "V16"), sizes
    own_row = (-1 - parcel % buckets, parcel, owner[several].tobytes(), to_48(members[several]), b"", about.tobytes())

    hashes, owner = members[begins], np.where(width > 1, SEVERAL, owner[begins]).astype(np.uint16)
    counts = np.minimum(width, 255).astype(np.uint8)
    del members, begins, width, several
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
    rows = [own_row]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            rows.append((int(bucket[a]), parcel, owner[a:b].tobytes(), pack_ascending(hashes[a:b]), counts[a:b][owner[a:b] == SEVERAL].tobytes(), None))
    return record_batch(_DEALT, [list(c) for c in zip(*rows, strict=True)])


def _deal(size: int, buckets: int):
    """Parcels of each task's sets; copies within a task go once."""

    def run(batches):
        seen: set[bytes] = set()
        parcel = TaskContext.get().partitionId() << 32
        keys: list[bytes] = []
        sets: list[np.ndarray] = []
        held = 0
        for _, data, offsets in text_blocks(batches):
            for members in _sets_of_block(data, offsets, size):
                key = set_key(members)
                if key is None or key in seen:
                    continue
                seen.add(key)
                keys.append(key)
                sets.append(members)
                held += len(members)
                if held >= PARCEL_MEMBERS or len(sets) == PARCEL_SETS:
                    yield _parcel_rows(parcel, keys, sets, buckets)
                    keys, sets, held, parcel = [], [], 0, parcel + 1
        if sets:
            yield _parcel_rows(parcel, keys, sets, buckets)

    return run


def _raw(column: pa.ChunkedArray) -> list[pa.Buffer]:
    """The values of a binary column without nulls, not copied."""
    return [value.as_buffer() for chunk in column.chunks for value in chunk]


def _ranks(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weight of all that are equal, up to 255, for each."""
    if not len(hashes):
        return np.empty(0, np.uint8)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    total = np.minimum(np.add.reduceat(weight[order], begins, dtype=np.int32), 255).astype(np.uint8)
    rank = np.empty(len(hashes), np.uint8)
    rank[order] = np.repeat(total, np.diff(np.append(begins, len(ordered))))
    return rank


def _shared(table: pa.Table) -> pa.Table:
    """A bucket's answers to the parcels; the parcels' own rows pass.

    Rows are in ascending order, so slices of the hashes are ranked one after the other.
    """
    if table.column("bucket")[0].as_py() < 0:
        return table.select(["parcel", "owners", "hashes", "counts", "sets"]).rename_columns(_SHARED.names).cast(_SHARED)
    parcels = table.column("parcel").to_pylist()
    owners = [np.frombuffer(raw, np.uint16) for raw in _raw(table.column("owners"))]
    hashes = [unpack_ascending(raw, len(o)) for raw, o in zip(_raw(table.column("hashes")), owners, strict=True)]
    weights = [np.ones(len(o), np.uint8) for o in owners]
    for weight, o, raw in zip(weights, owners, _raw(table.column("counts")), strict=True):
        weight[o == SEVERAL] = np.frombuffer(raw, np.uint8)
    ranks = [np.empty(len(o), np.uint8) for o in owners]
    least, most = min(int(h[0]) for h in hashes), max(int(h[-1]) for h in hashes)
    slices = -(-sum(map(len, owners)) // SLICE_SHINGLES)
    inner = np.array([least + (most - least) * k // slices for k in range(1, slices)], np.uint64)
    cuts = [[0, *np.searchsorted(h, inner).tolist(), len(h)] for h in hashes]
    for k in range(slices):
        parts = [slice(c[k], c[k + 1]) for c in cuts]
        found = _ranks(*(np.concatenate([x[part] for x, part in zip(of, parts, strict=True)]) for of in (hashes, weights)))
        at = 0
        for rank, part in zip(ranks, parts, strict=True):
            rank[part] = found[at : (at := at + part.stop - part.start)]
    del weights
    columns: list[list] = [[] for _ in _SHARED]
    for row, parcel in enumerate(parcels):
        keep = ranks[row] > 1
        if keep.any():
            values = (parcel, owners[row][keep].tobytes(), to_48(hashes[row][keep]), ranks[row][keep].tobytes(), None)
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        hashes[row] = None
    return pa.Table.from_batches([record_batch(_SHARED, columns)], _SHARED)


_PARTNERED = pa.schema([("set", pa.binary()), ("n", pa.int32()), ("hashes", pa.binary()), ("ranks", pa.binary())])


def _partnered(num: int, den: int):
    """Sets of a parcel with enough shared members for a partner: these members from rare to frequent."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["sets"] is not None)
        answers = [r for r in rows if r["sets"] is None]
        sets = np.frombuffer(own["sets"], _SET)
        owners = np.frombuffer(b"".join(r["owners"] for r in answers), np.uint16)
        hashes = from_48(b"".join(r["hashes"] for r in answers))
        ranks = np.frombuffer(b"".join(r["ranks"] for r in answers), np.uint8)
        several = owners == SEVERAL
        order = np.argsort(hashes[several])
        known, known_ranks = hashes[several][order], ranks[several][order]
        mine = from_48(own["hashes"])
        owners = np.concatenate([owners[~several], np.frombuffer(own["owners"], np.uint16)]).astype(np.int64)
        ranks = np.concatenate([ranks[~several], known_ranks[np.searchsorted(known, mine)]])
        hashes = np.concatenate([hashes[~several], mine])
        total = np.bincount(owners, minlength=len(sets))
        enough = den * total >= num * sets["n"].astype(np.int64)
        keep = enough[owners]
        owners, hashes, ranks = owners[keep], hashes[keep], ranks[keep]
        order = np.lexsort((hashes, ranks, owners))
        hashes, ranks = hashes[order], ranks[order]
        columns: list[list] = [[], [], [], []]
        at = 0
        for g in np.flatnonzero(enough).tolist():
            end = at + int(total[g])
            values = (sets["key"][g].tobytes(), int(sets["n"][g]), hashes[at:end].tobytes(), ranks[at:end].tobytes())
            for column, value in zip(columns, values, strict=True):
                column.append(value)
            at = end
        return pa.Table.from_batches([record_batch(_PARTNERED, columns)], _PARTNERED)

    return run


def partnered_sets(docs: DataFrame, members: int, size: int, num: int, den: int) -> DataFrame:
    """Step 2.  set, n, hashes (shared members, the rarest first) and ranks (their frequencies up to 255).

    Copies of a set in several parcels count for each, so a set that has only these may be among the result.
    ``docs`` must give a task that runs again the same rows in the same order, as files do.
    """
    buckets = max(1, -(-members // BUCKET_SHINGLES))
    dealt = docs.select("text").mapInArrow(tidy_batches(_deal(size, buckets)), _DEALT_DDL)
    shared = dealt.groupBy("bucket").applyInArrow(tidy_group(_shared), _SHARED_DDL)
    found = shared.groupBy("parcel").applyInArrow(tidy_group(_partnered(num, den)), "set binary, n int, hashes binary, ranks binary")
    return found.dropDuplicates(["set"])


def _prefix(n: int, shared: int, num: int, den: int) -> int:
    """How many of the shared members belong to the prefix: its first members are those that no other set has."""
    return n - least_partner(n, num, den) + 1 - (n - shared)


def subset_sizes(n: int, light: int, num: int, den: int) -> list[int]:
    """Overlaps that partners of up to ``light`` members must have with a set of n."""
    partners = range(least_partner(n, num, den), min(light, den * n // num) + 1)
    return sorted({required_overlap(n, b, num, den) for b in partners})


def _rows_of(sets: DataFrame, fn, schema: pa.Schema, ddl: str) -> DataFrame:
    """fn(id, n, members, ranks) yields tuples."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                columns: list[list] = [[] for _ in schema]
                for which, n, hashes, ranks in zip(*(part.column(c).to_pylist() for c in ("id", "n", "hashes", "ranks")), strict=True):
                    for row in fn(which, n, np.frombuffer(hashes, np.uint64), np.frombuffer(ranks, np.uint8)):
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                yield record_batch(schema, columns)

    return sets.select("id", "n", "hashes", "ranks").mapInArrow(tidy_batches(run), ddl)


def light_boundary(sets: DataFrame, num: int, den: int, largest: int = LIGHT_SIZES) -> int:
    """The size up to which enumerating subsets makes fewer rows than scanning lists; ``largest`` at most."""

    def cost(which, n, members, ranks):
        yield n, float(ranks[: max(0, _prefix(n, len(members), num, den))].sum()), len(members)

    schema = pa.schema([("n", pa.int32()), ("scan", pa.float64()), ("shared", pa.int32())])
    costs = _rows_of(sets.where(F.col("n") <= largest), cost, schema, "n int, scan double, shared int")
    rows = costs.groupBy("n", "shared").agg(F.sum("scan"), F.count("*")).collect()  # largest**2 rows at most

    def total(x: int) -> float:
        return sum(
            many * sum(comb(shared, c) for c in subset_sizes(n, x, num, den)) if n <= x else scan
            for n, shared, scan, many in rows
        )

    return min(range(largest + 1), key=total)


def light_links(sets: DataFrame, light: int, num: int, den: int) -> DataFrame:
    """Step 3: a, b (ids) of links among sets of up to ``light`` members."""

    def subsets(which, n, members, ranks):
        ordered = np.sort(members)
        for c in subset_sizes(n, light, num, den):
            for part in combinations(range(len(ordered)), c):
                chosen = mix(ordered[list(part)] + np.arange(1, c + 1, dtype=np.uint64))
                yield int(mix(chosen.sum(dtype=np.uint64)[None] + np.uint64(c))[0].astype(np.int64)), c, which, n

    schema = pa.schema([("subset", pa.int64()), ("c", pa.int32()), ("id", pa.int64()), ("n", pa.int32())])
    rows = _rows_of(sets.where(F.col("n") <= light), subsets, schema, "subset long, c int, id long, n int")
    rows = materialize(rows, "subsets")
    least = rows.groupBy("subset", "c").agg(F.min(F.struct("n", "id")).alias("l"), F.count("*").alias("k")).where("k > 1")
    star = rows.join(least, ["subset", "c"]).where("id <> l.id")
    # c members in common make a link where c is enough for both sizes
    star = star.where(f"c >= ceil({num} * (n + l.n) / {num + den})")
    return star.select(F.col("id").alias("a"), F.col("l.id").alias("b")).distinct()


def heavy_lists(sets: DataFrame, light: int, num: int, den: int) -> DataFrame:
    """Step 4: member, id, n, shared (how many of its members other sets have too)
    and place (of the member in the set's order) for the prefix of each set that may have a heavy partner."""

    def postings(which, n, members, ranks):
        alone = n - len(members)
        for k, m in enumerate(members[: max(0, _prefix(n, len(members), num, den))].astype(np.int64).tolist(), alone):
            yield m, which, n, len(members), k

    schema = pa.schema([("member", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("shared", pa.int32()), ("place", pa.int32())])
    indexed = sets.where(F.col("n") >= least_partner(light + 1, num, den))
    return _rows_of(indexed, postings, schema, "member long, id long, n int, shared int, place int")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are linked, by the intersection of the whole sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], []]
            for a, b, n, m, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                if den * both >= num * (n + m - both):
                    columns[0].append(a)
                    columns[1].append(b)
            yield record_batch(schema, columns)

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    whole = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ha", "hb")
    return whole.mapInArrow(tidy_batches(run), "a long, b long")


def connected(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """id, label: the least id of each linked set's component.

    Every round takes the least label of a set's neighbours, then the label of
    its label, until nothing changes.  After ``rounds`` rounds, equal labels mean one
    component, but one component may still have several labels.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    both = materialize(both, "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
    labels = labels.select("id", F.least("id", "label").alias("label"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = hooked.select(F.col("id").alias("label"), F.col("label").alias("top"))
        moved = materialize(hooked.join(up, "label").select("id", "old", F.col("top").alias("label")), "labels")
        labels = moved.select("id", "label")
        rounds = rounds and rounds - 1
        if rounds == 0 or moved.where("old <> label").isEmpty():
            return labels


def heavy_links(sets: DataFrame, links: DataFrame, light: int, num: int, den: int, pairs_per_row: int = 4) -> DataFrame:
    """``links`` with those that have a heavy set, so far as components need them.

    Stars go on while the remaining pairs are more than ``pairs_per_row`` for each row of the open lists and
    a star takes at least a quarter of them away; then the pairs are verified.
    """
    lists = heavy_lists(sets, light, num, den)
    many = lists.groupBy("member").agg(F.count("*").alias("k")).where("k > 1").select("member")
    lists = materialize(lists.join(many, "member"), "lists")
    checked: DataFrame | None = None
    # A pair of n and m members must have o in common.  Neither set shares fewer with
    # all others, and the rarest common member is among the first n - o + 1, and m - o + 1.
    overlap = f"ceil({num} * (n + m) / {num + den})"
    near = f"greatest(n, m) > {light} AND {overlap} <= least(shared, t) AND place + {overlap} <= n AND there + {overlap} <= m"
    before, turn = None, 0
    while True:
        if turn or light:
            labels = connected(links, rounds=2)
            at = lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        else:
            at = lists.withColumn("label", F.col("id"))
        # a list whose sets are all in one component is done
        first = F.min(F.struct(F.expr("1 - shared / n").alias("alone"), "n", "id", "shared", "place")).alias("first")
        parts = at.groupBy("member", "label").agg(F.count("*").alias("k"), first)
        heads = parts.groupBy("member").agg(
            F.count("*").alias("parts"),
            F.sum("k").alias("all"),
            F.max(F.struct("k", "label")).getField("label").alias("main"),
            F.min(F.struct("k", "first")).getField("first").alias("leader"),
        )
        open_ = materialize(at.join(heads.where("parts > 1"), "member"), "open")
        left, pairs = open_.agg(F.count("*"), F.sum(F.expr("if(label = main, 0, all)"))).first()
        if not left:
            return links
        last = pairs <= pairs_per_row * left + 10_000 or (before is not None and turn > 1 and 4 * pairs > 3 * before)
        before, turn = pairs, turn + 1
        if last:
            # sets outside a list's largest component against all of other components
            some = open_.where("label <> main").select("member", F.col("id").alias("s"), F.col("n").alias("m"), F.col("shared").alias("t"), F.col("place").alias("there"), F.col("label").alias("other"))
            found = open_.join(some, "member").where("label <> other")
        else:
            found = open_.withColumn("s", F.col("leader.id")).withColumn("m", F.col("leader.n")).withColumn("t", F.col("leader.shared")).withColumn("there", F.col("leader.place")).where("id <> s")
        found = found.where(near).select(F.least("id", "s").alias("a"), F.greatest("id", "s").alias("b")).distinct()
        if checked is not None:
            found = found.join(checked, ["a", "b"], "left_anti")
        found = materialize(found, "pairs")
        links = materialize(links.union(verified(found, sets, num, den)), "linked")
        if last:
            return links
        checked = found if checked is None else checked.union(found)
        # a leader has met all of its list
        lists = open_.where("id <> leader.id").select("member", "id", "n", "shared", "place")


def document_components(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, set and component of each document.

    ``component`` is a struct of the least (doc_id, set) of all documents that
    links connect, or null for documents without words (null and empty texts),
    which are linked with nothing.  Repeated rows and rows with equal ids
    are linked if their texts are; null ids come last in that order.  An empty
    table gives an empty result; very long texts are sets like others.
    """
    documents = materialize(document_sets(docs, size), "sets")
    members, rows = documents.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sets = partnered_sets(docs, members, size, num, den).withColumn("id", F.monotonically_increasing_id())
    sets = materialize(sets, "partnered")
    light = light_boundary(sets, num, den)
    links = materialize(light_links(sets, light, num, den), "light")
    links = heavy_links(sets, links, light, num, den)
    labels = connected(links)

    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set"))
    worded = documents.where("set IS NOT NULL")
    firsts = worded.groupBy("set").agg(least.alias("own"), F.count("*").alias("copies"))
    linked = sets.select("set", "id").join(labels, "id").select("set", "label")
    firsts = materialize(firsts.join(linked, "set", "left"), "firsts")
    tops = firsts.where("label IS NOT NULL").groupBy("label").agg(F.min("own").alias("top"))
    top = F.coalesce("top", "own")
    component = firsts.join(tops, "label", "left").select("set", "copies", F.struct(top["doc_id"].alias("doc_id"), top["set"].alias("set")).alias("component"))
    hot = materialize(component.where(F.col("copies") * 1000 > rows).select("set"), "hot")
    found = join_hot(worded, component.drop("copies"), "set", hot)
    wordless = documents.where("set IS NULL").withColumn("component", F.lit(None).cast(component.schema["component"].dataType))
    return found.unionByName(wordless).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set", "component")


def keep_one(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One document of each component, the one with the least id, with all its columns.

    Documents without words (null and empty texts) all stay.  Of repeated rows, and of rows with equal ids
    and texts, one stays; null ids come last, so one of them stays only where a component has no
    other.  Extra columns may have any names.  An empty table gives an empty result.
    """
    names = docs.columns
    tag, kept_set, kept_id = (free_name(docs, c) for c in ("set", "kept_set", "kept_id"))
    kept = document_components(docs, size, num, den).where("component.set = set AND component.doc_id <=> doc_id")
    kept = kept.select(F.col("set").alias(kept_set), F.col("doc_id").alias(kept_id)).distinct()
    schema = StructType([*docs.schema.fields, StructField(tag, BinaryType())])

    def run(batches):
        for block, data, offsets in text_blocks(batches):
            keys = [set_key(s) for s in _sets_of_block(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(keys, pa.binary())], [*block.schema.names, tag])

    tagged = docs.mapInArrow(tidy_batches(run), schema)
    wordless = tagged.where(F.col(tag).isNull()).drop(tag)
    # by set and id, so the copies of a kept text don't meet
    matched = tagged.join(kept, (F.col(tag) == F.col(kept_set)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)))
    one = matched.dropDuplicates([kept_set, kept_id]).select(*[F.col(f"`{c}`") for c in names])
    return one.unionByName(wordless)
