"""N-gram Jaccard join by vertical partitioning.

The n-grams (shingles) of a text are hashed to 64 bits; the order of the hashes is the global order. It is cut into
fragments twice:

* Candidates. Sets with similarity s differ in at most ``(1-s)/(1+s) * (|x|+|y|)`` members. Cut into more fragments
  than that, two similar sets agree on a whole fragment. The number of fragments follows the size of a set, so that each
  set takes part in two schemes (its own size class and the next). No linked pair is lost. A fragment holds about four
  shingles, so texts that share a passage seldom agree on one.
* Verification. The sets of the candidates are cut into a fixed number of fragments, the overlap of a pair is counted
  fragment by fragment, and the partial overlaps are summed per pair. A pair links when ``100*overlap >= 80*union``.

Texts with equal sets form one class and count once. Within a large group of sets that agree on a fragment no pairs are
listed at once: all are compared with one member, and later those that a prefix filter lets meet. For all links these are
all members of large groups; where only components are wanted, members of different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Sent, removed, spread, stored, tidied
from .words import SPACED, Words, chunks, constants, mix, runs

#: Up to this many sets that agree on a fragment are compared pairwise at once; in larger groups a centre comes first.
SMALL_GROUP = 12
#: Entries that a task gathers before it hands them on.
FLUSH = 1 << 20

_SALT = constants(4, 4242)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row of a chunk, one row after the other, and each row's number of them.

    A row of fewer than k words, but not none, has its whole sequence as its only shingle.
    """
    grams, at = runs(words.hash, words.doc, k)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        whole = words.count[short].astype(np.uint64)
        for j in range(k - 1):
            has = words.count[short] > j
            place = np.minimum(words.first[short] + j, len(words.hash) - 1)
            whole = np.where(has, mix(whole + words.hash[place] * _SALT[0]), whole)
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(words.rows + 1))
    sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else grams), sizes


def fingerprints(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of each set; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ _SALT[1]))])
    ends = np.cumsum(sizes)
    value = mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * _SALT[2])
    return np.where(sizes > 0, value, np.uint64(0))


def size_classes(largest: int, percent: int) -> np.ndarray:
    """First sizes of the size classes: the last size of a class is at most 100/percent times its first."""
    first = [1]
    while first[-1] <= largest:
        first.append(first[-1] * 100 // percent + 1)
    return np.array(first, dtype=np.int64)


def fragment_keys(sets: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the fragments by which candidates meet, and the row of each.

    Scheme t holds the pairs whose larger set is in size class t. Its sets differ in at most ``d`` members, so of
    ``d + 1 + e`` fragments ``e + 1`` are equal. A set with at most e empty fragments needs none of them and leaves
    them out; a set with more gives all. Sets that leave them out still meet it in one of the others.
    """
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = size_classes(int(sizes.max()) * 100 // percent + 2, percent)
    own = np.searchsorted(first, sizes, "right") - 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    high, scrambled = sets >> np.uint64(32), mix(sets + _SALT[3])
    keys, rows = [], []
    for ahead in (0, 1):
        scheme = np.minimum(own + ahead, len(first) - 2)
        last = first[scheme + 1] - 1
        differ = 2 * last * (100 - percent) // (100 + percent)
        spare = differ // 8 + 1
        count = differ + 1 + spare
        piece = (high * count[row].astype(np.uint64)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])]))
        total = np.add.reduceat(scrambled, begin)
        r, p = row[begin], piece[begin]
        full = np.bincount(r, minlength=len(sizes))
        for x in np.flatnonzero((sizes > 0) & (count - full > spare)):
            none = np.setdiff1d(np.arange(count[x], dtype=np.uint64), p[np.searchsorted(r, x) : np.searchsorted(r, x, "right")])
            r, p, total = np.append(r, np.full(len(none), x)), np.append(p, none), np.append(total, np.zeros(len(none), np.uint64))
            order = np.argsort(r, kind="stable")
            r, p, total = r[order], p[order], total[order]
        keys.append(mix(mix(total + p * _SALT[0]) + scheme[r].astype(np.uint64) * _SALT[1]))
        rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


#: What a task hands on in one flush. The distinct sets of a flush are numbered from 0 (``at``; at most 65535 of them); with the
#: flush's number that is a set's id. bucket >= 0: fragments as the low halves of their keys, set after set (counts: how many of
#: each; at = NO_SET: keys of which the flush had a large group). bucket < 0, dealt by row: documents with their prints and
#: sizes (at = NO_SET but for a set's first document), and the members of large groups (hot: places of keys).
_DEALT = "bucket int, flush bigint, keys array<int>, counts array<tinyint>, at array<smallint>, docs array<bigint>, prints array<bigint>, sizes array<int>, hot array<bigint>"
_LISTS = {"keys": pa.int32(), "counts": pa.int8(), "at": pa.int16(), "docs": pa.int64(), "prints": pa.int64(), "sizes": pa.int32(), "hot": pa.int64()}
NO_SET, MOST_KEYS = 65535, 127
#: kind 0: doc_id, print, n shingles. 1: ids of two sets in a bucket's small groups, and in how many. 2: place of a large group, id of
#: a member. 3: id of a set, its print and n shingles.
_MET = "kind tinyint, a bigint, b bigint, n int"


def _deal(buckets: int, k: int, percent: int):
    schema = pa.schema([("bucket", pa.int32()), ("flush", pa.int64())] + [(c, pa.list_(t)) for c, t in _LISTS.items()])

    def rows(bucket: np.ndarray, flush: int, **lists: tuple[np.ndarray | pa.Array, np.ndarray]) -> pa.RecordBatch:
        """lists: values of all rows and where each row's begin and end."""
        cells = [pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), flush))]
        for name, kind in _LISTS.items():
            values, ends = lists.get(name, (np.zeros(0, np.int64), np.zeros(len(bucket) + 1)))
            values = values if isinstance(values, pa.Array) else pa.array(values, kind)
            cells.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
        return pa.record_batch(cells, schema=schema)

    def short(x: np.ndarray) -> np.ndarray:
        return x.astype(np.uint16).view(np.int16)

    def flushed(flush: int, docs: list, prints: list, sizes: list, keys: list, at: list) -> Iterator[pa.RecordBatch]:
        doc, fp, n = pa.concat_arrays(docs), np.concatenate(prints), np.concatenate(sizes)
        _, first, number = np.unique(fp, return_index=True, return_inverse=True)
        is_first = np.zeros(len(fp), bool)
        is_first[first] = True
        # Documents go by id and print, so that the copies of a text are not one bucket's.
        ids = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        order, ends = _dealt((mix(ids + fp * _SALT[0]) % np.uint64(buckets)).astype(np.int64), buckets)
        yield rows(
            -1 - np.arange(buckets), flush, docs=(doc.take(pa.array(order)), ends), prints=(fp[order].view(np.int64), ends), sizes=(n[order], ends), at=(short(np.where(is_first, number, NO_SET)[order]), ends)
        )
        key, row = np.concatenate(keys), np.concatenate(at)
        key, of = key[is_first[row]], number[row[is_first[row]]]  # of the copies of a set one hands on its keys
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        place = (bucket << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
        order = np.argsort(place, kind="stable")
        place, of = place[order], of[order]
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else order
        size = np.diff(np.append(begin, len(place)))
        large = np.repeat(size > SMALL_GROUP, size)
        if large.any():
            order, ends = _dealt((mix(place[large] + of[large].astype(np.uint64) * _SALT[2]) % np.uint64(buckets)).astype(np.int64), buckets)
            yield rows(-1 - np.arange(buckets), flush, hot=(place[large][order].view(np.int64), ends), at=(short(of[large][order]), ends))
        told = place[begin[size > SMALL_GROUP]]
        place, of = np.concatenate([place[~large], told]), np.concatenate([of[~large], np.full(len(told), NO_SET)])
        bucket = (place >> np.uint64(32)).astype(np.int64)
        order = np.argsort((bucket << 16) | of, kind="stable")
        place, of, bucket = place[order], of[order], bucket[order]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])]) if len(of) else np.zeros(0, bool)
        began = np.flatnonzero(new)
        run = np.flatnonzero(new | ((np.arange(len(of)) - np.repeat(began, np.diff(np.append(began, len(of))))) % MOST_KEYS == 0))
        of_bucket = np.arange(buckets + 1)
        ends, run_ends = np.searchsorted(bucket, of_bucket), np.searchsorted(bucket[run], of_bucket)
        counts = np.diff(np.append(run, len(of)))
        yield rows(np.arange(buckets), flush, keys=(place.astype(np.uint32).view(np.int32), ends), counts=(counts, run_ends), at=(short(of[run]), run_ends))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, documents, flush = ([], [], [], [], []), 0, 0, TaskContext.get().partitionId() << 22
        for batch in batches:
            for part in (x.slice(i, NO_SET) for x in chunks(batch, "text") for i in range(0, x.num_rows, NO_SET)):
                if count >= FLUSH or documents + part.num_rows > NO_SET:
                    yield from flushed(flush, *held)
                    held, count, documents, flush = ([], [], [], [], []), 0, 0, flush + 1
                sets, sizes = shingle_sets(Words(part.column("text"), SPACED), k)
                keys, rows = fragment_keys(sets, sizes, percent)
                for x, v in zip(held, (part.column("doc_id"), fingerprints(sets, sizes), sizes, keys, rows + documents), strict=True):
                    x.append(v)
                count, documents = count + len(keys) + part.num_rows, documents + part.num_rows
        if documents:
            yield from flushed(flush, *held)

    return task


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of their buckets, and where each bucket's begin and end."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _numbers(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and how many each row has."""
    lists = table[name].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def pairs_within(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places i < j within each run of places."""
    left, right = [], []
    for m in np.unique(size):
        i, j = np.triu_indices(m, 1)
        at = start[size == m][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _meet():
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32())])

    def rows(kind: int, a, b, n) -> pa.Table:
        return pa.table([pa.array(x, f.type) for x, f in zip((np.full(len(n), kind, np.int8), a, b, n), schema, strict=True)], schema=schema)

    def group(table: pa.Table) -> pa.Table:
        at, each = _numbers(table, "at")
        at = at.view(np.uint16).astype(np.int64)
        ids = np.repeat(table["flush"].to_numpy() << 16, each) | at
        if table["bucket"][0].as_py() < 0:
            prints, sizes, hot = (_numbers(table, c)[0] for c in ("prints", "sizes", "hot"))
            documents = np.repeat(_numbers(table, "docs")[1] > 0, each)
            own, first = ids[documents], at[documents] != NO_SET
            return pa.concat_tables([
                rows(0, table["docs"].combine_chunks().flatten(), prints, sizes), rows(3, own[first], prints[first], sizes[first]), rows(2, hot, ids[~documents], np.zeros(len(hot), np.int32))
            ])
        key, count = _numbers(table, "keys")[0].view(np.uint32), _numbers(table, "counts")[0]
        member = np.repeat(np.where(at == NO_SET, -1, ids), count)
        order = np.argsort(key, kind="stable")
        key, member = key[order], member[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        size = np.diff(np.append(begin, len(key)))
        large = size > SMALL_GROUP
        if len(begin):
            large |= np.minimum.reduceat(member, begin) < 0  # some flush had a large group
        i, j = pairs_within(begin[(size > 1) & ~large], size[(size > 1) & ~large])
        a, b = np.minimum(member[i], member[j]), np.maximum(member[i], member[j])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else order
        many = np.flatnonzero(np.repeat(large, size) & (member >= 0))
        place = (table["bucket"][0].as_py() << 32) | key[many].astype(np.int64)
        return pa.concat_tables([rows(1, a[new], b[new], np.diff(np.append(new, len(a)))), rows(2, place, member[many], np.zeros(len(many), np.int32))])

    return group


def _segments(k: int, bits: Sent):
    """(print, fragment, members) of the sets of documents that a filter lets through."""
    schema = pa.schema([("print", pa.int64()), ("fragment", pa.int32()), ("members", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("slot")
            known = np.asarray(ids.is_null()) | (bits.value[ids.fill_null(0).to_numpy(zero_copy_only=False)] > 0)
            for part in chunks(batch.filter(pa.array(known)), "text"):
                sets, sizes = shingle_sets(Words(part.column("text"), SPACED), k)
                fp = np.repeat(fingerprints(sets, sizes), sizes)
                piece = (sets >> np.uint64(61)).astype(np.int32)
                begin = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (piece[1:] != piece[:-1])])) if len(sets) else np.zeros(0, np.int64)
                members = pa.ListArray.from_arrays(pa.array(np.append(begin, len(sets)), pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.record_batch([pa.array(fp[begin].view(np.int64)), pa.array(piece[begin]), members], schema=schema)

    return task


#: Slots of the filter that keeps texts which are no candidates from being tokenised again: one byte each, whatever the input.
SLOTS = 1 << 22


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(print, fragment, members) of the classes in ``wanted`` (print): their sets, cut into fragments."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")
    chosen = classes.join(wanted, "print", "left_semi").groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    taken = chosen.where("doc_id is not null").select(slot.alias("slot")).distinct()
    bits = np.zeros(SLOTS, np.uint8)
    for batch in taken.toArrow().to_batches():  # at most SLOTS integers
        bits[batch.column(0).to_numpy()] = 1
    sets = docs.select("text", F.when(F.col("doc_id").isNotNull(), slot).alias("slot"))
    sets = sets.mapInArrow(_segments(k, Sent(docs.sparkSession, bits)), "print bigint, fragment int, members array<bigint>")
    return stored(sets.join(wanted, "print", "left_semi").groupBy("print", "fragment").agg(F.first("members").alias("members")))


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, with their overlap: partial overlaps by fragment, summed per pair."""
    left = sets.select(F.col("print").alias("a"), "fragment", F.col("members").alias("ma"))
    right = sets.select(F.col("print").alias("b"), "fragment", F.col("members").alias("mb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ma", "mb")).alias("part"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    return summed.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct()


def _near(percent: int) -> str:
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _schemes(percent: int):
    """Columns for sizes: the size class of one, the last size of a class, and how many members the sets of a scheme differ in at most."""
    first = size_classes(1 << 40, percent)
    differ = F.array(*[F.lit(int(2 * (x - 1) * (100 - percent) // (100 + percent))) for x in first[1:]])
    last = F.array(*[F.lit(int(x - 1)) for x in first[1:]])
    own = lambda n: F.size(F.filter(F.array(*[F.lit(int(x)) for x in first]), lambda x: x <= n))
    return own, lambda t: F.element_at(last, t), lambda t: F.element_at(differ, t.cast("int"))


def _differs(sizes: Column, percent: int) -> Column:
    return F.floor(sizes * (100 - percent) / (100 + percent))


def _needed(percent: int) -> Column:
    """How many fragments a linked pair of sizes na and nb shares at least: those that its differences can't reach.

    Of a scheme's ``differ + 1 + spare`` fragments at most ``spare`` are left out as empty and at most as many differ as
    members do. Sets of one size class meet in two schemes, others in one.
    """
    own, _, differ = _schemes(percent)
    low, high = own(F.least("na", "nb")), own(F.greatest("na", "nb"))
    least = lambda t: differ(t) + 1 - _differs(F.col("na") + F.col("nb"), percent)
    return least(high) + F.when(low == high, least(high + 1)).otherwise(0)


def _least_needed(percent: int) -> Column:
    """The smallest ``_needed`` of a set of size n, whatever the other's size."""
    own, last, differ = _schemes(percent)
    n, t = F.col("n"), own(F.col("n"))
    same = _differs(n + last(t), percent)
    smaller = differ(t) + 1 - _differs(n + F.coalesce(last(F.greatest(t - 1, F.lit(1))), n), percent)
    larger = differ(t + 1) + 1 - _differs(n + F.floor(n * 100 / percent), percent)
    return F.least(differ(t) + differ(t + 1) + 2 - 2 * same, smaller, larger)


def _often(large: DataFrame) -> DataFrame:
    return large.groupBy("print").agg(F.count("*").alias("often"))


def _around_centres(large: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """Pairs of each large group's members with its centre, the member that is in most large groups.

    Of the copies of a text that were each changed a little, that is the text itself. The centres are stored, so that the
    join with a very large group can be split.
    """
    centre = large.join(often, "print").groupBy("key").agg(F.max(F.struct("often", "print", "n")).alias("c")).select("key", F.col("c.print").alias("p"), F.col("c.n").alias("m"))
    ordered = F.col("print") < F.col("p")
    pairs = large.join(stored(centre), "key").where("print != p").select(
        F.least("print", "p").alias("a"), F.greatest("print", "p").alias("b"), F.when(ordered, F.col("n")).otherwise(F.col("m")).alias("na"), F.when(ordered, F.col("m")).otherwise(F.col("n")).alias("nb")
    )
    return pairs.where(_near(percent))


def _met_pairs(met: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, shared): pairs of different sets that met in small groups, and in how many; copies of a set count once."""
    pairs = met.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    for end in ("a", "b"):
        pairs = pairs.join(named.select(F.col("id").alias(end), F.col("print").alias(f"p{end}"), F.col("n").alias(f"n{end}")), end)
    ordered = F.col("pa") < F.col("pb")
    sizes = [F.when(ordered, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("na", "nb"), ("nb", "na"))]
    return pairs.where(f"pa != pb and {_near(percent)}").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), *sizes, "shared").distinct()


def _enough(pairs: DataFrame, large: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """The pairs that meet in as many groups as a linked pair has to.

    First by what the large groups of either set allow; then, where that decides, by the large groups that both are in. These
    are compared as a list for each set, of which a pair is handed the shorter one: one row for each pair. Groups are told by
    32 bits there; those that a list loses as equal are allowed for.
    """
    for end in ("a", "b"):
        pairs = pairs.join(often.select(F.col("print").alias(end), F.col("often").alias(f"l{end}")), end, "left")
    shorter = F.coalesce("la", F.lit(0)) <= F.coalesce("lb", F.lit(0))
    lacking = F.greatest(_needed(percent) - F.col("shared"), F.lit(0))
    pairs = pairs.withColumn("lacking", lacking).where(F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))) >= F.col("lacking"))
    sides = [F.when(shorter, x).otherwise(y).alias(n) for n, x, y in (("x", F.col("a"), F.col("b")), ("y", F.col("b"), F.col("a")))]
    pairs = stored(pairs.select("a", "b", "na", "nb", "lacking", *sides))
    ends = stored(pairs.where("lacking > 0").select(F.explode(F.array("x", "y")).alias("print")).distinct())
    lists = large.join(ends, "print", "left_semi").groupBy("print").agg(F.collect_list(F.hash("key")).alias("all"))
    lists = stored(lists.select("print", F.array_distinct("all").alias("groups"), (F.size("all") - F.size(F.array_distinct("all"))).alias("lost")))
    left, right = (lists.select(F.col("print").alias(c), F.col("groups").alias(f"g{c}"), F.col("lost").alias(f"m{c}")) for c in ("x", "y"))
    both = pairs.where("lacking > 0").join(left, "x").join(right, "y").where(F.size(F.array_intersect("gx", "gy")) + F.col("mx") + F.col("my") >= F.col("lacking"))
    return pairs.where("lacking = 0").select("a", "b", "na", "nb").unionByName(both.select("a", "b", "na", "nb"))


def _across(sets: DataFrame, labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets with different labels that share one of their rarest shingles (prefix filter).

    ``labelled``: print, n, label. Two linked sets share one of the first ``n - ceil(percent*n/100) + 1`` shingles of each,
    in any one order; here the order is by frequency among these sets. What the changed copies of one text have in
    common is frequent and comes last. Of a pair's first common shingle the places bound its overlap, so what is too far
    apart does not meet.
    """
    grams = sets.select("print", F.explode("members").alias("gram"))
    often = stored(grams.groupBy("gram").agg(F.count("*").alias("often")))  # stored: the join with a frequent one can be split
    ranked = grams.join(often, "gram").join(labelled, "print")
    place = F.row_number().over(Window.partitionBy("print").orderBy("often", "gram"))
    prefix = ranked.withColumn("place", place).where(f"place <= n - ceil({percent} * n / 100) + 1 and often > 1")
    prefix = stored(prefix.select("gram", "print", "n", "label", "place"))
    mixed = stored(prefix.groupBy("gram").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("gram"))
    prefix = prefix.join(mixed, "gram", "left_semi")
    x, y = prefix.selectExpr("gram", "print a", "n na", "label la", "place pa"), prefix.selectExpr("gram", "print b", "n nb", "label lb", "place pb")
    most = f"{100 + percent} * (1 + least(na - pa, nb - pb)) >= {percent} * (na + nb)"
    return x.join(y, "gram").where(f"la != lb and a < b and {_near(percent)} and {most}").select("a", "b", "na", "nb").distinct()


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, every_link: bool = True) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and the class and component of each document.

    Takes doc_id and text; other columns are ignored. Returns (links, members):

    * links: ``a``, ``b`` (classes, as 64-bit prints of their sets), ``na``, ``nb``, ``overlap``: all linked pairs, or
      without ``every_link`` (their number can grow with the square of a group of near copies) enough to connect every component;
    * members: one row for each row of docs: ``doc_id``, ``print``, ``n_shingles``, ``component`` (a class of its component),
      ``component_id`` (smallest doc_id there).

    Null text is empty; an empty text links with nothing and its component is its own doc_id. Rows that repeat a doc_id
    are documents of their own with that id. A null doc_id is kept, and does not count for the smallest. Equal sets are
    told by a 64-bit print. docs is read up to three times and, like a stored table, has to give a task that runs again the
    same rows in the same order.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = spread(docs)
    dealt = docs.mapInArrow(_deal(buckets, k, percent), _DEALT)
    met = stored(dealt.groupBy("bucket").applyInArrow(_meet(), _MET), "kind")
    classes = met.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("print"), F.col("n").alias("n_shingles"))
    named = met.where("kind = 3").select(F.col("a").alias("id"), F.col("b").alias("print"), "n")
    large = stored(met.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("id")).join(named, "id").select("key", "print", "n").distinct())
    often = stored(_often(large))
    # Pairs that share no small group share large ones only: too few of them, and a set is in no such linked pair.
    most = stored(large.join(often, "print").where(F.col("often") >= _least_needed(percent)).drop("often"))
    around = tidied(lambda: _around_centres(most, often, percent).distinct())
    pairs_met = _met_pairs(met, named, percent).unionByName(around.withColumn("shared", F.lit(0)))
    pairs_met = pairs_met.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    pairs = tidied(lambda: _enough(pairs_met, large, often, percent))
    removed(large, often, around)
    sets = _sets(docs, classes, _ends(pairs), k)
    links = stored(_verified(sets, pairs, percent))
    removed(sets)
    if every_link:
        apart = most.groupBy("print", "n").agg(F.count("*").alias("often")).withColumn("label", F.col("print"))
    else:
        labels = components(links.select("a", "b"))
        labelled = most.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("label", F.coalesce("label", "print"))
        mixed = stored(labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key"))
        apart = labelled.join(mixed, "key", "left_semi").groupBy("print", "n", "label").agg(F.count("*").alias("often"))
    apart = stored(apart.where(F.col("often") >= _least_needed(percent)).drop("often"))
    removed(most)
    more = not apart.isEmpty()
    if more:
        sets = _sets(docs, classes, apart.select("print"), k)
        across = tidied(lambda: _across(sets, apart, percent).join(pairs, ["a", "b"], "left_anti"))
        links = stored(links.unionByName(_verified(sets, across, percent)))
        removed(sets, across)
    removed(pairs, apart)
    if every_link or more:
        labels = components(links.select("a", "b"))
    named = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("label", "print")).drop("label")
    # Stored, so that the join with a very large component can be split.
    smallest = stored(named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    members = named.join(smallest, "component", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return links, members.select("doc_id", "print", F.col("n_shingles").cast("bigint").alias("n_shingles"), "component", "component_id")


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """Adds n_links to each member, from all links: how many other documents it links with, those of its own class included."""
    copies = members.where("n_shingles > 0").groupBy("print").agg(F.count("*").alias("copies"))
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("print", "other")
    others = ends.join(copies.toDF("other", "more"), "other").groupBy("print").agg(F.sum("more").alias("others"))
    counted = copies.join(others, "print", "left").select("print", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(counted, "print", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
