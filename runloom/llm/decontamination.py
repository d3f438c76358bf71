"""Benchmark decontamination with suffix arrays of the training texts.

Each chunk of training text is a shard: the array of all its word positions, sorted by the words that follow to the end
of their text (prefix doubling; no further than the longest benchmark item reaches). Every distinct benchmark window is
looked up in each shard by binary search, word after word, until its range of the array is empty. The ranges that are
left are the places of the window; they are painted as ranges and never listed pair by pair, so texts and items that
repeat one word cost no more than others. Where locations are asked for, the suffixes of the affected texts and items
are sorted together, and the longest match of a place is the longer common prefix with its two neighbours in that order.

The benchmark is broadcast in blocks of bounded size; a task tokenises and sorts a shard once and holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import Sent
from .words import PLAIN, Words, chunks, mix, runs

#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20


class Block:
    """Some benchmark items: their words, and their distinct windows, each with the items that have it."""

    def __init__(self, ids: list, texts: list[str], window: int) -> None:
        words = Words(pa.array(texts, pa.string()), PLAIN)
        self.ids = sorted(set(ids))
        order = {x: i for i, x in enumerate(self.ids)}
        self.hash, self.row = words.hash, words.doc
        self.item = np.array([order[x] for x in ids], np.int64)
        self.first = words.first
        at, size, key = self._windows(words, window)
        by = np.lexsort((self.item[words.doc[at]], key))
        at, size, key, item = at[by], size[by], key[by], self.item[words.doc[at]][by]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        self.start, self.length = at[new], size[new]
        self.longest, self.window = int(words.count.max(initial=0)), window
        self.list, self.list_item, self.list_end = self._lists(np.cumsum(new) - 1, item)

    def items_of(self, which: int) -> np.ndarray:
        return self.list_item[self.list_end[which] : self.list_end[which + 1]]

    @staticmethod
    def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, number of words and hash of all windows; an item of fewer words, but not none, is one window."""
        key, at = runs(words.hash, words.doc, window)
        parts = [(at, np.full(len(at), window), key)]
        for n in np.unique(words.count[(words.count > 0) & (words.count < window)]):
            key, at = runs(words.hash, words.doc, int(n))
            own = words.count[words.doc[at]] == n
            parts.append((at[own], np.full(own.sum(), n), mix(key[own] + np.uint64(n))))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _lists(window: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list of items of each window, and the distinct lists: items one list after the other, and where each ends."""
        new = np.concatenate([[True], (window[1:] != window[:-1]) | (item[1:] != item[:-1])]) if len(window) else np.zeros(0, bool)
        window, item = window[new], item[new]
        begin = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else window
        if not len(begin):
            return window, item, np.zeros(1, np.int64)
        size = np.diff(np.append(begin, len(window)))
        key = mix(np.add.reduceat(mix(item.astype(np.uint64) + np.uint64(1)), begin) + size.astype(np.uint64))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        places = np.repeat(begin[first] - np.cumsum(size[first]) + size[first], size[first]) + np.arange(size[first].sum())
        return of, item[places], np.concatenate([[0], np.cumsum(size[first])])


def sorted_suffixes(ranks: np.ndarray, end: np.ndarray, places: np.ndarray, depth: int, levels: list | None = None) -> np.ndarray:
    """``places`` in order of the words that follow each, up to ``depth`` of them.

    ``ranks``: words as numbers from 1, and 0 at the end of each text; ``end``: where the text of each place ends. Prefix
    doubling: what is sorted by k words is sorted by 2k with the ranks of the places k further; places that are alone
    already stay. ``levels`` is given the ranks by 1, 2, 4, ... words.
    """
    order = places[np.argsort(ranks[places], kind="stable")]
    rank = np.zeros(len(ranks), np.int64)
    slot = np.arange(len(order))

    def renumber(slots: np.ndarray, changes: np.ndarray) -> np.ndarray:
        """Gives the places in ``slots`` the first slot of their group, from 1; returns the slots of groups of several."""
        begin = np.flatnonzero(changes)
        size = np.diff(np.append(begin, len(slots)))
        rank[order[slots]] = np.repeat(slots[begin] + 1, size)
        return slots[np.repeat(size > 1, size)]

    word = ranks[order]
    rest = renumber(slot, np.concatenate([[True], word[1:] != word[:-1]])) if len(order) else slot
    if levels is not None:
        levels.append(rank.copy())
    k = 1
    while k < depth and len(rest):
        at = order[rest]
        key = rank[at] * (len(ranks) + 1) + rank[np.minimum(at + k, end[at])]
        by = np.argsort(key, kind="stable")
        order[rest], key = at[by], key[by]
        rest = renumber(rest, np.concatenate([[True], key[1:] != key[:-1]]))
        if levels is not None:
            levels.append(rank.copy())
        k *= 2
    return order


class Shard:
    """The suffix array of a chunk of texts."""

    def __init__(self, words: Words, depth: int) -> None:
        self.words = words
        self.known, number = np.unique(words.hash, return_inverse=True)
        self.place = np.arange(len(number)) + words.doc  # a text is followed by a place for its end
        self.ranks = np.zeros(len(number) + words.rows, np.int64)
        self.ranks[self.place] = number + 1
        self.doc = np.repeat(np.arange(words.rows), words.count + 1)
        self.end = (words.first[1:] + np.arange(words.rows))[self.doc]
        self.order = sorted_suffixes(self.ranks, self.end, self.place, depth)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Words as this shard's numbers; 0 for words it doesn't have."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def search(self, numbers: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first slot, end): the windows that occur, and the range of the array in which they stand."""
        missing = np.concatenate([[0], np.cumsum(numbers == 0)])
        found = np.flatnonzero(missing[start + length] == missing[start])
        low, high = np.zeros(len(found), np.int64), np.full(len(found), len(self.order), np.int64)
        for d in range(int(length.max(initial=0))):
            going = length[found] > d
            wanted = numbers[start[found[going]] + d]
            low[going], high[going] = (self._bound(low[going], high[going], wanted, d, side) for side in (0, 1))
            some = low < high
            found, low, high = found[some], low[some], high[some]
            if not len(found):
                break
        return found, low, high

    def _bound(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, d: int, side: int) -> np.ndarray:
        """Binary search for all windows at once: the first slot whose word ``d`` is not below (side 1: is above) the wanted one."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = self.order[np.minimum(middle, len(self.order) - 1)]
            word = self.ranks[np.minimum(at + d, self.end[at])]
            right = open_ & (word < wanted + side)
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        return low


class Findings:
    """What blocks of benchmark have in common with the texts of a shard."""

    def __init__(self, shard: Shard, locate: bool) -> None:
        self.shard, size = shard, len(shard.ranks) + 1
        self.cover = np.zeros(size, np.int64)
        self.items: dict[int, set] = {}
        self.best = np.zeros(size, np.int64) if locate else None
        self.item = np.full(size, None, object) if locate else None
        self.item_start = np.zeros(size, np.int64)

    def add(self, block: Block) -> None:
        shard = self.shard
        numbers = shard.numbers(block.hash)
        found, low, high = shard.search(numbers, block.start, block.length)
        for n in np.unique(block.length[found]):  # the ranges of windows of one length don't overlap
            own = block.length[found] == n
            size = high[own] - low[own]
            slots = np.repeat(low[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
            at, lists = shard.order[slots], np.repeat(block.list[found[own]], size)
            self.cover[at] += 1
            np.add.at(self.cover, at + n, -1)
            n_lists = len(block.list_end)
            for x in np.unique(shard.doc[at] * n_lists + lists).tolist():
                self.items.setdefault(x // n_lists, set()).update(block.ids[i] for i in block.items_of(x % n_lists))
            if self.best is not None and n < block.window:  # an item as a whole: there is no longer match
                more = self.best[at] < n
                self.best[at[more]], self.item_start[at[more]] = n, 0
                self.item[at[more]] = [block.ids[i] for i in block.list_item[block.list_end[lists[more]]]]
            elif self.best is not None:
                self._locate(block, numbers, at, np.unique(lists))

    def _locate(self, block: Block, numbers: np.ndarray, starts: np.ndarray, lists: np.ndarray) -> None:
        """The longest match from each place of ``starts`` with the items in ``lists``."""
        shard = self.shard
        asked = np.zeros(len(shard.ranks), bool)
        asked[starts] = True
        ours = np.flatnonzero(np.isin(shard.doc, np.unique(shard.doc[starts])))
        wanted = np.unique(np.concatenate([block.items_of(x) for x in lists]))
        rows = np.flatnonzero(np.isin(block.item, wanted))
        rows = rows[np.argsort(block.item[rows], kind="stable")]
        theirs = np.concatenate([np.arange(block.first[r], block.first[r + 1] + 1) for r in rows])  # one more for the end
        number = np.append(numbers, 0)[theirs]
        number = np.where(number > 0, number, len(shard.known) + 1 + np.arange(len(number)))  # words that are not here match nothing
        number[np.cumsum([block.first[r + 1] - block.first[r] + 1 for r in rows]) - 1] = 0
        ranks = np.concatenate([shard.ranks[ours], number])
        stops = np.flatnonzero(ranks == 0)
        end = stops[np.searchsorted(stops, np.arange(len(ranks)))]
        levels: list[np.ndarray] = []
        order = sorted_suffixes(ranks, end, np.flatnonzero(ranks > 0), block.longest, levels)
        slot, item = np.arange(len(order)), order >= len(ours)
        before = np.maximum.accumulate(np.where(item, slot, -1))
        after = np.minimum.accumulate(np.where(item, slot, len(order))[::-1])[::-1]
        text = np.flatnonzero(~item)
        text = text[asked[ours[order[text]]]]
        best, which = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for neighbour in (after[text], before[text]):
            some = np.flatnonzero((neighbour >= 0) & (neighbour < len(order)))
            there = order[neighbour[some]]
            length = common_prefix(levels, end, order[text[some]], there)
            longer = length > best[some]
            best[some[longer]], which[some[longer]] = length[longer], there[longer]
        at, source = ours[order[text]], theirs[which - len(ours)]
        more = best > self.best[at]
        at, source = at[more], source[more]
        row = block.row[source]
        self.best[at], self.item_start[at] = best[more], source - block.first[row]
        self.item[at] = [block.ids[i] for i in block.item[row]]

    def hits(self) -> np.ndarray:
        """Words of each text inside an occurrence of a window."""
        inside = np.zeros(len(self.cover), bool)
        inside[self.shard.place] = (np.cumsum(self.cover) > 0)[self.shard.place]
        return np.bincount(self.shard.doc[inside[:-1]], minlength=self.shard.words.rows)

    def matches(self) -> tuple[list[list[dict]], np.ndarray]:
        """The matches of each text that lie in no other found from the place before, and the longest one's words."""
        words, best = self.shard.words, self.best
        at = np.flatnonzero((best > 0) & (np.concatenate([[0], best[:-1]]) <= best))
        doc = self.shard.doc[at]
        listed: list[list[dict]] = [[] for _ in range(words.rows)]
        for p, d, n in zip(at.tolist(), doc.tolist(), best[at].tolist(), strict=True):
            listed[d].append({"start": p - int(words.first[d]) - d, "length": n, "item": self.item[p], "item_start": int(self.item_start[p])})
        most = np.zeros(words.rows, np.int64)
        np.maximum.at(most, doc, best[at])
        return listed, most


def common_prefix(levels: list[np.ndarray], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b have in common: those that 2**k words agree go that far, from the largest k."""
    most = np.minimum(end[a] - a, end[b] - b)
    i, j, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][i] == levels[k][j]) & (length < most)
        length = np.where(same, length + (1 << k), length)
        i, j = np.where(same, np.minimum(a + length, end[a]), i), np.where(same, np.minimum(b + length, end[b]), j)
    return np.minimum(length, most)


def _task(blocks: list[Sent], depth: int, schema: pa.Schema, locate: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                shard = Shard(Words(part.column("text"), PLAIN), depth)
                found = Findings(shard, locate)
                for block in blocks:
                    found.add(block.value if len(blocks) == 1 else block.once())
                cells = {"n_words": shard.words.count, "n_hit": found.hits(), "items": [sorted(found.items.get(r, ())) for r in range(part.num_rows)]}
                if locate:
                    cells["matches"], cells["longest"] = found.matches()
                yield pa.record_batch([pa.array(cells[f.name], f.type) if f.name in cells else part.column(f.name) for f in schema], schema=schema)

    return task


def blocks_of(benchmark: DataFrame, window: int) -> Iterator[Block]:
    """The benchmark in blocks, read one after the other: the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string"))
    for row in rows.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= BLOCK_BYTES:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, locate: bool = True) -> DataFrame:
    """Adds what the benchmark and each text have in common.

    Takes text of docs and item_id (any type that has an order), text of benchmark. Adds n_words, n_hit (words inside an
    occurrence of a window of ``window`` words of an item; an item of fewer words is one window) and items (item_ids
    with such windows, sorted). With ``locate`` also matches (for each place from which a window occurs the longest
    verbatim match with any item: place in the text, words, an item and the place there; not those that only continue the
    match from the place before) and longest (words of the longest). Null texts and texts without words have none; items
    that are null or have no words match nothing; rows that repeat an item_id are one item. Columns of these names are replaced.
    """
    item = benchmark.schema["item_id"].dataType.simpleString()
    added = T._parse_datatype_string(f"n_words bigint, n_hit bigint, items array<{item}>" + f", matches array<struct<start:int,length:int,item:{item},item_start:int>>, longest int" * locate)
    keep = [c for c in docs.columns if c not in added.names]
    docs = docs.select(*keep).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    depth, blocks = 1, []
    for block in blocks_of(benchmark, window):
        depth = max(depth, block.longest)
        blocks.append(Sent(docs.sparkSession, block))
    return docs.mapInArrow(_task(blocks, depth, to_arrow_schema(schema), locate), schema)


def items_digest(items: str = "items"):
    """SHA-256 of the item_ids, sorted as text and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",").cast("binary"), 256)
