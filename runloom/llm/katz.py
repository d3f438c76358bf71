"""Katz backoff language model with Good-Turing discounts, trained and applied over whole tables.

The model is a bigram model that backs off to unigrams and from there to one unknown word. With r the count of (v, w) and
c(v) that of the context:

* seen: ``P(w|v) = d_r * r / c(v)``; unseen: ``P(w|v) = alpha(v) * P(w)``; after a context never seen: ``P(w)``;
* ``P(w) = d'_c * c / N`` for a known word, and what is left for the unknown one;
* ``alpha(v)`` is what the discounts leave over ``1 - sum of P(w) over the words seen after v``, so that the probabilities
  after every context, the unknown word's included, sum to 1.

d_r is Katz's Good-Turing discount for r up to ``K``. Counts above keep all but 1/(n+1) of their mass (n: all counts), and so
does a count whose Good-Turing estimate is undefined or not below 1; so every context has something left.

Tables: word counts, and the pair counts partitioned by context. Entries (context, word, document) meet in buckets by
context. The most frequent words are in a broadcast list of bounded size; as contexts they are spread by pair, and pairs of
the very most frequent words are counted in a table of fixed size beforehand, so no bucket has to hold a frequent pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Sent, spread, stored
from .words import SPACED, Words, chunks, constants, mix

K = 5
#: Words in the broadcast list, and of these the first whose pairs are counted densely.
LISTED, DENSE = 1 << 16, 256
FLUSH = 1 << 20
#: Bytes of text for each bucket, entries of a bucket that are worked on at a time, rows in a batch of results, and entries in a row of counts
#: (Spark reads thousands of rows at a time): a task's memory.
BUCKET_BYTES, PIECE, BATCH, COUNTS = 1 << 25, 1 << 19, 1 << 16, 1 << 9
#: Rows of texts in a part and in a flush, so that a row's place in a flush takes 15 bits.
PART_ROWS = 1 << 14

END, BEGIN = (np.uint64(x) for x in constants(2, 777))

#: What documents sum up: pairs by count 1..K and above, log10 of the larger counts, of contexts and of backed-off words together, base score, known tokens.
SUMS = [f"n{r}" for r in range(1, K + 1)] + ["more", "log", "base", "known"]
LOG, BASE, KNOWN = K + 1, K + 2, K + 3
#: What contexts sum up: kinds of pairs by count 1..K, occurrences of the others, probability of the words seen.
LEFT = [f"m{r}" for r in range(1, K + 1)] + ["large", "seen"]


def discounts(of_count: dict[int, int], total: int, k: int = K) -> np.ndarray:
    """d_0 (unused), d_1 ... d_k, and d for larger counts."""
    d = np.full(k + 2, max(total, 1) / (max(total, 1) + 1))
    n = [of_count.get(r, 0) for r in range(k + 2)]
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    if 0 < common < 1:
        for r in range(1, k + 1):
            if n[r]:
                value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < value < d[r]:
                    d[r] = value
    return d


class Vocabulary:
    """The listed words with their counts, and what else of the unigram model has a fixed size."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, of_count: dict[int, int], tokens: int, distinct: int) -> None:
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.tokens, self.distinct = tokens, distinct
        self.d = discounts(of_count, tokens)
        small = sum(r * n * (1 - self.d[r]) for r, n in of_count.items() if r <= K)
        large = tokens - sum(r * n for r, n in of_count.items() if r <= K)
        self.unknown = (small + large * (1 - self.d[K + 1])) / tokens if tokens else 1.0
        frequent = np.sort(np.argsort(-self.counts, kind="stable")[: DENSE - 1])
        self.dense = np.unique(np.append(self.words[frequent], [END, BEGIN]))
        self.dense_at = np.append(self.place(self.words), -1)  # by place in the list, at last for words that aren't in it
        self.pairs = np.zeros((len(self.dense), len(self.dense)), np.int64)

    def count(self, words: np.ndarray) -> np.ndarray:
        """Counts of listed words, -1 for others."""
        return lookup(self.words, self.counts, words)

    def at(self, words: np.ndarray) -> np.ndarray:
        """Places in the list, -1 for other words."""
        return lookup(self.words, np.arange(len(self.words), dtype=np.int32), words)

    def place(self, words: np.ndarray) -> np.ndarray:
        return lookup(self.dense, np.arange(len(self.dense)), words)

    def probability(self, count: np.ndarray) -> np.ndarray:
        """P(w) for words of such counts; 0 stands for the unknown word."""
        if not self.tokens:
            return np.ones(len(count))
        return np.where(count > 0, self.d[np.minimum(count, K + 1)] * count / self.tokens, self.unknown)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, row) of all tokens of a chunk, each text closed by END, and the number of tokens of each row."""
    words = Words(column, SPACED)
    token = np.full(len(words.hash) + words.rows, END, np.uint64)
    token[np.arange(len(words.hash)) + words.doc] = words.hash
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[words.first[:-1] + np.arange(words.rows)] = BEGIN
    return context, token, np.repeat(np.arange(words.rows), words.count + 1), words.count + 1


def before(x: np.ndarray, context: np.ndarray, begin: int) -> np.ndarray:
    """What x has for the tokens, for their contexts; begin stands for BEGIN."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[context == BEGIN] = begin
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        word, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(word.view(np.int64)), pa.array(count)], names=["word", "n"])

    for batch in batches:
        for part in chunks(batch, "text"):
            held.append(sequences(part.column("text"))[1])
            if sum(map(len, held)) > 4 * FLUSH:
                yield flush()
                held.clear()
    if held:
        yield flush()


def _count_dense(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value.dense)
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                context, token, _, _ = sequences(part.column("text"))
                w = shared.value.place(token)
                v = before(w, context, shared.value.place(np.array([BEGIN]))[0])
                both = (v >= 0) & (w >= 0)
                total += np.bincount(v[both] * size + w[both], minlength=size * size)
        cell = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    return task


#: A bucket's entries of one flush, at most ENTRIES in a row, as unsigned 16-bit numbers: places of v and w in the broadcast list or
#: in the row's own list of other words, place in its list of documents, and 4 * count + 2 * (v is listed) + (w is listed).
#: Documents have consecutive keys in a flush, of which start is the first; docs has 2 * (key - start) + (held out).
ENTRIES, MOST = 1 << 15, 16000
_DEALT = "bucket int, start bigint, words array<bigint>, v array<smallint>, w array<smallint>, doc array<smallint>, n array<smallint>, docs array<smallint>, ids array<bigint>, held array<boolean>, own array<double>"
_LISTS = pa.schema(
    [("bucket", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.int64()))] + [(c, pa.list_(pa.int16())) for c in ("v", "w", "doc", "n", "docs")] + [("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("own", pa.list_(pa.float64()))]
)


def short(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16).view(np.int16)


def by_count(r: np.ndarray, row: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """The first K + 2 of SUMS for seen pairs of count r, by row."""
    out = np.zeros((rows, K + 2))
    np.add.at(out, (row, np.minimum(r, K + 1) - 1), n)
    large = r > K
    out[:, K + 1] = np.bincount(row[large], n[large] * np.log10(r[large]), minlength=rows)
    return out


def _deal(shared, buckets: int):
    """Entries by bucket; what listed words contribute to a document is summed here."""

    def own_part(model: Vocabulary, part: pa.RecordBatch):
        context, token, row, tokens = sequences(part.column("text"))
        own = np.zeros((part.num_rows, len(SUMS)))
        at = model.at(token)
        before_at = before(at, context, -1)
        counts = np.append(model.counts, -1)
        count = counts[at]
        listed = count > 0
        own[:, BASE] = np.bincount(row[listed], np.log10(count[listed] + 1.0), minlength=part.num_rows)
        own[:, KNOWN] = np.bincount(row[listed], minlength=part.num_rows)
        c = np.where(context == BEGIN, model.count(np.array([END]))[0], counts[before_at])
        some = c > 0
        v, w = np.where(context == BEGIN, model.place(np.array([BEGIN]))[0], model.dense_at[before_at]), model.dense_at[at]
        r = np.where((v >= 0) & (w >= 0), model.pairs[v, w], 0)
        dense = r > 0
        own[:, : K + 2] = by_count(r[dense], row[dense], np.ones(dense.sum()), part.num_rows)
        own[:, LOG] -= np.bincount(row[some], np.log10(c[some]), minlength=part.num_rows)
        context, token, before_at, at, row, spread_out = (x[~dense] for x in (context, token, before_at, at, row, some | (context == BEGIN)))
        pair = mix(context + mix(token))
        _, first, n = np.unique(mix(pair + row.astype(np.uint64)), return_index=True, return_counts=True)
        if len(n) and n.max() > MOST:  # counts are sent as 16-bit numbers
            times = -(-n // MOST)
            first, n = np.repeat(first, times), np.concatenate([np.append(np.full(t - 1, MOST), x - MOST * (t - 1)) for t, x in zip(times, n, strict=True)])
        key = np.where(spread_out, pair, mix(context))[first]
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return own, tokens, (context[first], token[first], before_at[first], at[first], row[first], n, bucket.astype(np.int64))

    def lists(rows: dict[str, list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(rows[f.name], f.type) for f in _LISTS], schema=_LISTS)

    def flush(start: int, held: np.ndarray, entries: list) -> Iterator[pa.RecordBatch]:
        v, w, v_at, w_at, doc, n, bucket = (np.concatenate(x) for x in zip(*entries, strict=True))
        n = n * 4 + (v_at >= 0) * 2 + (w_at >= 0)
        order = np.argsort(bucket * (2 * PART_ROWS) + doc)
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows: dict[str, list] = {f.name: [] for f in _LISTS}
        for b, at in ((b, order[a : min(a + ENTRIES, cut[b + 1])]) for b in np.flatnonzero(np.diff(cut)) for a in range(cut[b], cut[b + 1], ENTRIES)):
            vi, wi = v_at[at], w_at[at]
            words, index = np.unique(np.concatenate([v[at][vi < 0], w[at][wi < 0]]), return_inverse=True)
            vi[vi < 0], wi[wi < 0] = np.split(index, [(vi < 0).sum()])
            docs = doc[at]
            new = np.append(True, docs[1:] != docs[:-1])
            docs, doc_index = docs[new], np.cumsum(new) - 1
            for name, x in (("bucket", b), ("start", start), ("words", words.view(np.int64)), ("v", short(vi)), ("w", short(wi)), ("doc", short(doc_index)), ("n", short(n[at])), ("docs", short(docs * 2 + held[docs])), ("held", []), ("ids", []), ("own", [])):
                rows[name].append(x)
            if len(rows["bucket"]) >= 64:
                yield lists(rows)
                rows = {f.name: [] for f in _LISTS}
        if rows["bucket"]:
            yield lists(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40  # a key for each row: the same when a task is run again
        entries, helds, rows, size = [], [], 0, 0
        for batch in batches:
            for part in (x.slice(i, PART_ROWS) for x in chunks(batch, "text") for i in range(0, x.num_rows, PART_ROWS)):
                own, tokens, (v, w, v_at, w_at, row, n, bucket) = own_part(shared.value, part)
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                where = -1 - int(mix(np.array([at], np.uint64))[0] % np.uint64(buckets))
                yield lists({"bucket": [where], "start": [at], "words": [[]], "v": [[]], "w": [[]], "doc": [[]], "n": [[]], "docs": [[]], "ids": [part.column("doc_id").to_pylist()], "held": [held], "own": [np.column_stack([tokens, own]).ravel()]})
                at += part.num_rows
                entries.append((v, w, v_at, w_at, row + rows, n, bucket))
                helds.append(held)
                rows, size = rows + part.num_rows, size + len(v)
                if size >= FLUSH or rows >= PART_ROWS:
                    yield from flush(at - rows, np.concatenate(helds), entries)
                    entries, helds, rows, size = [], [], 0, 0
        if size:
            yield from flush(at - rows, np.concatenate(helds), entries)

    return task


#: kind 0: entries of a flush (key: its first document) by place of the document, times, count r of the pair and count c of a context that is whole
#: in its bucket. 1: unseen pairs (key: document, v, w unless listed, n, x: log10 of a listed word's probability). 2: a context's sums (v). 3: an
#: unlisted word seen after a context (v, w). 4: kinds of pairs (n) with count v. 5: a document (key), its id, n tokens.
#: x: LEFT of kind 2, SUMS of kind 5.
_LONG = "doc array<smallint>, times array<smallint>, r array<int>, c array<int>"
_SCORED = f"kind tinyint, key bigint, v bigint, w bigint, n bigint, held boolean, x array<double>, {_LONG}"


def named(names: list[str]) -> list[Column]:
    return [F.col("x")[i].alias(c) for i, c in enumerate(names)]


def _flat(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([x.column(name).flatten().to_numpy(zero_copy_only=False) for x in batches])


class Entries:
    """A bucket's entries, as compact as they were dealt; some at a time are unpacked."""

    def __init__(self, model: Vocabulary, batches: list[pa.RecordBatch]) -> None:
        self.model, self.start = model, np.concatenate([x.column("start").to_numpy() for x in batches])
        self.end, self.words_end, self.docs_end = (np.cumsum(np.concatenate([x.column(c).value_lengths().to_numpy() for x in batches]), dtype=np.int64) for c in ("v", "words", "docs"))
        self.v, self.w, self.doc, self.n, self.docs = (_flat(batches, c).view(np.uint16) for c in ("v", "w", "doc", "n", "docs"))
        self.words = _flat(batches, "words").view(np.uint64)
        self.size = len(self.v)

    def spans(self) -> Iterator[np.ndarray]:
        for at in range(0, self.size, PIECE):
            yield np.arange(at, min(at + PIECE, self.size))

    def flushes(self, at: np.ndarray) -> np.ndarray:
        """Where the first documents of the flushes are that entries at ascending places come from."""
        return self.start[np.searchsorted(self.end, at, "right")]

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """v and w of entries at ascending places."""
        row = np.searchsorted(self.end, at, "right")
        base = np.concatenate([[0], self.words_end])[row]

        def words_at(places: np.ndarray, listed: np.ndarray) -> np.ndarray:
            out = np.empty(len(at), np.uint64)
            out[listed] = self.model.words[places[listed]]
            out[~listed] = self.words[(places + base)[~listed]]
            return out

        return words_at(self.v[at], self.n[at] & 2 > 0), words_at(self.w[at], self.n[at] & 1 > 0)

    def documents(self, at: np.ndarray) -> np.ndarray:
        """Places in docs of entries at ascending places: a document has one for each row of entries."""
        row = np.searchsorted(self.end, at, "right")
        return self.doc[at] + np.concatenate([[0], self.docs_end])[row]

    def held(self, doc: np.ndarray) -> np.ndarray:
        return self.docs[doc] & 1 > 0

    def keys(self, doc: np.ndarray) -> np.ndarray:
        return self.start[np.searchsorted(self.docs_end, doc, "right")] + (self.docs[doc] >> 1)

    def whole(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Contexts that aren't listed are whole in a bucket, so their counts are known: as words they are these documents' tokens, too."""
        return (self.n[at] & 2 == 0) & (v != BEGIN)

    def count(self, at: np.ndarray) -> np.ndarray:
        """Counts of listed w, -1 for others."""
        out = np.full(len(at), -1)
        listed = self.n[at] & 1 > 0
        out[listed] = self.model.counts[self.w[at[listed]]]
        return out

    def pieces(self) -> Iterator[np.ndarray]:
        """Places of entries by hash: a pair is in one piece, and so is a context that isn't listed."""
        count = -(-self.size // PIECE)
        if count <= 1:
            yield np.arange(self.size)
            return
        piece = np.empty(self.size, np.uint16 if count < 1 << 16 else np.int64)
        for at in self.spans():
            v, w = self.pairs(at)
            key = mix(np.where(self.whole(at, v), mix(v), mix(v + mix(w))))
            piece[at] = ((key >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        for p in range(count):
            yield np.flatnonzero(piece == p)


def _score(shared):
    def rows(kind: int, size: int, **cells) -> Iterator[pa.RecordBatch]:
        for at in range(0, size, BATCH):
            part = {k: x[at : at + BATCH] for k, x in cells.items()}
            n = min(BATCH, size - at)
            columns = {"kind": pa.array(np.full(n, kind, np.int8))}
            for name in ("key", "v", "w", "n"):
                columns[name] = part[name] if isinstance(part.get(name), pa.Array) else pa.array(part[name], pa.int64()) if name in part else pa.nulls(n, pa.int64())
            columns["held"] = pa.array(part["held"], pa.bool_()) if "held" in part else pa.nulls(n, pa.bool_())
            x = part.get("x")
            sizes = pa.array(np.arange(n + 1) * (x.shape[1] if x is not None else 0), pa.int32())
            columns["x"] = pa.nulls(n, pa.list_(pa.float64())) if x is None else pa.ListArray.from_arrays(sizes, pa.array(x.ravel()))
            for name, dtype in (("doc", pa.int16()), ("times", pa.int16()), ("r", pa.int32()), ("c", pa.int32())):
                columns[name] = part.get(name, pa.nulls(n, pa.list_(dtype)))
            yield pa.RecordBatch.from_pydict(columns)

    def counts(flush: np.ndarray, **columns) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0: entries of one flush stand together, COUNTS at most in a row."""
        place = np.arange(len(flush))
        first = np.maximum.accumulate(np.where(np.append(True, flush[1:] != flush[:-1])[: len(flush)], place, 0))
        cut = np.flatnonzero((place - first) % COUNTS == 0)
        ends = pa.array(np.append(cut, len(flush)), pa.int32())
        yield from rows(0, len(cut), key=flush[cut], **{k: pa.ListArray.from_arrays(ends, pa.array(x)) for k, x in columns.items()})

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Vocabulary = shared.value
        batches = list(batches)
        if batches[0].column("bucket")[0].as_py() < 0:
            for batch in batches:
                size = batch.column("ids").value_lengths().to_numpy().astype(np.int64)
                own = _flat([batch], "own").reshape(-1, len(SUMS) + 1)
                key = np.repeat(batch.column("start").to_numpy() - (np.cumsum(size) - size), size) + np.arange(len(own))
                yield from rows(5, len(own), key=key, v=batch.column("ids").flatten(), n=own[:, 0].astype(np.int64), held=_flat([batch], "held"), x=own[:, 1:])
            return
        entries = Entries(model, batches)
        del batches
        # Count of each entry's pair and, of contexts that are whole here, of its context.
        pair_count, context_count = np.zeros(entries.size, np.int32), np.zeros(entries.size, np.int32)
        in_pieces = np.zeros((len(model.words) + 1, len(LEFT)))  # of contexts that aren't whole in a piece: the listed ones, at last BEGIN
        for at in entries.pieces():
            v, w = entries.pairs(at)
            _, first, pair = np.unique(mix(v + mix(w)), return_index=True, return_inverse=True)
            v, w, of_pair = v[first], w[first], at[first]
            taught = np.where(entries.held(entries.documents(at)), 0, entries.n[at] >> 2)
            r = np.bincount(pair, taught, minlength=len(first)).astype(np.int64)
            contexts, of_context, context = np.unique(v, return_index=True, return_inverse=True)
            of_context = of_pair[of_context]
            whole = entries.whole(of_context, contexts)
            total = np.where(whole, np.bincount(context, r, minlength=len(contexts)).astype(np.int64), 0)
            pair_count[at], context_count[at] = r[pair], total[context][pair]
            # Of contexts: all that may be spread over buckets, and those from which something here backs off.
            needed = ~whole
            needed[context[r == 0]] = True
            kind = (r > 0) & needed[context]
            kv, kr, kw = context[kind], r[kind], w[kind]
            left = np.zeros((len(contexts), len(LEFT)))
            small = kr <= K
            np.add.at(left, (kv[small], kr[small] - 1), 1)
            left[:, K] = np.bincount(kv[~small], kr[~small], minlength=len(contexts))
            count = entries.count(of_pair[kind])
            left[:, K + 1] = np.bincount(kv[count > 0], model.probability(np.maximum(count, 0))[count > 0], minlength=len(contexts))
            in_pieces[np.where(contexts == BEGIN, -1, entries.v[of_context].astype(np.int64))[~whole]] += left[~whole]
            some = np.unique(kv)
            some = some[whole[some]]
            yield from rows(2, len(some), v=contexts[some].view(np.int64), x=left[some])
            cold = count <= 0
            yield from rows(3, int(cold.sum()), v=contexts[kv[cold]].view(np.int64), w=kw[cold].view(np.int64))
            # Dense pairs that no training text has are held out only, so r is 0 and they are not counted here.
            levels, kinds = np.unique(np.minimum(r[r > 0], K + 2), return_counts=True)
            yield from rows(4, len(levels), v=levels, n=kinds)
        some = np.flatnonzero(in_pieces.any(1))
        yield from rows(2, len(some), v=np.append(model.words, BEGIN)[some].view(np.int64), x=in_pieces[some])
        for at in entries.spans():
            r, c = pair_count[at], context_count[at]
            some = (r > 0) | (c > 0)
            place = entries.docs[entries.documents(at[some])] >> 1
            yield from counts(entries.flushes(at[some]), doc=place.view(np.int16), times=(entries.n[at[some]] >> 2).view(np.int16), r=r[some], c=c[some])
            at = at[r == 0]
            v, w = entries.pairs(at)
            count = entries.count(at)
            low = np.where(count > 0, np.log10(model.probability(np.maximum(count, 0))), 0.0)
            backed = pa.array(w.view(np.int64), mask=count > 0)
            yield from rows(1, len(at), key=entries.keys(entries.documents(at)), v=v.view(np.int64), w=backed, n=entries.n[at] >> 2, x=low[:, None])

    return bucket


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS of the documents of one flush."""
    sums, start = np.zeros((2 * PART_ROWS, len(SUMS))), 0
    for batch in batches:
        start = batch.column("key")[0].as_py()
        doc, n, r, c = (_flat([batch], x).astype(np.int64) for x in ("doc", "times", "r", "c"))
        seen, known = r > 0, c > 0
        sums[:, : K + 2] += by_count(r[seen], doc[seen], n[seen], len(sums))
        d, n, c = doc[known], n[known], c[known]
        sums[:, BASE] += np.bincount(d, n * np.log10(c + 1.0), minlength=len(sums))
        sums[:, KNOWN] += np.bincount(d, n, minlength=len(sums))
        sums[:, LOG] -= np.bincount(d, n * np.log10(c), minlength=len(sums))
    some = np.flatnonzero(sums.any(1))
    x = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * len(SUMS), pa.int32()), pa.array(sums[some].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(start + some), x], names=["key", "x"])


def _log(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1e-300)))


def _level() -> Column:
    """Counts in steps of an eighth of a doubling: some hundred levels whatever the counts."""
    return F.floor(F.log2(F.col("n").cast("double")) * 8)


def _listed_from(words: DataFrame) -> int:
    """The lowest level from which on there are less than LISTED words; no task sorts the words for that."""
    least, total = 1 << 30, 0
    for level, n in sorted(map(tuple, words.groupBy(_level().alias("l")).count().collect()), reverse=True):
        total += n
        if total >= LISTED:
            break
        least = level
    return least


def katz_scores(docs: DataFrame) -> DataFrame:
    """Scores all texts by a model of those that are not held out.

    Takes doc_id, text and held_out (null: false); other columns are ignored. Returns for each row doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score and score: log10 probabilities of the whole text, its end included. A null
    text is empty: one token, its end. Rows that repeat a doc_id are texts of their own. Without training texts every
    token is the unknown word, with probability 1. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held"))
    training = docs.where("not held").select("text")
    words = stored(training.mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    of_count = {r.n: r.c for r in words.where(f"n <= {K + 1}").groupBy("n").agg(F.count("*").alias("c")).collect()}
    end = int(END.view(np.int64))
    listed = words.where((F.col("word") == end) | (_level() >= _listed_from(words))).toArrow()
    model = Vocabulary(listed["word"].to_numpy().view(np.uint64), listed["n"].to_numpy(), of_count, totals.tokens, totals.distinct)
    cells = training.mapInArrow(_count_dense(Sent(spark, model)), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    model.pairs.ravel()[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    shared = Sent(spark, model)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(spread(docs, 2), -(-size // BUCKET_BYTES))
    scored = stored(docs.mapInArrow(_deal(shared, buckets), _DEALT).groupBy("bucket").applyInArrow(_score(shared), _SCORED), "kind")

    dense_v, dense_w = np.nonzero(model.pairs)
    r = model.pairs[dense_v, dense_w]
    of_pairs = {int(x.v): x.n for x in scored.where("kind = 4").groupBy("v").agg(F.sum("n").alias("n")).collect()}
    for x in r[r <= K + 1].tolist():
        of_pairs[x] = of_pairs.get(x, 0) + 1
    d = discounts(of_pairs, totals.tokens)
    left = np.zeros((len(model.dense), len(LEFT)))
    small = r <= K
    np.add.at(left, (dense_v[small], r[small] - 1), 1)
    left[:, K] = np.bincount(dense_v[~small], r[~small], minlength=len(model.dense))
    left[:, K + 1] = np.bincount(dense_v, model.probability(model.count(model.dense[dense_w])), minlength=len(model.dense))
    table = pa.table({"v": model.dense.view(np.int64)} | {c: left[:, i] for i, c in enumerate(LEFT)})
    dense = spark.createDataFrame(table).where("+".join(LEFT) + " > 0")

    def unigram(rows: DataFrame) -> DataFrame:
        """Joins p, the unigram probability of w."""
        rate = F.element_at(F.array(*[F.lit(float(x)) for x in model.d[1:]]), F.least("c", F.lit(K + 1)).cast("int"))
        known = words.select(F.col("word").alias("w"), F.col("n").alias("c")).withColumn("p", rate * F.col("c") / max(1, totals.tokens)).drop("c")
        return rows.join(known, "w", "left").withColumn("p", F.coalesce("p", F.lit(float(model.unknown))))

    unlisted = unigram(scored.where("kind = 3").select("v", "w")).groupBy("v").agg(F.sum("p").alias("p"))
    contexts = scored.where("kind = 2").select("v", *named(LEFT)).unionByName(dense).groupBy("v").agg(*[F.sum(c).alias(c) for c in LEFT])
    remains = sum((F.col(f"m{x}") * float(x * (1 - d[x])) for x in range(1, K + 1)), F.col("large") * float(1 - d[K + 1]))
    free = 1 - F.col("seen") - F.coalesce("p", F.lit(0.0))
    alpha = contexts.join(unlisted, "v", "left").select("v", (_log(remains) - _log(free)).alias("alpha"))
    unseen = scored.where("kind = 1").select("key", "v", "w", "n", F.col("x")[0].alias("low"))
    backed = unigram(unseen).join(alpha, "v", "left")
    low = F.when(F.col("w").isNull(), F.col("low")).otherwise(_log(F.col("p")))
    backed = backed.groupBy("key").agg(F.sum(F.col("n") * (low + F.coalesce("alpha", F.lit(0.0)))).alias("log"))
    counted = scored.where("kind = 0").select("key", "doc", "times", "r", "c").groupBy("key").applyInArrow(_sum_up, "key bigint, x array<double>")
    parts = scored.where("kind = 5").select("key", "x").unionByName(counted).select("key", *named(SUMS)).unionByName(backed, allowMissingColumns=True)
    total = parts.groupBy("key").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMS])
    score = sum((F.col(f"n{x}") * float(np.log10(x * d[x])) for x in range(1, K + 1)), F.col("more") * float(np.log10(d[K + 1])))
    score = score + F.col("log")
    base = F.col("base") - F.col("n") * float(np.log10(totals.tokens + totals.distinct + 1))
    ids = scored.where("kind = 5").select("key", F.col("v").alias("doc_id"), "n", F.col("held").alias("held_out"))
    return ids.join(total, "key").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), F.col("known").cast("bigint").alias("n_known"), F.lit(totals.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), score.alias("score")
    )
