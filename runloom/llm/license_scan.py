"""License scans with a positional rare-token index.

The index posts the rarer words of the license templates with their positions; a word's inverse document frequency is that of
the scanned corpus itself, counted over all its texts. Of each file the licence words of the highest IDF are looked up,
template by template; a posting votes for a template at the relative position (place in the text minus place in the template). Where
at least two different words (or the only one) agree on one, the template is compared there, and counts if its mandatory key
phrases stand at their places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .licenses import TEMPLATES, Template
from .shared import Sent
from .words import PLAIN, Words, chunks

#: Words of a template that are posted at least (or all, if it has fewer).
LEAST_POSTED = 4
#: Label and phrase: a place where the phrase's words stand one after the other has the label.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

FOUND = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, matches array<struct<label:string,word:int,words:int,share:double>>, license_score double"


def _hashes(text: str) -> np.ndarray:
    return Words(pa.array([text]), PLAIN).hash


class Index:
    """Postings (word, template, place) of the rarer words of the templates, sorted by word, and each word's inverse document frequency.

    Of a template's distinct words the rarer half is posted, ``posted`` at most and LEAST_POSTED at least.
    """

    def __init__(self, templates: list[Template], frequency: dict[int, int], documents: int, rare: int, posted: int) -> None:
        self.rare, self.labels = rare, [t.label for t in templates]
        self.words = [_hashes(t.text) for t in templates]
        idf = lambda w: math.log((1 + documents) / (1 + frequency.get(w, 0)))
        entries, self.need = [], []
        for t, words in enumerate(self.words):
            listed = words.view(np.int64).tolist()
            first = {w: listed.index(w) for w in set(listed)}
            best = sorted(first, key=lambda w: (-idf(w), first[w]))[: max(LEAST_POSTED, min(posted, (len(first) + 1) // 2))]
            entries += [(w, t, p) for p, w in enumerate(listed) if w in set(best)]
            self.need.append(min(2, len(best)))
        self.need = np.array(self.need)
        self.known, number = np.unique(np.array([w for w, _, _ in entries], np.int64).view(np.uint64), return_inverse=True)
        self.idf = np.array([idf(w) for w in self.known.view(np.int64).tolist()])
        template, place = (np.array([e[i] for e in entries], np.int64) for i in (1, 2))
        order = np.argsort(number, kind="stable")
        self.template, self.place, self.begin = template[order], place[order], np.searchsorted(number[order], np.arange(len(self.known) + 1))
        # Each word's templates once, with its first place there, which breaks ties.
        pair = number * (len(templates) + 1) + template
        pair, first = np.unique(pair, return_index=True)
        self.own_template, self.own_place = pair % (len(templates) + 1), place[first]
        self.own_begin = np.searchsorted(pair // (len(templates) + 1), np.arange(len(self.known) + 1))
        self.keys = [[(int(np.flatnonzero(phrase_at(w, p))[0]), p) for p in map(_hashes, t.keys)] for t, w in zip(templates, self.words, strict=True)]

    def chosen(self, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Sorted codes of (row, template, word): for each row and template the ``rare`` words of the highest IDF that the row has.

        Ties go to the word that comes first in the template. Where too few are there, none is chosen.
        """
        pair = np.unique(row * len(self.known) + word)
        row, word = pair // len(self.known), pair % len(self.known)
        at, each = expanded(self.own_begin, word)
        row, word, template, place = row[at], word[at], self.own_template[each], self.own_place[each]
        order = np.lexsort((place, -self.idf[word], template, row))
        row, word, template = row[order], word[order], template[order]
        group = row * len(self.labels) + template
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else order
        size = np.diff(np.append(begin, len(group)))
        rank = np.arange(len(group)) - np.repeat(begin, size)
        keep = (rank < self.rare) & (np.repeat(size, size) >= self.need[template])
        return np.sort(self.code(row[keep], template[keep], word[keep]))

    def code(self, row: np.ndarray, template: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (row * len(self.labels) + template) * len(self.known) + word

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, template, place of the template's first word in the chunk) where enough chosen words agree."""
        none = np.zeros(0, np.int64)
        if not len(self.known):
            return none, none, none
        spot = np.minimum(np.searchsorted(self.known, words.hash), len(self.known) - 1)
        at = np.flatnonzero(self.known[spot] == words.hash)
        word, row = spot[at], words.doc[at]
        chosen = self.chosen(row, word)
        if not len(chosen):
            return none, none, none
        used = np.isin(row * len(self.known) + word, np.unique(chosen // (len(self.labels) * len(self.known)) * len(self.known) + chosen % len(self.known)))
        at, word, row = at[used], word[used], row[used]
        of, each = expanded(self.begin, word)
        code = self.code(row[of], self.template[each], word[of])
        fits = chosen[np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)] == code
        of, each = of[fits], each[fits]
        template, start = self.template[each], at[of] - self.place[each]
        pad = max(map(len, self.words))
        span = len(words.hash) + 2 * pad
        vote = np.unique((((row[of] * span + start + pad) * len(self.labels) + template) * len(self.known)) + word[of])
        place, count = np.unique(vote // len(self.known), return_counts=True)
        place = place[count >= self.need[place % len(self.labels)]]
        template, place = place % len(self.labels), place // len(self.labels)
        return place // span, template, place % span - pad

    def matches(self, words: Words) -> Iterator[tuple[int, str, int, int, float]]:
        """(row, label, place in the text, words of the template, share of them that agree), by row."""
        found = []
        rows, templates, starts = self.candidates(words)
        for t in np.unique(templates):
            own, size = templates == t, len(self.words[t])
            row, start = rows[own], starts[own]
            for key_place, key in self.keys[t]:
                begin = start + key_place
                fits = (begin >= words.first[row]) & (begin + len(key) <= words.first[row + 1])
                row, start, begin = row[fits], start[fits], begin[fits]
                fits = (words.hash[begin[:, None] + np.arange(len(key))] == key).all(1)
                row, start = row[fits], start[fits]
            first, end = words.first[row], words.first[row + 1]
            place = start[:, None] + np.arange(size)
            inside = (place >= first[:, None]) & (place < end[:, None])
            agree = inside & (words.hash[np.clip(place, 0, len(words.hash) - 1)] == self.words[t])
            found += zip(row.tolist(), [self.labels[t]] * len(row), (start - first).tolist(), [size] * len(row), (agree.sum(1) / size).tolist(), strict=True)
        return iter(sorted(found))


def expanded(begin: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists that begin at ``begin[word]``: which of ``word`` each entry is of, and the entries."""
    size = begin[word + 1] - begin[word]
    of = np.repeat(np.arange(len(word)), size)
    return of, np.arange(size.sum()) + np.repeat(begin[word] - np.cumsum(size) + size, size)


def phrase_at(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """At which places of a text's words the phrase begins."""
    fits = np.zeros(len(words), bool)
    n = len(words) - len(phrase) + 1
    if n > 0 and len(phrase):
        fits[:n] = True
        for j, w in enumerate(phrase):
            fits[:n] &= words[j : n + j] == w
    return fits


def phrase_places(words: Words, phrase: np.ndarray) -> np.ndarray:
    """Places in the chunk at which the phrase's words stand one after the other in one text."""
    n = len(words.hash) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    fits = words.doc[:n] == words.doc[len(phrase) - 1 :]
    for j, w in enumerate(phrase):
        fits &= words.hash[j : n + j] == w
    return np.flatnonzero(fits)


def _task(index: Sent, phrases: list[tuple[str, np.ndarray]], schema: pa.Schema):
    def scan(part: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(part.column("text"), PLAIN)
        rows = words.rows
        count, first, last = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        base: list[set[str]] = [set() for _ in range(rows)]
        for label, phrase in phrases:
            at = phrase_places(words, phrase)
            row, place = words.doc[at], at - words.first[words.doc[at]]
            np.add.at(count, row, 1)
            np.minimum.at(first, row, place)
            np.maximum.at(last, row, place)
            for r in np.unique(row):
                base[r].add(label)
        listed: list[list[dict]] = [[] for _ in range(rows)]
        for row, label, place, size, share in index.value.matches(words):
            listed[row].append({"label": label, "word": place, "words": size, "share": share})
        none = count == 0
        cells = {
            "n_words": words.count, "n_base": count, "first_word": pa.array(first, pa.int64(), mask=none), "last_word": pa.array(last, pa.int64(), mask=none),
            "base_labels": [sorted(x) for x in base], "labels": [sorted(x | {m["label"] for m in found}) for x, found in zip(base, listed, strict=True)],
            "matches": listed, "license_score": [max([float(bool(x)), *(m["share"] for m in found)]) for x, found in zip(base, listed, strict=True)],
        }
        cells = {k: v if isinstance(v, pa.Array) else pa.array(v, schema.field(k).type) for k, v in cells.items()}
        return pa.record_batch([cells[f.name] if f.name in cells else part.column(f.name) for f in schema], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield scan(part)

    return task


def document_frequencies(docs: DataFrame, known: np.ndarray) -> tuple[int, dict[int, int]]:
    """Number of all texts, and in how many of them each of the known words (sorted hashes) occurs."""
    sent = Sent(docs.sparkSession, known)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(sent.value), np.int64), 0
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"), PLAIN)
                spot = np.minimum(np.searchsorted(sent.value, words.hash), len(sent.value) - 1)
                own = sent.value[spot] == words.hash
                total += np.bincount(np.unique(words.doc[own] * len(total) + spot[own]) % len(total), minlength=len(total))
                rows += part.num_rows
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(met, -1)), pa.array(np.append(total[met], rows))], names=["word", "n"])

    sums = docs.select("text").mapInArrow(task, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r.word: r.n for r in sums.collect()}  # as many rows as the templates have words, and one
    return counts.pop(-1, 0), {int(known[w].view(np.int64)): n for w, n in counts.items()}


def license_scan(docs: DataFrame, templates: tuple[Template, ...] | DataFrame = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, rare: int = 8, posted: int = 24) -> DataFrame:
    """Adds what license words each text has, for texts of any length; columns of the added names are replaced.

    ``templates`` is a list, or a table (label, text, keys) small enough to be broadcast; of each template the rarer half
    of its words, ``posted`` at most, is in the index, and of these the ``rare`` rarest that a file has are looked up in it. Document frequencies are those of docs, which is read once for them.

    Added: n_words; n_base (places of phrases), first_word and last_word (their smallest and largest start, null if none),
    base_labels (sorted); matches (templates whose key phrases stand at their places: label, place of the template's first word,
    which may lie before the text, its number of words, and the share that agrees); labels (of phrases and templates);
    license_score (1 for a phrase, else the best share; 0 for none). A null text has no words.
    """
    added = T._parse_datatype_string(FOUND)
    keep = [c for c in docs.columns if c not in added.names]
    docs = docs.select(*keep).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    if isinstance(templates, DataFrame):
        templates = tuple(Template(r.label, r.text, tuple(r.keys)) for r in templates.select("label", "text", "keys").orderBy("label", "text").collect())
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_hashes(t.text) for t in templates)]))
    documents, frequency = document_frequencies(docs, known) if len(known) else (0, {})
    index = Sent(docs.sparkSession, Index(list(templates), frequency, documents, rare, posted))
    return docs.mapInArrow(_task(index, [(k, _hashes(p)) for k, p in phrases], to_arrow_schema(schema)), schema)
