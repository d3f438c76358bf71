"""Language identification by nearest centroid.

A text is the vector of its byte n-grams, hashed to ``dims`` places: ``log(1+count)`` times the inverse document frequency,
at unit length. Each language has several centroids, from spherical k-means over a bounded sample of labelled texts. A text
gets the language of the centroid with the largest cosine. Short texts are far from any centroid, so a cosine is judged
after division by what a text's number of n-grams allows; below ``slack`` times the lowest half per cent of the language's
own sample the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import Sent, stored
from .words import LOWER, chunks, texts

UNKNOWN = "und"
GRAMS = (2, 3)
#: Rows of a dense block of vectors.
BLOCK_ROWS = 512

#: Letters and bytes beyond ASCII as they are, everything else a space.
_LETTER = np.where(((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128), np.arange(256), 32)[LOWER].astype(np.uint32)


def gram_counts(column: pa.Array, dims: int) -> np.ndarray:
    """Counts of the hashed n-grams: one row for each text. Grams of spaces only do not count."""
    offsets, data = texts(column)
    rows = len(offsets) - 1
    total = np.zeros(rows * dims, np.float32)
    if len(data):
        byte = _LETTER[data]
        row = np.repeat(np.arange(rows), np.diff(offsets))
        kept = np.ones(len(byte), bool)  # spaces in a row count once
        kept[1:] = (byte[1:] != 32) | (byte[:-1] != 32) | (row[1:] != row[:-1])
        byte, row = byte[kept], row[kept]
        for n in GRAMS:
            if len(byte) < n:
                continue
            code, some = byte[: len(byte) - n + 1].copy(), byte[: len(byte) - n + 1] != 32
            for j in range(1, n):
                after = byte[j : len(byte) - n + 1 + j]
                code = code * np.uint32(0x9E3779B1) + after
                some = some | (after != 32)
            some &= row[: len(code)] == row[n - 1 :]
            code ^= code >> np.uint32(15)
            place = ((code * np.uint32(0x85EBCA6B)) >> np.uint32(8)) % np.uint32(dims)
            total += np.bincount(row[: len(code)][some] * dims + place[some], minlength=rows * dims)
    return total.reshape(rows, dims)


def has_letter(column: pa.Array) -> np.ndarray:
    """Which texts have a letter of any script; null has none."""
    offsets, data = texts(column)
    lower = LOWER[data]
    sums = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    for i in np.flatnonzero(~found & (high[offsets[1:]] > high[offsets[:-1]])):
        found[i] = any(c.isalpha() for c in column[i].as_py())
    return found


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def reachable(grams: np.ndarray) -> np.ndarray:
    """Share of a long text's cosine that a text of so many n-grams reaches, about."""
    return np.sqrt((grams + 1) / (grams + 200))


@dataclass
class Model:
    """languages[i] is the language of centroids[i], and least[i] the cosine (for a long text) under which it rejects."""

    languages: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether it is rejected, for each text."""
        if not len(self.languages):
            return np.full(len(column), UNKNOWN, object), np.zeros(len(column)), np.ones(len(column), bool)
        counts = gram_counts(column, len(self.idf))
        cosine = unit(np.log1p(counts) * self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)
        letter = has_letter(column)
        return np.where(letter, self.languages[best], UNKNOWN), np.where(letter, score, 0.0), ~letter | (score < self.least[best] * reachable(counts.sum(1)))


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the cluster of each row; starts from rows that are far from each other, so reruns agree."""
    start = [int(np.argmax(vectors @ vectors.mean(0)))]
    while len(start) < min(k, len(vectors)):
        start.append(int((vectors @ vectors[start].T).max(1).argmin()))
    centroids = vectors[start]
    for _ in range(rounds):
        cluster = (vectors @ centroids.T).argmax(1)
        centroids = unit(np.stack([vectors[cluster == c].sum(0) if (cluster == c).any() else centroids[c] for c in range(len(centroids))]))
    return centroids, (vectors @ centroids.T).argmax(1)


def _sparse(dims: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                for a in range(0, part.num_rows, BLOCK_ROWS):
                    block = part.slice(a, BLOCK_ROWS)
                    row, place = np.nonzero(counts := gram_counts(block.column("text"), dims))
                    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=block.num_rows))]), pa.int32())
                    values = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place.astype(np.int32), counts[row, place].astype(np.float32))]
                    yield pa.record_batch([block.column("lang"), *values], names=["lang", "place", "count"])

    return task


def _frequencies(dims: int):
    """One array for each task: in how many texts each place occurs; and how many texts there were."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_met, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                for a in range(0, part.num_rows, BLOCK_ROWS):
                    total += np.count_nonzero(gram_counts(part.slice(a, BLOCK_ROWS).column("text"), dims), axis=0)
                texts_met += part.num_rows
        if texts_met:
            place = np.append(np.flatnonzero(total), -1)  # -1: all texts
            yield pa.record_batch([pa.array(place.astype(np.int32)), pa.array(np.append(total[place[:-1]], texts_met))], names=["place", "n"])

    return task


def document_frequencies(docs: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of all texts (text), and in how many of them each place occurs."""
    sums = docs.select("text").mapInArrow(_frequencies(dims), "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    found = {r.place: r.n for r in sums.collect()}  # at most dims rows and one
    total = found.pop(-1, 0)
    frequency = np.zeros(dims, np.int64)
    frequency[list(found)] = list(found.values())
    return total, frequency


def fit(labelled: DataFrame, clusters: int = 3, dims: int = 4096, sample: int = 1500, slack: float = 0.5) -> Model:
    """Learns from doc_id, text and lang; rows with a null in any of them, and texts without a letter, teach nothing.

    ``sample`` bounds the texts that the centroids of a language are fitted on (about; chosen by a hash of doc_id). Document
    frequencies are those of all texts that teach. What reaches the driver
    is the frequencies of ``dims`` places and ``clusters`` centroids for each language.
    """
    labelled = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    schema = "lang string, place array<int>, count array<float>"
    if not counts:
        return Model(np.zeros(0, object), np.zeros((0, dims), np.float32), np.ones(dims, np.float32), np.zeros(0))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sorted(counts.items())])
    lettered = labelled.where(r"text rlike '\\p{L}'")
    total, frequency = document_frequencies(lettered, dims)
    idf = np.where(frequency > 0, np.log((1 + total) / (1 + frequency)) + 1e-3, np.log1p(total)).astype(np.float32)
    drawn = lettered.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    drawn = stored(drawn.select("lang", "text").mapInArrow(_sparse(dims), schema))

    def centroids(table: pa.Table) -> pa.Table:
        rows = np.repeat(np.arange(table.num_rows), [len(x) for x in table["place"]])
        vectors = np.zeros((table.num_rows, dims), np.float32)
        vectors[rows, table["place"].combine_chunks().flatten()] = table["count"].combine_chunks().flatten()
        reach = reachable(vectors.sum(1))
        vectors = unit(np.log1p(vectors) * idf)
        found, cluster = spherical_kmeans(vectors, clusters)
        least = float(np.quantile((vectors * found[cluster]).sum(1) / reach, 0.005))
        return pa.table({"lang": [table["lang"][0].as_py()] * len(found), "least": [least] * len(found), "centroid": pa.array(found.tolist(), pa.list_(pa.float32()))})

    rows = drawn.repartition("lang").groupBy("lang").applyInArrow(centroids, "lang string, least double, centroid array<float>").collect()
    rows.sort(key=lambda r: (r.lang, r.centroid))
    return Model(np.array([r.lang for r in rows], object), np.array([r.centroid for r in rows], np.float32).reshape(-1, dims), idf, slack * np.array([r.least for r in rows]))


def _predict(shared, schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                for a in range(0, part.num_rows, BLOCK_ROWS):
                    block = part.slice(a, BLOCK_ROWS)
                    cells = dict(zip(("lang_pred", "lang_score", "lang_rejected"), shared.value.predict(block.column("text")), strict=True))
                    yield pa.record_batch([pa.array(cells[f.name], f.type) if f.name in cells else block.column(f.name) for f in schema], schema=schema)

    return task


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, lang_score (cosine, 0 to 1) and lang_rejected to each row; columns of these names are replaced.

    A text that is null or has no letter is ``und``, with score 0, and rejected; so is every text if nothing was learned.
    Of equal cosines the first language by name wins. Whole texts count, whatever their length.
    """
    added = T._parse_datatype_string("lang_pred string, lang_score double, lang_rejected boolean")
    keep = [c for c in docs.columns if c not in added.names]
    docs = docs.select(*keep).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    return docs.mapInArrow(_predict(Sent(docs.sparkSession, model), to_arrow_schema(schema)), schema)
