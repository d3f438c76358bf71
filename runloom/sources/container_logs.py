"""Multiplexed container logs: frames of a stream number, three zero bytes, a big-endian length and the payload."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers of the streams.
STREAMS = {0: "stdin", 1: "stdout", 2: "stderr"}


def frame(stream: Column, text: Column) -> Column:
    """A frame as binary."""
    number = F.when(stream == "stderr", 2).when(stream == "stdin", 0).otherwise(1)
    data = text.cast("binary")
    return F.unhex(F.concat(F.lpad(F.hex(number), 2, "0"), F.lit("000000"), F.lpad(F.hex(F.octet_length(data)), 8, "0"), F.hex(data)))


def _frames(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, stream number, first byte, end) of all whole frames of logs that begin at ``at``; a truncated one ends its log.

    All logs go on by one frame at a time.
    """
    found, rows, place = [], np.arange(len(at)), 0
    while len(rows):
        rows = rows[at[rows] + 8 <= end[rows]]
        header = data[at[rows][:, None] + np.arange(8)].astype(np.int64)
        stop = at[rows] + 8 + (header[:, 4:] << np.array([24, 16, 8, 0])).sum(1)
        whole = stop <= end[rows]
        rows, stop = rows[whole], stop[whole]
        found.append((rows, np.full(len(rows), place), header[whole, 0], at[rows] + 8, stop))
        at[rows] = stop
        place += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def _texts(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes between each first and end as texts; bytes that are no UTF-8 become U+FFFD."""
    size = end - first
    ends = np.concatenate([[0], np.cumsum(size)])
    own = data[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
    binary = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(own)])
    try:
        return binary.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode(errors="replace") for x in binary], pa.string())


def decoded(logs: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, place, stream, text): one row for each frame of a binary column; null has none."""
    names = np.array([STREAMS.get(i, "stdout") for i in range(256)], object)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(raw).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            row, place, stream, first, end = _frames(data, offsets[:-1].copy(), offsets[1:])
            order = np.lexsort((place, row))
            row, place, stream, first, end = (x[order] for x in (row, place, stream, first, end))
            yield pa.record_batch([batch.column(key).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(names[stream], pa.string()), _texts(data, first, end)], names=[key, "place", "stream", "text"])

    kind = logs.schema[key].dataType.simpleString()
    return logs.select(key, raw).mapInArrow(task, f"{key} {kind}, place int, stream string, text string")
