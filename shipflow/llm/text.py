"""Words of texts: as a Spark pattern, and as arrays over the bytes of an Arrow column.

A word is a longest run of characters other than the six ASCII white-space characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]++"
SLICE_BYTES = 1024 * 1024  # bytes of text worked on at a time; a longer text is worked on alone

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

ODD = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(ODD, -1, 2**64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
_powers = {ODD: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def _power(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count - 1) modulo 2**64, kept between calls up to the size of a slice."""
    held = _powers[base]
    if len(held) < count:
        held = np.full(count, base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if count <= SLICE_BYTES:
            _powers[base] = held
    return held[:count]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run data[start:end]."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _power(ODD, len(data)), out=sums[1:])
    values = (sums[ends] - sums[starts]) * _power(INVERSE, len(data) + 1)[starts]
    return mixed(values + (ends - starts).astype(np.uint64) * np.uint64(ODD))


@dataclass
class Words:
    """Words of some consecutive texts: byte runs in data, and the first word of each text."""

    first_row: int
    data: np.ndarray
    text_starts: np.ndarray  # len = texts + 1
    starts: np.ndarray
    ends: np.ndarray
    first_words: np.ndarray  # len = texts + 1

    @property
    def texts(self) -> int:
        return len(self.text_starts) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first_words)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return run_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a text column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bounds - bounds[0], held[bounds[0] : bounds[-1]]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def words(column: pa.Array) -> Iterator[Words]:
    """The words of all texts of a column, some texts at a time."""
    bounds, data = text_bytes(column)
    for first, last in slices(bounds):
        text_starts = bounds[first : last + 1] - bounds[first]
        part = data[bounds[first] : bounds[last]]
        inner = ~IS_SPACE[part]
        begins, stops = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1]
        stops[:-1] &= ~inner[1:]
        cuts = text_starts[:-1][text_starts[:-1] < len(part)]  # a text begins a word, and ends the one before it
        begins[cuts] |= inner[cuts]
        before = cuts[cuts > 0] - 1
        stops[before] |= inner[before]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        yield Words(first, part, text_starts, starts, ends, np.searchsorted(starts, text_starts))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` consecutive values; the caller drops runs across texts."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(ODD, len(hashes)), out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * _power(INVERSE, len(hashes))[:count])


BATCH_ROWS, BATCH_BYTES = 256, 4 * 1024 * 1024
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
    "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
}


def small_batches(spark: SparkSession) -> None:
    """Rows here are whole texts: hand them to Python some hundreds, or some megabytes, at a time."""
    for name, most in BATCHES.items():
        held = re.fullmatch(r"([0-9]+)b?", spark.conf.get(name))
        if not held or not 0 < int(held[1]) <= most:
            spark.conf.set(name, str(most))


def needed(frame: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so others can have any name, also one that differs in case only; an absent one is an error."""
    return columns_of(frame, *names)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Within the block, Python gets whole texts in batches bounded by rows and by bytes; then settings are as before.

    Only plans that run within the block are affected, so a job that reads texts has to be started there.
    """
    before = {name: spark.conf.get(name) for name in BATCHES}
    try:
        for name, most in BATCHES.items():
            spark.conf.set(name, str(most))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def columns_of(frame: DataFrame, *names: str) -> DataFrame:
    """The named columns by their exact names, also beside others that differ in case only; an absent one is an error."""
    fields = frame.schema.fieldNames()
    missing = [name for name in names if name not in fields]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    places = [fields.index(name) for name in names]
    return frame.toDF(*[f"_{i}" for i in range(len(fields))]).select(*[F.col(f"_{i}").alias(name) for i, name in zip(places, names)])


BLANK, SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def last_words(text: Column, most: int) -> Column:
    """The end of a text from its last words on, whole words however long; empty if it has none."""
    return F.regexp_extract(text, rf"(?<!{SOLID}){SOLID}++(?:{BLANK}++{SOLID}++){{0,{most - 1}}}+{BLANK}*+$", 0)


def first_words(text: Column, most: int) -> Column:
    """The beginning of a text up to its first words' end, whole words however long."""
    return F.regexp_extract(text, rf"^{BLANK}*+(?:{SOLID}++{BLANK}*+){{0,{most}}}+", 0)
