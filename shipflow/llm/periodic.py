"""Periodic runs of words: stretches that repeat with a period, found by uniting suffixes in order of what they share.

The suffixes of a text are sorted; neighbours are united by decreasing longest common prefix. A class then holds the
positions whose suffixes share at least that many words. Two positions that become next to each other in a class, at
a distance within the shared length, begin the same words once a period apart: they seed a run. As every run of two
periods or more makes its first two periods neighbours just at the length it goes on for, each is seeded once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.session import stored

SPACE = re.compile(rb"[\x20\x09-\x0D]")
LEAST_LENGTH = 6
LEAST_EXPONENT = 4


def least_shared(least_length: int, least_exponent: int) -> int:
    """The least length that the first two periods of a wanted run share, over all periods."""
    return min(max(least_length - period, (least_exponent - 1) * period) for period in range(1, least_length + 1))


def _repeats(symbols: np.ndarray, length: int) -> bool:
    """Whether any `length` consecutive symbols occur twice, or their hashes do."""
    hashes = np.sort(T.window_hashes(T.mixed(symbols.astype(np.uint64)), length))
    return bool((hashes[1:] == hashes[:-1]).any())


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in their order, by doubling the length that ranks look at."""
    count, width = len(symbols), 1
    ranks = symbols.astype(np.int64) + 1
    while True:
        keys = ranks * (count + 1)
        keys[:-width] += ranks[width:]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        placed = np.concatenate(([1], 1 + np.cumsum(keys[1:] != keys[:-1])))
        ranks = np.empty(count, np.int64)
        ranks[order] = placed
        width *= 2
        if placed[-1] == count or width >= count:
            return order


def shared_lengths(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many symbols each suffix shares with the one before it in the order; 0 for the first."""
    count = len(symbols)
    before = np.full(count, -1, np.int32)
    before[order[1:]] = order[:-1]
    words, above, found = memoryview(symbols.astype(np.int32)), memoryview(before), np.zeros(count, np.int32)
    by_start, shared = memoryview(found), 0
    for start in range(count):
        other = above[start]
        if other < 0:
            shared = 0
            continue
        limit = count - max(start, other)
        while shared < limit and words[start + shared] == words[other + shared]:
            shared += 1
        by_start[start] = shared
        if shared:
            shared -= 1
    return found[order]


def _levels(shared: np.ndarray, least: int) -> Iterator[tuple[int, list[int]]]:
    """(length, places k whose suffixes k - 1 and k share exactly that), longest first."""
    places = np.flatnonzero(shared >= least)
    places = places[np.argsort(-shared[places], kind="stable")]
    lengths = shared[places]
    cuts = np.flatnonzero(lengths[1:] != lengths[:-1]) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
        if begin < end:
            yield int(lengths[begin]), places[begin:end].tolist()


def _united(one: list[int], two: list[int]) -> list[int]:
    """Ordered positions of both; two is the smaller."""
    if len(two) * 16 < len(one):
        for position in two:
            insort(one, position)
    else:
        one += two
        one.sort()  # merges the two ordered stretches
    return one


def find_runs(symbols: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of the wanted length and exponent, by start, then period."""
    if least_length < 1 or least_exponent < 2:
        raise ValueError("runs have a length of 1 and an exponent of 2 at least")
    least = least_shared(least_length, least_exponent)
    if len(symbols) < least_length or not _repeats(symbols, least):
        return []
    order = suffix_order(symbols)
    shared = shared_lengths(symbols, order)
    starts, words = memoryview(order.astype(np.int32)), memoryview(symbols.astype(np.int32))
    up: dict[int, int] = {}  # union-find over places in the order; a place that is not held is a class by itself
    classes: dict[int, list[int]] = {}

    def find(place: int) -> int:
        root = place
        while up.get(root, root) != root:
            root = up[root]
        while up.get(place, place) != root:
            up[place], place = root, up[place]
        return root

    found: list[tuple[int, int, int]] = []
    for length, places in _levels(shared, least):
        moved: dict[int, list[int]] = {}  # class -> positions that came to it at this level
        for place in places:
            a, b = find(place - 1), find(place)
            one, two = classes.pop(a, None) or [starts[a]], classes.pop(b, None) or [starts[b]]
            if len(one) < len(two):
                a, b, one, two = b, a, two, one
            moved[a] = moved.pop(a, []) + moved.pop(b, []) + two
            classes[a] = _united(one, two)
            up[a] = up[b] = a
        for root, positions in moved.items():
            for begin, other in _new_neighbours(classes[root], positions, length, words):
                period = other - begin
                starts_here = begin == 0 or words[begin - 1] != words[other - 1]
                if starts_here and length >= (least_exponent - 1) * period and length + period >= least_length:
                    found.append((begin, length + period, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _new_neighbours(ordered: list[int], moved: list[int], length: int, words: Sequence[int]) -> set[tuple[int, int]]:
    """Neighbours that share exactly `length` words, so that they were in different classes before."""
    pairs = set()
    for position in moved:
        at = bisect_left(ordered, position)
        pairs.update(zip(ordered[max(at - 1, 0) : at + 1], ordered[max(at - 1, 0) + 1 : at + 2]))
    return {(a, b) for a, b in pairs if b - a <= length and (b + length == len(words) or words[a + length] != words[b + length])}


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + T.SLICE_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def symbols_of(text: bytes) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(word, len(numbers)) for words in _words(text) for word in words), np.int64)


def collapsed(text: bytes, count: int, runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside repetitions, one blank between them; a run's first period stays unless another run holds it."""
    stays = np.ones(count, bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    parts, at = [], 0
    for words in _words(text):
        parts.append(b" ".join(compress(words, stays[at : at + len(words)].tolist()) if runs else words))
        at += len(words)
    return b" ".join(filter(None, parts))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _analysed(least_length: int, least_exponent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds, data = T.text_bytes(batch["text"])
        for first, last in T.slices(bounds):  # texts of a slice go out together
            counts, runs, texts = [], [], []
            for begin, end in zip(bounds[first:last], bounds[first + 1 : last + 1]):
                text = data[begin:end].tobytes()
                symbols = symbols_of(text)
                found = find_runs(symbols, least_length, least_exponent)
                counts.append(len(symbols))
                runs.append([dict(zip(("start", "length", "period"), run)) for run in found])
                texts.append(collapsed(text, len(symbols), found).decode())
            columns = [batch["doc_id"][first:last], pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed: a row per row of docs, runs by start, then period.

    A run is a stretch of words, numbered from 0, with a least period, as long as that period goes on to both sides;
    it has least_length words and least_exponent periods or more. `collapsed` leaves out what a run repeats.
    A null or empty text has no words. Rows do not depend on each other, so repeated rows and ids give equal rows.
    Other columns are ignored. Words are compared as they are written. Memory is bounded by one text, and a text's
    suffixes are sorted in one task.
    """
    frame = T.columns_of(docs, "doc_id", "text")
    id_type = frame.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    with T.text_batches(docs.sparkSession):
        return stored(frame.mapInArrow(partial(_analysed, least_length, least_exponent), schema), "runs", compression="zstd")


def figures(found: DataFrame) -> DataFrame:
    """Per row of periodic_runs the number of runs, that of the greatest exponent, and digests of runs and text.

    Of runs with equal exponents the first is taken, by start, then period.
    """
    best = F.aggregate(
        F.col("runs"),
        F.get("runs", F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text with a period in every tenth document by the checksum of its id, as the check of this operator asks.

    h is that checksum, g = h // 10; if 10 divides h, word i from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8). Words of such texts are joined by one blank.
    """
    docs = T.columns_of(docs, "doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = (h % 10 == 0) & F.col("text").rlike(T.WORD)
    cells = F.when(chosen, F.regexp_extract_all("text", F.lit(f"({T.WORD})"), F.lit(1)))
    placed = docs.withColumns({"_words": cells, "_g": F.floor(h / 10)})
    placed = placed.withColumn("_a", (F.col("_g") % F.size("_words")).cast("int"))
    placed = placed.withColumn("_p", (1 + F.floor((F.size("_words") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))

    def word(old, i):
        return F.when(i < F.col("_a"), old).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p")))

    text = F.when(F.col("_words").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_words", word), " "))
    return placed.select("doc_id", text.alias("text"))
