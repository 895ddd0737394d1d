"""Removal of word windows that occur more than once, by levels of doubled length.

Level 1 looks at windows of about a quarter of the length, and only at anchors: of the windows inside each window of
full length, the one with the least hash. Equal windows have equal anchors, so an anchor that occurs once rules out
all windows around it. Anchors that repeat are extended to half the length; what repeats there, to the full length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.session import stored

WINDOW = 35
HOT_WINDOWS = 10_000  # half windows with more occurrences are counted before they travel
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
CONTENT = ["k1", "k2"]


class Levels:
    """Lengths of the three levels: base, half (two overlapping bases), full (two overlapping halves)."""

    def __init__(self, window: int):
        if window < 4:
            raise ValueError("a window has at least 4 words")
        self.full = window
        self.half = -(-window // 2)
        self.base = -(-self.half // 2)
        self.span = window - self.base + 1  # base windows inside a full one


def _anchors(hashes: np.ndarray, ends: np.ndarray, levels: Levels) -> np.ndarray:
    """For each full window of some texts its anchor, the place of its base window with the least hash; else -1.

    ends: for each word the end of its text. Equal hashes are ordered by place, and only their upper bits count, in
    the same way in all texts.
    """
    full = np.full(len(hashes), -1, np.int64)
    base = T.window_hashes(hashes, levels.base)
    count = len(base) - levels.span + 1
    if count <= 0:
        return full
    bits = np.uint64(max(1, len(base)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    keyed = (base >> np.uint64(24) << np.uint64(24)) & ~low | np.arange(len(base), dtype=np.uint64)
    width = 1
    while width * 2 <= levels.span:
        keyed = np.minimum(keyed[:-width], keyed[width:])
        width *= 2
    keyed = np.minimum(keyed[:count], keyed[levels.span - width : levels.span - width + count])
    places = np.arange(count)
    inside = places + levels.full <= ends[:count]
    full[:count][inside] = (keyed & low).astype(np.int64)[inside]
    return full


def _ends(found: T.Words) -> np.ndarray:
    return np.repeat(found.first_words[1:], found.counts())


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def _scan(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its number of words, the digest of them all, and its anchors."""
    levels = Levels(window)
    for batch in batches:
        texts = batch["text"]
        for found in T.words(texts):
            hashes = found.hashes()
            anchors = np.unique(_anchors(hashes, _ends(found), levels))
            anchors = anchors[anchors >= 0]
            owner = np.searchsorted(found.first_words, anchors, side="right") - 1
            first = np.searchsorted(owner, np.arange(found.texts + 1))
            values = T.window_hashes(hashes, levels.base)[anchors].view(np.int64) if len(anchors) else np.zeros(0, np.int64)
            raw, bounds = found.data.tobytes(), found.text_starts
            digests = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(bounds, bounds[1:])]
            rows = slice(found.first_row, found.first_row + found.texts)
            columns = [batch[name][rows] for name in ("doc_id", *CONTENT)] + [
                pa.array(found.counts(), pa.int64()),
                pa.array(digests),
                _lists(anchors - found.first_words[owner], first, pa.int32()),
                _lists(values, first, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *CONTENT, "n_words", "all_sha256", "places", "hashes"])


def _halves(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Half windows that begin or end with a repeated anchor: m, start, hash."""
    levels = Levels(window)
    for batch in batches:
        for found in T.words(batch["text"]):
            values = T.window_hashes(found.hashes(), levels.half)
            m, starts = [], []
            for i in range(found.texts):
                anchors = np.asarray(batch["places"][found.first_row + i].values, np.int64) + found.first_words[i]
                both = np.unique(np.concatenate((anchors, anchors - (levels.half - levels.base))))
                both = both[(both >= found.first_words[i]) & (both + levels.half <= found.first_words[i + 1])]
                starts.append(both)
                m.append(np.full(len(both), batch["m"][found.first_row + i].as_py(), np.int64))
            starts, m = np.concatenate(starts), np.concatenate(m)
            if len(starts):
                origin = found.first_words[np.searchsorted(found.first_words, starts, side="right") - 1]
                columns = [pa.array(m), pa.array((starts - origin).astype(np.int32)), pa.array(values[starts].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["m", "start", "hash"])


def _windows(window: int, hot: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full windows whose anchor's half window repeats, very often (hot) or not: m, start, hash."""
    levels = Levels(window)
    for batch in batches:
        for found in T.words(batch["text"]):
            hashes = found.hashes()
            anchors = _anchors(hashes, _ends(found), levels)
            starts = np.flatnonzero(anchors >= 0)
            half = anchors[starts]
            half = np.where(half + levels.half <= starts + levels.full, half, half - (levels.half - levels.base))
            state = np.zeros(len(hashes) + 1, np.int8)  # 1 repeated, 2 repeated very often
            m = np.zeros(found.texts, np.int64)
            for i in range(found.texts):
                row = found.first_row + i
                m[i] = batch["m"][row].as_py()
                state[np.asarray(batch["starts"][row].values, np.int64) + found.first_words[i]] = 1
                state[np.asarray(batch["hot_starts"][row].values, np.int64) + found.first_words[i]] = 2
            starts = starts[state[half] == (2 if hot else 1)]
            if len(starts):
                owner = np.searchsorted(found.first_words, starts, side="right") - 1
                columns = [
                    pa.array(m[owner]),
                    pa.array((starts - found.first_words[owner]).astype(np.int32)),
                    pa.array(T.window_hashes(hashes, levels.full)[starts].view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["m", "start", "hash"])


def _kept(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the words outside repeated windows: n_removed, digest (, kept text)."""
    for batch in batches:
        removed, digests, texts = [], [], []
        for text, starts in zip(batch["text"].to_pylist(), batch["starts"]):
            words = (text or "").encode().split()
            change = np.zeros(len(words) + 1, np.int64)
            at = np.asarray(starts.values, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            inside = np.cumsum(change)[:-1] > 0
            left = b" ".join([word for word, gone in zip(words, inside) if not gone])
            removed.append(int(inside.sum()))
            digests.append(hashlib.sha256(left).hexdigest())
            texts.append(left.decode())
        columns = [batch["m"], pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["m", "n_removed", "kept_sha256", "kept_text"])


def _seen_twice(rows: DataFrame, *more: Column) -> DataFrame:
    """Hashes at two different places; equal rows, as repeated input rows give, are one place."""
    place = F.xxhash64("m", "start")
    grouped = rows.groupBy("hash").agg(F.min(place).alias("_a"), F.max(place).alias("_b"), *more)
    return grouped.filter("_a <> _b").drop("_a", "_b")


def _with_content(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("content"), "text")})


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row per row of docs, a row per different text, a row per different text with repeated windows).

    The last has m, k1, k2, text and `starts`, all places of windows that occur at another place too.
    """
    T.small_batches(docs.sparkSession)
    frame = _with_content(T.needed(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scanned = f"doc_id {id_type}, k1 long, k2 long, n_words long, all_sha256 string, places array<int>, hashes array<long>"
    rows = stored(frame.mapInArrow(partial(_scan, window), scanned), "scan")
    # Copies of a text stand at the same places: one row speaks for all. doc_id in the key spreads the copies.
    texts = rows.groupBy(*CONTENT).agg(F.min("doc_id").alias("of_doc"), F.count("*").alias("copies"))
    texts = stored(texts.withColumn("m", F.monotonically_increasing_id()), "texts")

    def speaking(left: DataFrame, right: DataFrame) -> Column:
        return (left["k1"] == right["k1"]) & (left["k2"] == right["k2"]) & left["doc_id"].eqNullSafe(right["of_doc"])

    keys = texts.select(*CONTENT, "of_doc", "m")
    bases = rows.filter(F.size("hashes") > 0).join(keys, speaking(rows, keys))
    bases = bases.select("m", F.explode(F.arrays_zip("places", "hashes")).alias("a"))
    bases = bases.select("m", F.col("a.places").alias("start"), F.col("a.hashes").alias("hash"))
    # What is seen twice is stored before it is joined: then Spark can split a hash that has very many places.
    anchors = bases.join(stored(_seen_twice(bases), "base-hashes"), "hash").groupBy("m").agg(F.collect_set("start").alias("places"))
    held = anchors.join(texts.select("m", *CONTENT, "of_doc"), "m")
    candidates = frame.join(held, speaking(frame, held)).select("m", held["k1"], held["k2"], "text", "places")
    candidates = stored(candidates, "candidates")

    halves = stored(candidates.select("m", "text", "places").mapInArrow(partial(_halves, window), "m long, start int, hash long"), "halves")
    counted = stored(_seen_twice(halves, (F.count("*") > HOT_WINDOWS).alias("hot")), "half-hashes")
    starts = halves.join(counted, "hash").groupBy("m").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("start"))).alias("starts"),
        F.collect_set(F.when(F.col("hot"), F.col("start"))).alias("hot_starts"),
    )
    starts = stored(starts, "starts")
    candidates = candidates.drop("places")

    def fulls(hot: bool) -> DataFrame:
        chosen = starts.filter(F.size("hot_starts") > 0) if hot else starts
        texts_of = candidates.select("m", "text").join(chosen, "m")
        return texts_of.mapInArrow(partial(_windows, window, hot), "m long, start int, hash long")

    # Windows around rare halves are in small groups. Those around hot halves are counted first, then looked up.
    place, group = F.xxhash64("m", "start"), Window.partitionBy("hash")
    rare = fulls(False).select("m", "start", (F.min(place).over(group) != F.max(place).over(group)).alias("twice"))
    hot = stored(fulls(True), "hot-windows")
    hot = hot.join(stored(_seen_twice(hot), "hot-hashes"), "hash").select("m", "start")
    found = rare.filter("twice").select("m", "start").unionByName(hot).groupBy("m").agg(F.collect_set("start").alias("starts"))
    return rows, texts, candidates.join(found, "m")


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (, kept_text: the words that stay, one space between): a row per row.

    A word goes if a window of `window` words that covers it also starts anywhere else, in the same text or another.
    A null or empty text has no words. A text shorter than the window keeps all. Repeated rows, and other rows with
    the same text, are at different places: they lose every word that a window covers.
    """
    rows, texts, found = repeated_windows(docs, window)
    result = "m long, n_removed long, kept_sha256 string, kept_text string"
    cut = found.select("m", "text", "starts").dropDuplicates(["m"]).mapInArrow(partial(_kept, window), result)
    cut = stored(cut if with_text else cut.drop("kept_text"), "kept")
    by_text = texts.join(cut, "m", "left").drop("m", "of_doc")
    whole_copy = (F.col("copies") > 1) & (F.col("n_words") >= window)
    figures = rows.select("doc_id", *CONTENT, "n_words", "all_sha256").join(by_text, CONTENT)
    named = [
        "doc_id",
        "n_words",
        F.when(whole_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole_copy, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        named.append(F.when(whole_copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return figures.select(*named)
