"""Importance resampling: documents drawn in proportion to how much likelier a target corpus makes their n-grams.

A text is scanned once: separators are collapsed to single blanks, and for each n an overlapped search with
look-arounds at both ends finds the spans of all runs of n words. The CRC of a span is its feature's bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.llm.ranks import ranked
from shipflow.session import stored

MAX_WORDS = 1  # features are runs of 1 to so many words
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20

# Words are longest runs of other characters, after A-Z became a-z; beyond ASCII every character is part of a word.
SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]++")


def run_pattern(count: int) -> regex.Pattern:
    """Runs of so many words between single blanks. An overlapped search tries each place; only word starts pass."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (count - 1))


def collapsed(text: bytes) -> bytes:
    """Lower-case text with a single blank for each run of separators."""
    return SEPARATORS.sub(b" ", text.lower())  # bytes: lower() changes A-Z only


def spans(line: bytes, pattern: regex.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end of each run of words in a collapsed text."""
    return (match.span() for match in pattern.finditer(line, overlapped=True))


def _buckets(line: bytes, pattern: regex.Pattern, buckets: int) -> np.ndarray:
    view = memoryview(line)
    return np.fromiter((crc32(view[begin:end]) % buckets for begin, end in spans(line, pattern)), np.int32)


def _scan(max_words: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its words, its features, and the different buckets of these with their counts."""
    patterns = [run_pattern(count) for count in range(1, max_words + 1)]
    for batch in batches:
        n_words, n_features, kinds, counts = [], [], [], []
        bounds, data = T.text_bytes(batch["text"])
        for begin, end in zip(bounds, bounds[1:]):
            line = collapsed(data[begin:end].tobytes())
            found = [_buckets(line, pattern, buckets) for pattern in patterns]
            n_words.append(len(found[0]))
            n_features.append(sum(map(len, found)))
            kind, count = np.unique(np.concatenate(found), return_counts=True)
            kinds.append(kind)
            counts.append(count)
        first = np.concatenate(([0], np.cumsum([len(kind) for kind in kinds], dtype=np.int64)))
        columns = [
            batch["doc_id"],
            pa.array(n_words, pa.int64()),
            pa.array(n_features, pa.int64()),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(kinds), pa.int32())),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(counts), pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets", "counts"])


def features(docs: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets, counts: a stored row per document; texts are read once."""
    frame = T.columns_of(docs, "doc_id", "text")
    id_type = frame.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_features long, buckets array<int>, counts array<long>"
    with T.text_batches(docs.sparkSession):
        return stored(frame.mapInArrow(partial(_scan, max_words, buckets), schema), "features")


def _task_totals(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each bucket in the rows of one task."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        np.add.at(total, batch["buckets"].flatten().to_numpy(), batch["counts"].flatten().to_numpy())
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])


def totals(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: occurrences in all rows. A task sends one row per bucket, so no bucket is hot."""
    rows = found.select("buckets", "counts").mapInArrow(partial(_task_totals, buckets), "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: thousandths of the log ratio of smoothed shares, floored; a row for every bucket."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left"
    )
    counts = stored(counts.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "counts", buckets)
    sums = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (float(sums.s) + buckets) / ((s + 1) * (float(sums.t) + buckets))
    return counts.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def _weights(gain: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the floored mean of the gains of its features."""
    for batch in batches:
        worth = gain[batch["buckets"].flatten().to_numpy()] * batch["counts"].flatten().to_numpy()
        sums = np.concatenate(([0], np.cumsum(worth)))
        first = np.concatenate(([0], np.cumsum(batch["buckets"].value_lengths().to_numpy(zero_copy_only=False))))
        features = batch["n_features"].to_numpy()
        weight = (sums[first[1:]] - sums[first[:-1]]) // np.maximum(features, 1)  # // goes down, below zero too
        columns = [batch["doc_id"], batch["n_words"], batch["n_features"], pa.array(weight.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])


def noise(doc_id, seed: int):
    """Thousandths of a Gumbel number that the seed and the id fix, floored."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digits, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(share)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_words: int = MAX_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row per row of docs; rank is null for rows that are not drawn.

    The draw takes the given share of the rows with least_words words or more, by highest score; equal scores go to
    the smaller doc_id, null ids last. The score is the weight plus noise that depends on the seed and the id alone,
    so reruns agree. A null or empty text has no feature and weight 0. Repeated rows count as often as they occur,
    each with a rank of its own. Without rows in target all gains come from smoothing. Other columns are ignored.

    The gains, `buckets` numbers, are the only thing the driver sees.
    """
    found = features(docs, max_words, buckets)
    texts = T.columns_of(target, "text").select(F.lit(0).alias("doc_id"), "text")
    aims = features(texts, max_words, buckets)
    known = gains(totals(found, buckets), totals(aims, buckets), buckets).collect()
    gain = np.zeros(buckets, np.int64)
    for row in known:
        gain[row.bucket] = row.gain
    id_type = found.schema["doc_id"].dataType.simpleString()
    weighed = found.mapInArrow(partial(_weights, gain), f"doc_id {id_type}, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scores")

    enough = F.col("n_words") >= least_words
    drawn = scored.filter(enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    placed = ranked(scored.filter(enough), order, "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*names).unionByName(rest.select(*names))
