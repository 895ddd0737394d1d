"""Jaccard join on word shingles by T-occurrence search.

A set's shingles are in one order for all sets: those that many documents share come last, the rest by hash. A set
of n shingles that overlaps another in T or more has one of those among its first n - T + 1. The inverted lists of
these are kept in a table; lists of shared shingles are the long ones, left aside where n - T + 1 others are there.
Pairs that meet in a list often enough to reach T are then searched: short lists are merged, long ones probed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.llm.graph import PLAIN, components
from shipflow.session import ROWS_PER_FILE, stored

SHINGLE = 5
PERCENT = 80
SHARED_DOCUMENTS = 64  # a shingle is long from so many documents on, as far as blocks show them together
BLOCK_SHINGLES = 2_000_000
BITS = 1 << 24  # of a bitmap that tells tasks of shingles or sets; its size does not depend on the data
ROUNDS = 2
MU = 1.0  # weight of long lists in DivideSkip
GROUP_SETS = 64  # sets that pivots connect, beyond which they are searched by blocks instead of as pairs
BLOCK_SETS = 256
SETS_PER_FILE = 4_000


# ---- sets of shingles


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted shingle hashes of each row) for some rows at a time."""
    for found in T.words(column):
        hashes = found.hashes(lower=True)
        grams = T.window_hashes(hashes, shingle)
        sets = []
        for a, b in zip(found.first_words, found.first_words[1:]):
            if b - a >= shingle:
                sets.append(np.unique(grams[a : b - shingle + 1]))
            elif b > a:
                sets.append(T.window_hashes(hashes[a:b], int(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield found.first_row, sets


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BITS)).astype(np.int64)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = _bit(hashes)
    return (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


def _bitmap(frame: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the column's hashes: at most BITS / 64 rows come to the driver, whatever the table."""
    # BITS divides 2**64, so signed and unsigned hashes have the same bit
    bits = frame.select(F.pmod(F.col(column), F.lit(BITS)).alias("at"))
    words = bits.selectExpr("floor(at / 64) AS word", "shiftleft(1L, CAST(at % 64 AS INT)) AS bit")
    bitmap = np.zeros(BITS // 64, np.uint64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        bitmap[row["word"]] = np.uint64(row["bits"] & 0xFFFFFFFFFFFFFFFF)
    return bitmap


def _together(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that two documents or more of a block have, with their number of documents in the block."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(held), return_counts=True)
        several = times > 1
        return pa.RecordBatch.from_arrays([pa.array(values[several].view(np.int64)), pa.array(times[several].astype(np.int64))], ["hash", "times"])

    for batch in batches:
        for _, sets in _sets(batch["text"], shingle):
            held += sets
            size += sum(map(len, sets))
            if size >= BLOCK_SHINGLES:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()


def _identity(values: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set of hashes."""
    spread = T.mixed(values)
    return int(T.mixed(np.array([spread.sum() + np.uint64(len(values))], np.uint64))[0].view(np.int64)), int(
        np.bitwise_xor.reduce(T.mixed(spread ^ np.uint64(T.ODD))).view(np.int64)
    )


def _prefix_length(n: int, percent: int) -> int:
    return n + (-n * percent // 100) + 1 if n else 0  # n - ceil(n * percent / 100) + 1


def _scan(shingle: int, percent: int, long_ones, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's identity and size, and the first of its shingles."""
    bitmap = long_ones.value
    for batch in batches:
        for first, sets in _sets(batch["text"], shingle):
            prefixes, ids = [], []
            for values in sets:
                length = _prefix_length(len(values), percent)
                late = _has(bitmap, values)
                prefixes.append(np.concatenate((values[~late], values[late]))[:length].view(np.int64))
                ids.append(_identity(values) if len(values) else (None, None))
            columns = [
                batch["doc_id"][first : first + len(sets)],
                pa.array([a for a, _ in ids], pa.int64()),
                pa.array([b for _, b in ids], pa.int64()),
                pa.array([len(values) for values in sets], pa.int64()),
                pa.array(prefixes, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set_id", "check_id", "n", "prefix"])


def _wanted(shingle: int, wanted, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sets of the rows whose key a bitmap names."""
    bitmap = wanted.value
    for batch in batches:
        asked = batch.filter(pa.array(_has(bitmap, np.asarray(batch["key"], np.int64).view(np.uint64))))
        for _, sets in _sets(asked["text"], shingle):
            found = [(_identity(values)[0], values.tobytes()) for values in sets if len(values)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["set_id", "shingles"])


# ---- the search inside a task


class Lists:
    """Inverted lists of some records: shingle -> the records that have it."""

    def __init__(self, records: list[np.ndarray]):
        self.records = records
        self.sizes = np.array([len(record) for record in records], np.int64)
        values = np.concatenate(records)
        owner = np.repeat(np.arange(len(records)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.shingles, first = np.unique(values[order], return_index=True)
        self.bounds = np.append(first, len(values))
        self.owners = owner[order]

    def search(self, query: np.ndarray, percent: int) -> dict[int, int]:
        """Records that reach the overlap needed with the query, and their overlap.

        DivideSkip: of the query's lists the longest are set aside, L of them, fewer than the least needed overlap T;
        a record must be in T - L of the others. Those are merged (counted as arrays, which is faster than a heap of
        Python integers), and only records that reach that are looked up in the long ones by binary search. L is
        T / (MU * log2 of the longest list + 1).
        """
        fitting = 100 * np.minimum(self.sizes, len(query)) >= percent * np.maximum(self.sizes, len(query))
        if not fitting.any():
            return {}
        needed = -(-percent * (len(query) + self.sizes) // (100 + percent))
        least = int(needed[fitting].min())
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        lengths = self.bounds[at + 1] - self.bounds[at]
        by_length = at[np.argsort(lengths, kind="stable")]
        if not len(at):
            return {}
        aside = min(least - 1, int(least / (MU * np.log2(max(2, int(lengths.max()))) + 1)))
        short, long_ones = by_length[: max(0, len(at) - aside)], by_length[max(0, len(at) - aside) :]
        starts, lengths = self.bounds[short], self.bounds[short + 1] - self.bounds[short]
        places = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        counts = np.bincount(self.owners[places.astype(np.int64)], minlength=len(self.records))
        probes = np.sort(self.shingles[long_ones])
        found = {}
        for record in np.flatnonzero(fitting & (counts >= least - len(long_ones)) & (counts >= needed - len(long_ones))):
            own = self.records[record]
            near = np.minimum(np.searchsorted(own, probes), len(own) - 1)
            overlap = int(counts[record]) + int((own[near] == probes).sum())
            if overlap >= needed[record]:
                found[int(record)] = overlap
        return found


def _searched(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sets, those that link: a, b. Pairs of a query that are in a batch are one search."""
    for batch in batches:
        by_query: dict[int, list[int]] = {}
        for i, a in enumerate(batch["a"].to_pylist()):
            by_query.setdefault(a, []).append(i)
        linked = []
        for own in by_query.values():
            query = np.frombuffer(batch["query"][own[0]].as_buffer(), np.uint64)
            records = Lists([np.frombuffer(batch["record"][i].as_buffer(), np.uint64) for i in own])
            linked += [own[i] for i in records.search(query, percent)]
        if linked:
            yield pa.RecordBatch.from_arrays([batch[name].take(pa.array(linked)) for name in ("a", "b")], ["a", "b"])


def _within(percent: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the sets of two blocks of a group; of those between two components, one."""
    sets = [np.frombuffer(value, np.uint64) for value in rows["shingles"]]
    labels, ids, blocks = rows["label"].to_numpy(), rows["set_id"].to_numpy(), rows["block"].to_numpy()
    low, high = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    queries, records = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    seen, found = set(), []
    if len(queries) and len(records):
        lists = Lists([sets[k] for k in records])
        for q in queries:
            for k in lists.search(sets[q], percent):
                between = (labels[q], labels[records[k]])
                if between[0] != between[1] and between not in seen:
                    seen.add(between)
                    found.append((ids[q], ids[records[k]]))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


# ---- the join


class Join:
    """The steps of the join over one table of documents."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int):
        self.spark: SparkSession = docs.sparkSession
        self.shingle, self.percent = shingle, percent
        T.small_batches(self.spark)
        self.texts = T.needed(docs, "doc_id", "text")
        self.rows = 0  # entries of the inverted lists; tables of sets and pairs are about as long at most
        self.speaking: DataFrame | None = None  # set_id, key: the hash of a doc_id that has the set
        self.id_type = docs.schema["doc_id"].dataType.simpleString()

    def _broadcast(self, bitmap: np.ndarray):
        return self.spark.sparkContext.broadcast(bitmap)

    def documents(self) -> DataFrame:
        """doc_id, set_id, check_id, n, prefix of each row, stored."""
        together = self.texts.select("text").mapInArrow(partial(_together, self.shingle), "hash long, times long")
        long_ones = together.groupBy("hash").agg(F.sum("times").alias("times")).filter(F.col("times") >= SHARED_DOCUMENTS)
        bitmap = self._broadcast(_bitmap(long_ones, "hash"))
        schema = f"doc_id {self.id_type}, set_id long, check_id long, n long, prefix array<long>"
        return stored(self.texts.mapInArrow(partial(_scan, self.shingle, self.percent, bitmap), schema), "shingles", **PLAIN)

    def lists(self, documents: DataFrame) -> DataFrame:
        """Inverted lists of two sets or more: shingle, set_id, n, stored. Copies are one entry."""
        rows = documents.select("set_id", "n", F.explode("prefix").alias("shingle"))
        several = rows.groupBy("shingle").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"))
        several = several.filter("low <> high").select("shingle")
        found = stored(rows.join(several, "shingle").distinct(), "lists", **PLAIN)
        self.rows = found.count()
        return found

    def _fit(self, n: str, m: str):
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def enough(self, met: DataFrame) -> DataFrame:
        """Pairs (a, b, n_a, n_b, met) whose sizes and meetings allow the needed overlap.

        Up to the end of the shorter of two prefixes, every common shingle is in both, so a meeting; past it, not
        more can be common than that set has left.
        """
        p = F.lit(self.percent)
        least = F.ceil(p * (F.col("n_a") + F.col("n_b")) / (100 + p))
        rest = lambda n: F.ceil(p * F.col(n) / 100) - 1  # noqa: E731  what a set has after its prefix
        return met.filter(self._fit("n_a", "n_b") & (F.col("met") + F.greatest(rest("n_a"), rest("n_b")) >= least))

    def sets(self, ends: DataFrame) -> DataFrame:
        """set_id, shingles of the sets named, stored; their documents are read again."""
        ends = stored(ends.select("set_id").distinct(), "ends", self.rows, **PLAIN)
        # one document speaks for a set; its key tells tasks to read its text
        keys = self.speaking.join(ends, "set_id", "left_semi")
        wanted = self._broadcast(_bitmap(keys, "key"))
        keyed = self.texts.select("text", F.xxhash64("doc_id").alias("key"))
        sets = keyed.mapInArrow(partial(_wanted, self.shingle, wanted), "set_id long, shingles binary")
        # strangers that share a bit, or a doc_id, are dropped before sets travel further
        sets = sets.join(ends, "set_id", "left_semi").groupBy("set_id").agg(F.first("shingles").alias("shingles"))
        return stored(sets, "sets", ends.count() * ROWS_PER_FILE // SETS_PER_FILE, **PLAIN)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, stored."""
        pairs = stored(pairs.select("a", "b"), "pairs", self.rows, **PLAIN)
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("set_id")))
        records = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("record"))
        queries = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("query"))
        both = pairs.join(records, "b").join(queries, "a").select("a", "b", "query", "record")
        return stored(both.mapInArrow(partial(_searched, self.percent), "a long, b long"), "linked", self.rows, **PLAIN)

    def groups(self, entries: DataFrame, tried: DataFrame) -> DataFrame:
        """set_id, label, group, members: sets that pivots connect, where they are many and of several components.

        tried: the pairs of sets and pivots, linked or not.
        """
        homes = components(tried).select(F.col("node").alias("set_id"), F.col("component").alias("group"))
        homes = entries.select("set_id", "label").distinct().join(homes, "set_id")
        sizes = homes.groupBy("group").agg(
            F.count("*").alias("members"), F.min("label").alias("least"), F.max("label").alias("most")
        )
        large = sizes.filter((F.col("members") > GROUP_SETS) & (F.col("least") != F.col("most"))).select("group", "members")
        return stored(homes.join(large, "group"), "groups", self.rows, **PLAIN)

    def linked_within(self, groups: DataFrame) -> DataFrame:
        """Links between components inside each group: every block of its sets is searched against every other.

        A set travels once per block of its group, and pairs are never rows.
        """
        blocks = F.ceil(F.col("members") / BLOCK_SETS).cast("int")
        placed = groups.withColumn("block", F.pmod(F.xxhash64("set_id"), blocks).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        rows = placed.join(self.sets(groups), "set_id").select("group", "i", "j", "block", "set_id", "label", "shingles")
        found = rows.groupBy("group", "i", "j").applyInPandas(partial(_within, self.percent), "a long, b long")
        return stored(found, "linked", self.rows, **PLAIN)

    def links(self, lists: DataFrame) -> DataFrame:
        """Links that connect all linked sets: a, b.

        Rounds with pivots: in each list the least set of each other component is a pivot; every set is searched
        against the pivot it meets most. Groups of near copies become one component in a few rounds, with one pair
        per set. Then all pairs of sets in different components that meet often enough are searched, and within
        large groups that pivots connect all blocks of sets.
        """
        found = tried = self.spark.createDataFrame([], "a long, b long")
        for _ in range(ROUNDS):
            entries = self._labelled(lists, found)
            if entries is None:
                return found
            # the least set of the least label, and of the next: each entry has one with another label than its own
            labels = entries.groupBy("shingle", "label").agg(F.min(F.struct("set_id", "n")).alias("pivot"))
            two = labels.groupBy("shingle").agg(
                F.min(F.struct("label", "pivot")).alias("one"), F.max(F.struct("label", "pivot")).alias("other")
            )
            pivot = F.when(F.col("one.label") == F.col("label"), F.col("other.pivot")).otherwise(F.col("one.pivot"))
            met = entries.join(two, "shingle").select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), pivot.alias("p"))
            met = met.groupBy(F.col("p.set_id").alias("a"), "b", F.col("p.n").alias("n_a"), "n_b").agg(F.count("*").alias("met"))
            # a set near another meets pivots of several lists: together they tell whether there can be one of its size
            best = met.filter(self._fit("n_a", "n_b")).groupBy("b", "n_b").agg(
                F.max_by(F.struct("a"), F.struct("met", -F.col("a"))).alias("best"), F.sum("met").alias("met")
            )
            best = self.enough(best.withColumn("n_a", F.col("n_b")))
            best = stored(best.select(F.col("best.a").alias("a"), "b"), "best", self.rows, **PLAIN)
            tried = tried.unionByName(best)
            fresh = self.linked(best)
            if fresh.isEmpty():
                break
            found = stored(found.unionByName(fresh), "links", self.rows, **PLAIN)
        entries = self._labelled(lists, found)
        if entries is None:
            return found
        groups = self.groups(entries, stored(tried, "tried", self.rows, **PLAIN))
        entries = entries.join(groups.select("set_id", "group"), "set_id", "left")
        side = lambda x: entries.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("set_id", "n", "label", "group")])
        p = self.percent
        fit = (F.col("set_id_a") < F.col("set_id_b")) & (F.col("label_a") != F.col("label_b"))
        fit = fit & (100 * F.col("n_a") >= p * F.col("n_b")) & (100 * F.col("n_b") >= p * F.col("n_a"))
        fit = fit & ~F.coalesce(F.col("group_a") == F.col("group_b"), F.lit(False))
        met = side("a").join(side("b"), "shingle").filter(fit).groupBy("set_id_a", "set_id_b", "n_a", "n_b")
        met = met.agg(F.count("*").alias("met")).withColumnsRenamed({"set_id_a": "a", "set_id_b": "b"})
        found = found.unionByName(self.linked(self.enough(met)))
        if not groups.isEmpty():
            found = found.unionByName(self.linked_within(groups))
        return stored(found, "links", self.rows, **PLAIN)

    def _labelled(self, lists: DataFrame, found: DataFrame) -> DataFrame | None:
        """Entries of lists that still have two components or more, with the component as label."""
        if found.isEmpty():
            entries = lists.withColumn("label", F.col("set_id"))
        else:
            labels = components(found).select(F.col("node").alias("set_id"), F.col("component").alias("label"))
            entries = lists.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        open_lists = entries.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        entries = stored(entries.join(open_lists.filter("low <> high").select("shingle"), "shingle"), "entries", self.rows, **PLAIN)
        return None if entries.isEmpty() else entries


def ngram_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, itself included): one row per row of docs.

    Two documents link when 100 * overlap >= percent * union of their shingle sets. Documents with equal sets are one
    node of the search, however many they are. A text of fewer words than a shingle is one shingle; a null text, or
    one without words, has an empty set, links with nothing and is its own component. A row with a null doc_id is in
    the component of its links; if no doc_id is there, component_id is null. Sets are told apart by 64-bit hashes.
    """
    join = Join(docs, shingle, percent)
    documents = join.documents()
    join.speaking = stored(documents.filter("n > 0").groupBy("set_id").agg(F.min(F.xxhash64("doc_id")).alias("key")), "speaking", **PLAIN)
    found = join.links(join.lists(documents))
    labels = stored(components(found), "labels", **PLAIN).select(F.col("node").alias("set_id"), F.col("component").alias("label"))
    sets = documents.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("low"))
    sets = sets.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    lowest = sets.groupBy("label").agg(F.min("low").alias("component_id"))
    named = sets.join(lowest, "label").select("set_id", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    rows = documents.select("doc_id", "set_id", "n").join(named, "set_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the least doc_id stays.

    Rows that share doc_id and text are one document; of rows that share only doc_id in one component, one stays.
    """
    keys = [F.col("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2")]
    joined = ngram_join(docs.select(F.struct(*keys).alias("doc_id"), "text"), shingle, percent)
    staying = joined.filter(F.col("doc_id") == F.col("component_id"))
    staying = stored(staying.select("doc_id.*").distinct().withColumnRenamed("doc_id", "of_doc"), "staying", **PLAIN)
    rows = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("_row"), *keys)
    same = (rows["h1"] == staying["h1"]) & (rows["h2"] == staying["h2"]) & rows["doc_id"].eqNullSafe(staying["of_doc"])
    return rows.join(staying, same, "left_semi").dropDuplicates(["h1", "h2", "doc_id"]).select("_row.*")
