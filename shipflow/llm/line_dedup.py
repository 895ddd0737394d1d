"""Removal of repeated line runs, by ranks of line-ID sequences that are doubled in length until none repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.llm.ranks import ranked
from shipflow.session import stored

LEAST_LINES = 2
LEAST_WORDS = 50  # for callers that let a line of so many words be a run by itself
PLACE = ["order_id", "row", "line"]
HAS_WORD = r"[^\x20\x09-\x0D]"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows as a struct _row with a number, stored so that the number stays."""
    whole = F.struct(*[docs[name] for name in docs.columns])
    return stored(docs.select(whole.alias("_row"), F.monotonically_increasing_id().alias("row")), "rows")


def line_table(rows: DataFrame) -> DataFrame:
    """Lines that have a word: order_id, row, line (from 0 among these), place (from 0 among all), two hashes."""
    lines = F.split(F.coalesce("_row.text", F.lit("")), "\n")
    cells = F.filter(F.transform(lines, lambda line, i: F.struct(line.alias("l"), i.alias("i"))), lambda c: c["l"].rlike(HAS_WORD))
    return rows.select(F.col("_row.doc_id").alias("order_id"), "row", F.posexplode(cells).alias("line", "cell")).select(
        *PLACE, F.col("cell.i").alias("place"), F.xxhash64("cell.l").alias("h1"), F.xxhash64(F.lit("line"), "cell.l").alias("h2")
    )


def _repeated(places: DataFrame, key: list[str], rows: int | None = None) -> DataFrame:
    """Keys that occur twice or more, with own_rank (in the order of the key) and first place."""
    first = F.min(F.struct(*PLACE)).alias("first")
    groups = places.groupBy(*key).agg(F.count("*").alias("_times"), first).filter("_times > 1").drop("_times")
    return ranked(stored(groups, "groups", rows), key, "own_rank")


def levels(lines: DataFrame) -> list[DataFrame]:
    """For lengths 1, 2, 4, ...: places whose run of that many lines occurs twice or more, with rank and first place.

    Ranks of a length order the suffixes by their first lines of that number, and refine those of half the length:
    a group of equal ranks is an interval of the suffix array whose common prefix has that length at least. A suffix
    that is alone in its group is in its final position, so it takes no part in further doubling; a suffix shorter
    than the run has no run. It ends when no group has two places.
    """
    found, length, rows = [], 1, lines.count()
    places = lines.select(*PLACE, "h1", "h2")
    key = ["h1", "h2"]
    while True:
        groups = _repeated(places, key, rows)
        level = stored(places.join(groups, key).select(*PLACE, F.col("own_rank").alias("rank"), "first"), "level", rows)
        rows = level.count()
        if not rows:
            return found
        found.append(level)
        ahead = level.select(F.col("row").alias("_row"), (F.col("line") - length).alias("_line"), F.col("rank").alias("next_rank"))
        places = level.join(ahead, (F.col("row") == F.col("_row")) & (F.col("line") == F.col("_line")))
        places = stored(places.select(*PLACE, "rank", "next_rank"), "pairs", rows)
        key, length = ["rank", "next_rank"], length * 2


def windows(found: list[DataFrame], lines: int) -> DataFrame:
    """Places whose run of `lines` lines occurs twice or more, with first place: two overlapping runs of a power of 2."""
    power = lines.bit_length() - 1
    if power >= len(found):
        return found[0].filter("false") if found else None
    level = found[power]
    if lines == 1 << power:
        return level
    shift = lines - (1 << power)
    ahead = level.select(F.col("row").alias("_row"), (F.col("line") - shift).alias("_line"), F.col("rank").alias("next_rank"))
    places = level.join(ahead, (F.col("row") == F.col("_row")) & (F.col("line") == F.col("_line")))
    places = stored(places.select(*PLACE, "rank", "next_rank"), "pairs")
    return places.join(_repeated(places, ["rank", "next_rank"]), ["rank", "next_rank"]).select(*PLACE, "first")


def runs(found: list[DataFrame], least_lines: int = LEAST_LINES) -> DataFrame | None:
    """Maximal runs that occur earlier: order_id, row, line, lines, and the place of the first occurrence.

    A window of least_lines lines is a later copy unless it is the first place of its interval. Consecutive windows
    whose first places are consecutive too make one run.
    """
    copies = windows(found, least_lines)
    if copies is None:
        return None
    later = copies.filter((F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line")))
    in_row = Window.partitionBy("row").orderBy("line")
    shifted = F.struct(F.col("first.row").alias("r"), (F.col("first.line") - F.col("line")).alias("d"))
    same = (F.lag("line").over(in_row) == F.col("line") - 1) & (F.lag(shifted).over(in_row) == shifted)
    island = F.sum(F.when(same, 0).otherwise(1)).over(in_row)
    return later.withColumn("run", island).groupBy("order_id", "row", "run").agg(
        F.min("line").alias("line"),
        (F.count("*") + least_lines - 1).alias("lines"),
        F.min("first").alias("first"),
    )


def long_copies(rows: DataFrame, found: list[DataFrame], least_words: int) -> DataFrame:
    """row, line of the lines with so many words that occur earlier."""
    later = found[0].filter((F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line"))).select("row", "line")
    cells = F.filter(F.split(F.coalesce("_row.text", F.lit("")), "\n"), lambda line: line.rlike(HAS_WORD))
    words = F.transform(cells, lambda line: F.regexp_count(line, F.lit(T.WORD)))
    long = rows.select("row", F.posexplode(words).alias("line", "words")).filter(F.col("words") >= least_words).select("row", "line")
    return later.join(long, ["row", "line"])


def deduplicated(docs: DataFrame, least_lines: int = LEAST_LINES, least_words: int | None = None) -> DataFrame:
    """_row (with text cut), n_lines, n_removed, n_runs, longest_run: one row per row of docs.

    Lines are compared whole; lines without a word take no part and stay. Of all occurrences of a run of at least
    least_lines lines (with least_words: or of one line with so many words), the first by (doc_id, row) stays, null doc_ids first; each line of a later one goes. Rows that
    share a doc_id are ordered by their position in the table. What stays is joined as it was, by line ends; a null
    text stays null, a text without repeated runs stays as it is.
    """
    rows = numbered(docs)
    lines = stored(line_table(rows), "lines")
    found = levels(lines)
    copied = runs(found, least_lines)
    removed_of_row = None
    if copied is not None:
        # runs of a row may overlap; a line is removed once
        covered = copied.select("row", "run", "lines", F.explode(F.sequence("line", (F.col("line") + F.col("lines") - 1).cast("int"))).alias("line"))
        if least_words is not None:
            alone = long_copies(rows, found, least_words).join(covered.select("row", "line"), ["row", "line"], "left_anti")
            covered = covered.unionByName(alone.select("row", (-1 - F.col("line")).alias("run"), F.lit(1).alias("lines"), "line"))
        places = lines.select("row", "line", "place").join(covered, ["row", "line"])
        removed_of_row = places.groupBy("row").agg(
            F.collect_set("place").alias("removed"), F.count_distinct("run").alias("n_runs"), F.max("lines").alias("longest_run")
        )
    kinds = "row long, removed array<int>, n_runs long, longest_run long"
    if removed_of_row is None:
        removed_of_row = docs.sparkSession.createDataFrame([], kinds)
    joined = rows.join(removed_of_row, "row", "left")
    split = F.split("_row.text", "\n")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "removed")
    left = F.array_join(F.transform(numbers, lambda i: F.get(split, i)), "\n")
    has_word = F.filter(F.split(F.coalesce("_row.text", F.lit("")), "\n"), lambda line: line.rlike(HAS_WORD))
    return joined.select(
        F.col("_row").withField("text", F.when(F.col("removed").isNull(), F.col("_row.text")).otherwise(left)).alias("_row"),
        F.size(has_word).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run"),
    )


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, longest_run, kept_sha256 (of the text that stays; null is empty)."""
    frame = T.needed(docs, "doc_id", "text")
    done = deduplicated(frame, **options)
    digest = F.sha2(F.coalesce("_row.text", F.lit("")), 256).alias("kept_sha256")
    return done.select("_row.doc_id", "n_lines", "n_removed", "n_runs", "longest_run", digest)


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without later copies of line runs; a document of which no word is left is dropped."""
    done = deduplicated(docs, **options)
    empty = (F.col("n_removed") > 0) & ~F.col("_row.text").rlike(HAS_WORD)
    return done.filter(~F.coalesce(empty, F.lit(False))).select("_row.*").select(*docs.columns)
