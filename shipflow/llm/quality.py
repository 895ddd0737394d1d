"""Quality rules: counts per text, and robust multivariate outliers per language and source."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.session import stored

WINDOW_WORDS = 8
SPACES = "\t\n\x0b\f\r"

# Coordinates of a text, all on a log scale, and the spread below which differences are taken for noise.
# In the largest group of clean texts most counts are zero, so their own spread would be none.
COORDINATES = {
    "length": ("log1p(n_words)", 0.5),
    "word_length": ("ln(word_chars / n_words)", 0.1),
    "symbols": ("log1p(100 * n_symbols / word_chars)", 0.2),
    "dup_lines": ("log1p(n_dup_lines)", 0.7),
    "repeats": ("log1p(100 * n_repeat_words / n_words)", 0.7),
}
UNIT = 1000  # coordinates are whole numbers of 1 / UNIT, so their sums do not depend on the order of rows
KEPT_SHARE = 0.75
# Share / P(chi2 with 7 degrees <= the 75 % point of chi2 with 5 degrees): makes the trimmed covariance unbiased.
CONSISTENCY = 1.41
CUTOFF = 41.0  # about the 1 - 1e-7 point of chi2 with 5 degrees
LEAST_FALL = 1e-3  # of the log determinant in a C-step; with less a group rests
PRIOR_ROWS = 50  # how many rows' worth of the language's estimate a source's estimate includes
BUCKETS_PER_E = 64  # distances are counted in buckets of 1 / 64 on the log scale


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside windows of eight words found twice or more in the array."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW_WORDS - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW_WORDS)))

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda value, i: F.struct(value.alias("v"), i.alias("i"))))

        def neighbours(pairs: Column) -> Column:
            same_before = lambda e, k: (k > 0) & (F.get(pairs, k - 1)["v"] == e["v"])
            same_after = lambda e, k: F.coalesce(F.get(pairs, k + 1)["v"] == e["v"], F.lit(False))
            return F.filter(pairs, lambda e, k: F.coalesce(same_before(e, k), F.lit(False)) | same_after(e, k))

        places = F.sort_array(F.transform(_let(ordered, neighbours), lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW_WORDS).alias("last"))
        add = lambda a, i: F.struct(
            (a["total"] + F.least(F.lit(WINDOW_WORDS), i - a["last"])).alias("total"), i.alias("last")
        )
        return F.aggregate(places, start, add, lambda a: a["total"])

    def counted(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))

    return F.when(F.size(words) > WINDOW_WORDS, _let(hashes, counted)).otherwise(F.lit(0))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text, after the kept columns.

    A null text has none of all.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES + " ", "")) > 0)
    in_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("r")))
    in_lines = _let(lines, lambda held: F.size(held) - F.size(F.array_distinct(held)))
    counted = docs.select(
        *[docs[name] for name in keep],
        in_words.alias("_words"),
        F.length(F.translate(text, SPACES + " ", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        in_lines.cast("long").alias("n_dup_lines"),
    )
    return counted.select(
        *keep,
        F.col("_words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("_words.r").cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


# ---- minimum covariance determinant

GROUP = ["lang", "source"]
NAMES = list(COORDINATES)
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]


def _same_group(left: DataFrame, right: DataFrame, columns: list[str]):
    return reduce(and_, [left[name].eqNullSafe(right[f"_{name}"]) for name in columns])


def _joined(rows: DataFrame, table: DataFrame, columns: list[str] = GROUP) -> DataFrame:
    """Rows with the values of their group; null is a language or source like any other."""
    renamed = table.withColumnsRenamed({name: f"_{name}" for name in columns})
    return rows.join(renamed, _same_group(rows, renamed, columns)).drop(*[f"_{name}" for name in columns])


def _middle(counts: DataFrame, columns: list[str], value: str) -> DataFrame:
    """The smallest value that has half of the counted rows at or below it."""
    upto = Window.partitionBy(*columns).orderBy(value)
    whole = Window.partitionBy(*columns)
    half = counts.withColumn("upto", F.sum("rows").over(upto)).withColumn("all", F.sum("rows").over(whole))
    return half.filter("2 * upto >= all").groupBy(*columns).agg(F.min(value).alias("middle"))


def _medians(vectors: DataFrame) -> DataFrame:
    """Medians and median deviations per group, as a first centre and (diagonal) spread."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.floor(F.col(n) / 50).alias("cell")) for n in NAMES]))
    counts = stored(vectors.select(*GROUP, cells.alias("c")).groupBy(*GROUP, "c.name", "c.cell").agg(F.count("*").alias("rows")), "cells")
    key = [*GROUP, "name"]
    middles = _middle(counts, key, "cell")
    away = _joined(counts, middles, key).withColumn("away", F.abs(F.col("cell") - F.col("middle")))
    spread = _middle(away.groupBy(*key, "away").agg(F.sum("rows").alias("rows")), key, "away")
    both = _joined(middles.withColumnRenamed("middle", "cell"), spread, key)
    pick = lambda column, n: F.max(F.when(F.col("name") == n, F.col(column)))
    wide = both.groupBy(*GROUP).agg(
        *[((pick("cell", n) + 0.5) * 50 / UNIT).alias(f"m_{n}") for n in NAMES],
        *[F.pow(1.4826 * pick("middle", n) * 50 / UNIT, F.lit(2)).alias(f"s_{n}_{n}") for n in NAMES],
    )
    return wide.withColumns({f"s_{a}_{b}": F.lit(0.0) for a, b in PAIRS if a != b})


def _cholesky(table: DataFrame) -> DataFrame:
    """Adds the lower factor l_a_b of the covariance s_a_b plus the squared noise, and its log determinant.

    The noise keeps every pivot positive, whatever the rows.
    """
    factors: dict[tuple[str, str], Column] = {}
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[: i + 1]):
            rest = F.col(f"s_{a}_{b}") + (F.lit(COORDINATES[a][1] ** 2) if i == j else F.lit(0.0))
            for c in NAMES[:j]:
                rest = rest - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            factors[a, b] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{b}_{b}")
            table = table.withColumn(f"l_{a}_{b}", factors[a, b])
    return table.withColumn("log_determinant", 2 * sum((F.log(f"l_{n}_{n}") for n in NAMES), F.lit(0.0)))


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance of vectors joined with their group's centre and factor."""
    for i, a in enumerate(NAMES):
        rest = F.col(a) / UNIT - F.col(f"m_{a}")
        for b in NAMES[:i]:
            rest = rest - F.col(f"l_{a}_{b}") * F.col(f"z_{b}")
        rows = rows.withColumn(f"z_{a}", rest / F.col(f"l_{a}_{a}"))
    square = sum((F.col(f"z_{n}") * F.col(f"z_{n}") for n in NAMES), F.lit(0.0))
    return rows.withColumn("distance", square)


SUMS = ["rows", *[f"t_{n}" for n in NAMES], *[f"t_{a}_{b}" for a, b in PAIRS]]
KEY = [*GROUP, "start"]


def _sums() -> list[Column]:
    """Rows, sums and sums of products of the whole-numbered coordinates."""
    products = [F.sum(F.col(a) * F.col(b)).alias(f"t_{a}_{b}") for a, b in PAIRS]
    return [F.count("*").alias("rows"), *[F.sum(n).alias(f"t_{n}") for n in NAMES], *products]


def _moments(sums: DataFrame) -> DataFrame:
    """Centre and covariance of each group and start; a source's are mixed with PRIOR_ROWS rows of its language's."""
    language = sums.groupBy("lang", "start").agg(*[(F.sum(name) / F.sum("rows") * PRIOR_ROWS).alias(f"p_{name}") for name in SUMS])
    mixed = _joined(sums, language, ["lang", "start"]).select(*KEY, *[(F.col(n) + F.col(f"p_{n}")).alias(n) for n in SUMS])
    mean = {n: F.col(f"t_{n}") / F.col("rows") for n in NAMES}
    return mixed.select(
        *KEY,
        *[(mean[n] / UNIT).alias(f"m_{n}") for n in NAMES],
        *[((F.col(f"t_{a}_{b}") / F.col("rows") - mean[a] * mean[b]) / UNIT**2 * CONSISTENCY).alias(f"s_{a}_{b}") for a, b in PAIRS],
    )


def _directions(vectors: DataFrame, medians: DataFrame) -> DataFrame:
    """The medians with the covariance of the directions in which rows lie from them, however far."""
    away = _distance(_joined(vectors, medians))
    unit = {n: F.when(F.col("distance") > 0, F.round(UNIT * F.col(f"z_{n}") / F.sqrt("distance"))).otherwise(0).cast("long") for n in NAMES}
    sums = away.select(*GROUP, *[value.alias(n) for n, value in unit.items()]).groupBy(*GROUP).agg(*_sums())
    size = lambda a, b: F.col(f"l_{a}_{a}") * F.col(f"l_{b}_{b}") * len(NAMES) / UNIT**2
    spread = [(size(a, b) * F.col(f"t_{a}_{b}") / F.col("rows")).alias(f"s_{a}_{b}") for a, b in PAIRS]
    return _joined(sums, medians).select(*GROUP, *[f"m_{n}" for n in NAMES], *spread)


def starts(vectors: DataFrame) -> DataFrame:
    """Three estimates of each group: medians, the moments of all its rows, and directions from the medians."""
    medians = stored(_cholesky(_medians(vectors)), "estimate")
    whole = _moments(vectors.groupBy(*GROUP).agg(*_sums()).withColumn("start", F.lit(1)))
    columns = [*KEY, *[f"m_{n}" for n in NAMES], *[f"s_{a}_{b}" for a, b in PAIRS]]
    first = medians.withColumn("start", F.lit(0)).select(*columns)
    directions = _directions(vectors, medians).withColumn("start", F.lit(2)).select(*columns)
    return stored(_cholesky(first.unionByName(whole.select(*columns)).unionByName(directions)), "starts")


def _concentrate(vectors: DataFrame, estimate: DataFrame, groups: int) -> DataFrame:
    """A C-step: centre and covariance of the share of rows nearest by the last estimate, per group and start.

    Rows are counted and summed per bucket of distance in one pass for all starts; the nearest share is the buckets up
    to the one that fills it.
    """
    bucket = F.floor(F.log1p("distance") * BUCKETS_PER_E)
    buckets = _distance(_joined(vectors, estimate)).groupBy(*KEY, bucket.alias("bucket")).agg(*_sums())
    below = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*KEY)
    near = buckets.withColumn("below", F.coalesce(F.sum("rows").over(below), F.lit(0))).withColumn("all", F.sum("rows").over(whole))
    near = near.filter(F.col("below") < KEPT_SHARE * F.col("all"))
    near = stored(near.groupBy(*KEY).agg(*[F.sum(name).cast("double").alias(name) for name in SUMS]), "moments", groups)
    return _cholesky(_moments(near))


def _lower(after: DataFrame, before: DataFrame) -> DataFrame:
    """The estimates after a step where they have the smaller determinant, else those before; fell says which."""
    values = [name for name in before.columns if name not in (*KEY, "fell")]
    kept = before.select(*KEY, F.struct(*values).alias("before"))
    both = _joined(after.select(*KEY, F.struct(*values).alias("after")), kept, KEY)
    both = both.withColumn("fell", F.col("after.log_determinant") < F.col("before.log_determinant") - LEAST_FALL)
    return both.select(*KEY, F.when(F.col("fell"), F.col("after")).otherwise(F.col("before")).alias("kept"), "fell").select(*KEY, "kept.*", "fell")


def estimates(vectors: DataFrame) -> DataFrame:
    """Robust centre, covariance factor and log determinant of each language and source.

    C-steps go on from each start until no determinant falls any more (each step that counts lowers one by LEAST_FALL,
    and the noise bounds them from below, so it ends). Of a group's starts the one with the least determinant stays.
    """
    found = starts(vectors)
    groups = found.count()
    found = stored(_concentrate(vectors, found, groups), "estimate", groups)
    while True:
        found = stored(_lower(_concentrate(vectors, found.drop("fell"), groups), found), "estimate", groups)
        if found.filter("fell").isEmpty():
            break
    values = [name for name in found.columns if name not in (*GROUP, "fell")]
    least = F.min_by(F.struct(*values), F.struct(F.round("log_determinant", 9), "start")).alias("best")
    return stored(found.groupBy(*GROUP).agg(least).select(*GROUP, "best.*"), "best", groups)


def judge(counts: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Stored statistics with base_failed, distance and kept.

    The vectors of rows that pass the base rules make the estimates; a row is kept if it passes them and lies within
    the cutoff. Distance is null for rows that fail them. A source of few rows leans on its language's estimate; an
    empty table, or one whose rows all fail, has no groups and no distances.
    """
    named = counts.withColumn("base_failed", base_failed())
    coordinates = {n: F.round(F.expr(value) * UNIT).cast("long") for n, (value, _) in COORDINATES.items()}
    passed = named.filter("NOT base_failed").withColumns(coordinates)
    found = estimates(passed.select(*GROUP, *NAMES))
    inner = [name for name in found.columns if name not in GROUP] + [f"z_{n}" for n in NAMES] + NAMES
    near = _distance(_joined(passed, found)).drop(*inner).withColumn("kept", F.col("distance") <= cutoff)
    failed = named.filter("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    return near.unionByName(failed)


def quality(docs: DataFrame, **options) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance, kept: one row per row of docs."""
    frame = T.needed(docs, "doc_id", "lang", "source", "text")
    return judge(stored(statistics(frame, "doc_id", "lang", "source"), "statistics"), **options)


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, unchanged."""
    whole = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("_row"), "lang", "source", "text")
    counts = stored(statistics(whole, "_row", "lang", "source"), "statistics")
    return judge(counts, **options).filter("kept").select("_row.*")
