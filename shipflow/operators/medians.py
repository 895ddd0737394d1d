"""Exact medians of several columns without bringing a column into one task.

``median`` keeps every distinct value of the column in one task at the end. Here three passes count
values in ever finer buckets and follow the buckets that hold the middle ranks:

1. buckets of 1/256 of a power of two (at most about 1.1 million exist for all doubles);
2. 2**20 equal steps within the one or two buckets kept;
3. the values themselves within the steps kept, of which a step can hold at most 2**24.

Every bucket function is monotone, so ranks carry over exactly. The counts are combined on the map
side, so a value held by most rows is one row per task. Buckets are ranked in two steps, parts of consecutive
buckets and then the buckets of the parts kept (octaves and their 256 parts, 1,024 ranges of 1,024 steps, 4,096 parts of
a step with at most some 4,096 doubles each), so no window sees more than about 8,000 rows and no row holds more
than about 4,096 cells.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_OCTAVE = 256
OCTAVES = 1100  # more than the exponents of a double reach
STEPS = 1 << 20
RANGE_STEPS = 1 << 10  # steps that are ranked together
STEP_PARTS = 1 << 12  # of a step, whose values are ranked together
RANKS = ["low_rank", "high_rank"]


def _magnitude_bucket(value: Column) -> Column:
    """Monotone bucket number; infinities have buckets of their own."""
    octave = F.least(F.log2(F.abs(value)), F.lit(float(OCTAVES)))
    size = F.floor(octave * STEPS_PER_OCTAVE).cast("long") + STEPS_PER_OCTAVE * OCTAVES + 1
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0)


def _holding_middle(rows: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Rows of each group that hold a middle rank, with first_rank, the rank of their first value.

    Rows have n values each, in the order of place; start is the rank at which their group begins, low_rank and
    high_rank are the ranks looked for, from 0.
    """
    running = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("first_rank", F.col("start") + F.coalesce(F.sum("n").over(running), F.lit(0)))
    return ranked.filter((F.col("first_rank") <= F.col("high_rank")) & (F.col("first_rank") + F.col("n") > F.col("low_rank")))


def _parts(counts: DataFrame, keys: Sequence[str], part: Column, cell: Sequence[str]) -> DataFrame:
    """Consecutive buckets put together: a row per part with its n values, and its buckets as an array of cells."""
    cells = F.array_sort(F.collect_list(F.struct(*cell, "n"))).alias("cells")
    return counts.groupBy(*keys, part.alias("part")).agg(cells, F.sum("n").alias("n"))


def _keep_middle(parts: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Buckets that hold a middle rank: first the parts that do, then the buckets in these."""
    kept = _holding_middle(parts, keys, "part")
    buckets = kept.select(*keys, "part", *RANKS, F.col("first_rank").alias("start"), F.inline("cells"))
    return _holding_middle(buckets, [*keys, "part"], bucket).drop("part", "start")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the median of each column; nulls and NaN skipped, no values gives null.

    With an even number of values it is the mean of the middle two. The input is read three times,
    only these columns of it.
    """
    values = (
        df.select(*columns)
        .unpivot([], list(columns), "name", "value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("bucket", _magnitude_bucket(F.col("value")))
    )

    coarse = values.groupBy("name", "bucket").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    octave = F.floor(F.col("bucket") / STEPS_PER_OCTAVE)
    whole = F.sum("n").over(Window.partitionBy("name"))
    octaves = _parts(coarse, ["name"], octave, ["bucket", "low", "high"]).withColumns(
        {
            "start": F.lit(0).cast("long"),
            "low_rank": F.floor((whole - 1) / 2).cast("long"),
            "high_rank": F.floor(whole / 2).cast("long"),
        }
    )
    kept = _keep_middle(octaves, ["name"], "bucket").withColumnRenamed("first_rank", "start").drop("n")

    # Two columns of at most two rows each: the joins below are with a handful of rows.
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    place = F.coalesce(F.floor((F.col("value") - F.col("low")) / span * (STEPS * STEP_PARTS)), F.lit(0))
    stepped = values.join(F.broadcast(kept), ["name", "bucket"]).withColumn("place", place)
    stepped = stepped.withColumn("step", F.floor(F.col("place") / STEP_PARTS))

    keys = ["name", "bucket"]
    fine = stepped.groupBy(*keys, "step", "start", *RANKS).agg(F.count("*").alias("n"))
    ranges = _parts(fine, [*keys, "start", *RANKS], F.floor(F.col("step") / RANGE_STEPS), ["step"])
    steps = _keep_middle(ranges, keys, "step").select(*keys, "step", F.col("first_rank").alias("step_rank"))
    exact = (
        stepped.join(F.broadcast(steps), [*keys, "step"])
        .groupBy(*keys, "step", "place", "value", F.col("step_rank").alias("start"), *RANKS)
        .agg(F.count("*").alias("n"))
    )
    keys = [*keys, "step"]
    places = _parts(exact, [*keys, "start", *RANKS], F.col("place"), ["value"])
    middle = _keep_middle(places, keys, "value").groupBy("name").agg(
        ((F.min("value") + F.max("value")) / 2).alias("median")
    )
    return middle.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])


RANK_ERROR = 1e-4


def approximate_medians(df: DataFrame, columns: Sequence[str], rank_error: float = RANK_ERROR) -> DataFrame:
    """One row with a value of each column whose rank is within ``rank_error`` times the number of values of the middle.

    One pass: each task sums its values up in a sketch of at most a few times 1 / rank_error of them, and sketches
    merge. Nulls and NaN are skipped, no values gives null. Reruns may give another value within the bound, as the
    sketches merge in the order in which tasks end.
    """
    accuracy = math.ceil(1 / rank_error)
    numbers = [F.when(~F.isnan(name), F.col(name)) for name in columns]
    return df.agg(*[F.percentile_approx(number, 0.5, accuracy).alias(name) for number, name in zip(numbers, columns)])


def rank_errors(df: DataFrame, guesses: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, value_count, rank_error: how far the ranks of values are from the middle, as a share of the values.

    ``guesses`` has one row. Equal values hold a stretch of ranks, and the nearest of it counts.
    """
    known = guesses.select(F.struct(*columns)).scalar()
    parts = []
    for name in columns:
        number = F.when(~F.isnan(name), F.col(name))
        parts += [F.count_if(number < known[name]), F.count_if(number <= known[name]), F.count(number)]
    counts = df.agg(F.array(*parts).alias("counts"))
    rows = [F.struct(F.lit(name).alias("column_name"), F.slice("counts", 3 * i + 1, 3).alias("c")) for i, name in enumerate(columns)]
    below, upto, whole = (F.get("c", F.lit(i)) for i in range(3))
    away = F.greatest(below - whole / 2, whole / 2 - upto, F.lit(0.0))
    return counts.select(F.inline(F.array(*rows))).select(
        "column_name", whole.alias("value_count"), F.try_divide(away, whole).alias("rank_error")
    )
