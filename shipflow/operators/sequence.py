"""Row-to-row operators over ordered groups, safe when one group holds much of the data.

A window over ``partitionBy(key)`` puts a whole group into one task. Groups above ``max_rows`` are
therefore cut into consecutive pieces along the order; the window runs per (key, piece), and what a
piece needs from the one before it is carried over from a small per-piece summary. Smaller groups
stay whole, and if no group is larger the plan is the plain window.

Input is read more than once unless the size of the largest group is given: pass a stored layer, not a long lineage.
"""

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GROUP_ROWS = 4_000_000
BROADCAST_PIVOTS = 200_000
SALTS = 256
PIECE = "_piece"
TIE = "_tie"


@dataclass(frozen=True)
class Groups:
    """Rows of a table with the key, the order and the cut of its groups."""

    rows: DataFrame
    key: str
    order: tuple[str, ...]
    has_pieces: bool

    @property
    def unit(self) -> list[str]:
        """Columns that identify what one task works through."""
        return [self.key, PIECE] if self.has_pieces else [self.key]

    def window(self):
        return Window.partitionBy(*self.unit).orderBy(*self.order)

    def pieces(self, *summary: Column) -> DataFrame:
        """One row per piece of the groups that were cut."""
        return self.rows.filter(F.col(PIECE).isNotNull()).groupBy(*self.unit).agg(*summary)

    def across_pieces(self):
        return Window.partitionBy(self.key).orderBy(PIECE)


def _pivots_up_to(pivots: Column, position: Column, bits: int = 24) -> Column:
    """How many of the sorted pivots are at or before ``position``, by binary search."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(bits))])

    def advance(reached: Column, step: Column) -> Column:
        fits = (reached + step <= F.size(pivots)) & (F.get(pivots, reached + step - 1) <= position)
        return F.when(fits, reached + step).otherwise(reached)

    return F.aggregate(steps, F.lit(0), advance)


def cut_groups(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    max_rows: int = MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
    largest: int | None = None,
) -> Groups:
    """Cut groups of more than ``max_rows`` rows into pieces of about a quarter of that.

    Pivots, where pieces begin, are the rows whose hashed order columns fall on one residue. The rule
    is not random, so a recomputed task cuts alike. There is about one pivot in ``max_rows / 4`` rows
    of large groups; up to ``BROADCAST_PIVOTS`` they are broadcast, beyond that joined with a salt.
    Rows tied in the order columns are told apart by a hash of the whole row, so only rows that are
    equal throughout stay together. Rows without a key are in no group and are left out.

    The sizes of the groups decide the plan, so a job looks at them right away. It counts the rows, unless ``sizes``
    (key, rows) tells, for which a table that has been made anyway will do, such as the event counts of the shipment
    metrics; sizes that are too high cut more than is needed. With ``largest``, the rows of the largest group at
    most, no job runs if that is not above ``max_rows``, and the input is read once.
    """
    df = df.filter(F.col(key).isNotNull()).withColumn(TIE, F.xxhash64(*df.columns))
    order = (*order, TIE)
    if largest is not None and largest <= max_rows:
        return Groups(df, key, tuple(order), has_pieces=False)
    if sizes is None:
        sizes = df.groupBy(key).agg(F.count("*").alias("_rows"))
    else:
        sizes = sizes.toDF(key, "_rows")
    sizes = sizes.filter(F.col("_rows") > max_rows)
    large = sizes.agg(F.count("*").alias("groups"), F.sum("_rows").alias("rows")).first()
    if large.groups == 0:
        return Groups(df, key, tuple(order), has_pieces=False)

    position = F.struct(*order)
    piece_rows = max(max_rows // 4, 1)
    pivots = (
        df.select(key, *order)
        .filter(F.pmod(F.xxhash64(*order), F.lit(piece_rows)) == 0)
        .join(sizes, key)
        .groupBy(key)
        .agg(F.array_sort(F.collect_set(position)).alias("_pivots"))
    )
    if large.rows // piece_rows + large.groups <= BROADCAST_PIVOTS:
        rows = df.join(F.broadcast(pivots), key, "left")
    else:
        # A large group must not meet in one task here either: spread it over salted copies of its pivots.
        salted = pivots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, [key, "_salt"], "left").drop("_salt")
    piece = F.when(F.col("_pivots").isNotNull(), _pivots_up_to(F.col("_pivots"), position))
    return Groups(rows.withColumn(PIECE, piece).drop("_pivots"), key, tuple(order), has_pieces=True)


def with_previous(groups: Groups, columns: Sequence[str], name: str = "previous") -> Groups:
    """Add ``name``: struct of ``columns`` from the row before in the group, null at its start."""
    values = F.struct(*columns)
    rows = groups.rows.withColumn(name, F.lag(values).over(groups.window()))
    if groups.has_pieces:
        lasts = groups.pieces(F.max_by(values, F.struct(*groups.order)).alias("_last"))
        carried = lasts.withColumn("_carried", F.lag("_last").over(groups.across_pieces())).drop("_last")
        rows = (
            rows.join(carried, groups.unit, "left")
            .withColumn(name, F.coalesce(name, "_carried"))
            .drop("_carried")
        )
    return replace(groups, rows=rows)


def with_position(groups: Groups, name: str) -> Groups:
    """Add ``name``: the row's number within its group, from 1."""
    rows = groups.rows.withColumn(name, F.row_number().over(groups.window()).cast("long"))
    if groups.has_pieces:
        before = groups.across_pieces().rowsBetween(Window.unboundedPreceding, -1)
        sizes = groups.pieces(F.count("*").alias("_rows"))
        offsets = sizes.withColumn("_offset", F.sum("_rows").over(before)).drop("_rows")
        rows = (
            rows.join(offsets, groups.unit, "left")
            .withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0)))
            .drop("_offset")
        )
    return replace(groups, rows=rows)


def with_highest_before(groups: Groups, value: Column, name: str) -> Groups:
    """Add ``name``: the greatest ``value`` among the rows before in the group, null if there is none."""
    rows = groups.rows.withColumn(name, F.max(value).over(groups.window().rowsBetween(Window.unboundedPreceding, -1)))
    if groups.has_pieces:
        before = groups.across_pieces().rowsBetween(Window.unboundedPreceding, -1)
        carried = groups.pieces(F.max(value).alias("_highest")).withColumn("_carried", F.max("_highest").over(before))
        rows = (
            rows.join(carried.drop("_highest"), groups.unit, "left")
            .withColumn(name, F.greatest(name, "_carried"))
            .drop("_carried")
        )
    return replace(groups, rows=rows)
