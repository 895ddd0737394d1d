"""The processed layer from the whole raw layer, of which no event is shuffled.

Only ids, arrival and places of the records meet, to find later copies of an event by where they lie: file and row. A
task then reads files of one date, leaves those rows out and writes the date's events in order. What a task leaves
out lies in a folder of its own, so the two are joined where they are read.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow.operators import cleanse
from shipflow.session import configured, own_tables, shared_path
from shipflow.sources import layers
from shipflow.sources.files import Folder

ROWS_PER_TASK = 800_000  # some 400 MB of events, which a task sorts; the driver plans each task
TASKS_AT_ONCE = 100  # that one job has
SINGLE = "spark.sql.maxSinglePartitionBytes"
LATER = "file string, row bigint, task int"


@dataclass(frozen=True)
class Task:
    """Files of one date, or the rows of a large file from ``first`` to before ``end``."""

    files: tuple[str, ...]
    first: int = 0
    end: int | None = None


def located(raw: DataFrame) -> DataFrame:
    """Raw rows, read from files, with the file and the row that they are."""
    return raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def tasks_of(files: Iterable[tuple], rows_per_task: int) -> tuple[list[Task], dict[str, int]]:
    """Tasks of at most so many rows, and of each file the first task that reads it; ``files``: date, name and rows."""
    tasks, first_task, group, held, day = [], {}, [], 0, None

    def close() -> None:
        nonlocal group, held
        if group:
            first_task.update(dict.fromkeys(group, len(tasks)))
            tasks.append(Task(tuple(group)))
        group, held = [], 0

    for date, file, n in sorted(files, key=lambda known: (known[0], known[1])):
        if date != day or held + n > rows_per_task:
            close()
        day = date
        if n > rows_per_task:
            first_task[file] = len(tasks)
            starts = range(0, n, rows_per_task)
            tasks.extend(Task((file,), start, start + rows_per_task) for start in starts)
            continue
        group.append(file)
        held += n
    close()
    return tasks, first_task


def _task(rows_per_task: int) -> Column:
    return (F.col("first_task") + F.floor(F.col("row") / rows_per_task)).cast("int").alias("task")


def usable_records(records: DataFrame) -> DataFrame:
    """Event and arrival of the raw records that are usable, with their places."""
    return cleanse.valid_events(records, keep=[*S.ARRIVAL_ORDER, "file", "row"], fields=cleanse.REQUIRED)


def write_later_copies(usable: DataFrame, first_task: dict[str, int], rows_per_task: int, path: str) -> None:
    """Places of usable records whose event a usable record before them has, in a folder per task."""
    spark = usable.sparkSession
    numbered = [(file, number, task) for number, (file, task) in enumerate(first_task.items())]
    files = F.broadcast(spark.createDataFrame(numbered, "file string, number int, first_task int"))
    placed = usable.join(files, "file").select("event_id", *S.ARRIVAL_ORDER, "number", "row")
    later = cleanse.later_arrivals(placed, order=[*S.ARRIVAL_ORDER, "number", "row"])
    dealt = later.join(files, "number").select("number", "row", _task(rows_per_task)).repartition("task")
    dealt.join(files, "number").select("file", "row", "task").write.partitionBy("task").parquet(path)


def _quoted(text: str) -> str:
    """SQL text of a name: one expression for many names, as each column object costs a call of the driver's."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _first_copies(records: DataFrame, later: DataFrame, n: int, task: Task, has_later: bool) -> DataFrame:
    """The rows of the ``n``th task but for later copies, in one partition.

    Both tables are listed once for all tasks; a filter of file names, or of the folder, leaves a task's files at planning.
    """
    condition = f"file IN ({', '.join(map(_quoted, task.files))})"
    if task.end is not None:
        condition += f" AND row >= {task.first} AND row < {task.end}"
    rows = records.filter(condition).coalesce(1)
    if has_later:
        places = later.filter(f"task = {n}").selectExpr("file", "row", "true AS _later").coalesce(1)
        # Both are one partition, so there is no shuffle. Spark would move an anti join to before the rows are one.
        rows = rows.join(places.hint("shuffle_hash"), ["file", "row"], "left").filter("_later IS NULL")
    return rows.drop("file", "row", "_later")


def rebuild(spark: SparkSession, raw: DataFrame, raw_path: str, processed_path: str, rows_per_task: int | None = None) -> None:
    """Replace the processed layer by the first usable copy of each event of ``raw``, the layer read from ``raw_path``."""
    dated = located(raw.filter(F.col("event_date").isNotNull()))
    decoded = lambda records: cleanse.valid_events(records.select(*S.RAW_COLUMNS)).drop(*S.ARRIVAL_ORDER)
    if not write_first_copies(dated, usable_records(dated), decoded, processed_path, rows_per_task):
        layers.write_processed(cleanse.processed_events(raw), processed_path)


def write_first_copies(
    records: DataFrame, usable: DataFrame, events_of: Callable[[DataFrame], DataFrame], processed_path: str, rows_per_task: int | None = None
) -> bool:
    """Replace the processed layer by what ``events_of`` makes of ``records``, rows of files with their place, without
    later copies of an event; whether there are records. ``usable``: event, arrival and place of those that count."""
    spark, rows_per_task = records.sparkSession, rows_per_task or ROWS_PER_TASK
    sizes = records.groupBy("file").agg(F.min("event_date").alias("date"), (F.max("row") + 1).alias("n"))
    counts = sizes.select("date", "file", "n").collect()  # names and sizes of files; rows stay where they are
    tasks, first_task = tasks_of(counts, rows_per_task)
    if not tasks:
        return False
    processed_at = F.timestamp_micros(F.lit(spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]))
    with own_tables():
        later_path = shared_path(spark, "later", recorded=True)
        write_later_copies(usable, first_task, rows_per_task, later_path)
        with_later = set(Folder(spark, later_path).names())
        later = spark.read.schema(LATER).parquet(later_path)
        for first in range(0, len(tasks), TASKS_AT_ONCE):
            parts = [
                _first_copies(records, later, n, task, f"task={n}" in with_later)
                for n, task in enumerate(tasks[first : first + TASKS_AT_ONCE], first)
            ]
            events = cleanse.flag_events(events_of(layers.united(parts))).withColumn("processed_at", processed_at)
            # A task per part; single partitions are joined as they are, though the scan counts as large as all of the layer.
            with configured(spark, "spark.sql.unionOutputPartitioning", "false"), configured(spark, SINGLE, str(2**63 - 1)):
                layers.write_sorted(events, processed_path, "append" if first else "overwrite")
    return True
