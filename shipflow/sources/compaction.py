"""Compaction of the raw layer beside the stream that fills it.

The stream's own files stay as they are: its log names them, and it only ever adds more. A compaction copies small
files of a date into larger ones elsewhere and then notes which files those stand for. That note is its commit:
readers take a file of the stream, or the larger file that stands for it, never both. Files that arrive meanwhile
are in no note and are read where they are.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow.session import configured
from shipflow.sources import layers
from shipflow.sources.files import Folder, plain_path

TARGET_BYTES = 256 * 1024 * 1024
COMPLETE = "_SUCCESS"
GROUPS_AT_ONCE = 100  # files that one job writes


class CompactedRaw:
    """A raw layer with its compacted copy; ``compact_path`` is outside ``raw_path``."""

    def __init__(self, spark: SparkSession, raw_path: str, compact_path: str):
        if f"{compact_path.rstrip('/')}/".startswith(f"{raw_path.rstrip('/')}/"):
            raise ValueError("the compacted files must not lie in the raw layer")
        self.spark, self.raw_path, self.folder = spark, raw_path, Folder(spark, compact_path)

    def _runs(self) -> list[int]:
        """Numbers of complete runs."""
        names = (name for name in self.folder.names("replaced") if self.folder.exists(f"replaced/{name}/{COMPLETE}"))
        return sorted(int(name.split("=")[1]) for name in names)

    def _data(self, run: int) -> str:
        return f"{self.folder.path}/data/run={run}"

    def files(self) -> dict[str, str]:
        """The files to read now, each with the folder that its partition names start from."""
        runs = self._runs()
        found = {}
        for base in (self.raw_path, *map(self._data, runs)):
            found |= {plain_path(file): base for file in layers.read_raw(self.spark, base).inputFiles()}
        if runs:
            notes = self.spark.read.schema("file string").parquet(*[f"{self.folder.path}/replaced/run={run}" for run in runs])
            for row in notes.toLocalIterator():
                found.pop(row.file, None)
        return found

    def _read(self, files: dict[str, str]) -> DataFrame:
        """Raw rows of some files."""
        by_base = defaultdict(list)
        for file, base in files.items():
            by_base[base].append(file)
        parts = [self.spark.read.schema(S.RAW).option("basePath", base).parquet(*some) for base, some in by_base.items()]
        return reduce(DataFrame.unionByName, parts)

    def read(self) -> DataFrame:
        """The raw layer as it is now, from as few files as there are."""
        files = self.files()
        whole = self._read(files) if files else layers.read_raw(self.spark, self.raw_path)
        return whole.select(*S.RAW_COLUMNS)

    def groups(self, files: dict[str, str], target_bytes: int) -> list[list[str]]:
        """Files to put together: of one date, small ones only, up to the target each, at least two."""
        by_date = defaultdict(list)
        for file in files:
            size = self.folder.size_of(file)
            if size <= target_bytes // 2:
                by_date[file.rsplit("/", 2)[1]].append((size, file))
        found = []
        for date in sorted(by_date):
            group, held = [], 0
            for size, file in sorted(by_date[date]):
                if group and held + size > target_bytes:
                    found.append(group)
                    group, held = [], 0
                group.append(file)
                held += size
            found.append(group)
        return [group for group in found if len(group) > 1]

    def compact(self, target_bytes: int = TARGET_BYTES) -> int:
        """Put small files of a date together; how many files went into others.

        One task writes one group as one file. Names and sizes of files pass the driver, rows do not. A run that is
        cut short leaves data that no note names: nobody reads them, and the next run writes over them. Only one run
        at a time may compact a layer.
        """
        files = self.files()
        groups = self.groups(files, target_bytes)
        if not groups:
            return 0
        run = max(self._runs(), default=-1) + 1
        replaced = [file for group in groups for file in group]
        n_before, n_written = self._read({file: files[file] for file in replaced}).count(), 0  # from the footers of the files
        for first in range(0, len(groups), GROUPS_AT_ONCE):
            some = groups[first : first + GROUPS_AT_ONCE]
            # a task per group reads its files in turn: no row is shuffled, and with a writer kept open none is sorted
            parts = [self._read({file: files[file] for file in group}).select(*S.RAW_COLUMNS).coalesce(1) for group in some]
            written = Observation("compacted")
            rows = reduce(DataFrame.unionByName, parts).observe(written, F.count("*").alias("n"))
            one_writer = configured(self.spark, "spark.sql.maxConcurrentOutputFileWriters", "2")
            task_each = configured(self.spark, "spark.sql.unionOutputPartitioning", "false")  # a union of single partitions is one otherwise
            with one_writer, task_each:
                layers.write_raw(rows, self._data(run), "append" if first else "overwrite")
            n_written += written.get["n"]
        if n_written != n_before:
            raise ValueError(f"{n_written} of {n_before} records were written; the files stay as they are")
        notes = self.spark.createDataFrame([(file,) for file in replaced], "file string")
        notes.write.mode("overwrite").parquet(f"{self.folder.path}/replaced/run={run}")
        return len(replaced)
