"""Session settings the operators rely on, and where to store intermediate tables."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
BYTES_PER_TASK = 256 * 1024 * 1024
ROWS_PER_FILE = 250_000


def prepare(spark: SparkSession) -> SparkSession:
    """Event times carry no zone: read them as UTC whatever the machine's zone is."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def configured(spark: SparkSession, setting: str, value: str) -> Iterator[None]:
    """Within the block, a setting of the session."""
    before = spark.conf.get(setting)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def bytes_setting(spark: SparkSession, setting: str) -> int:
    """A size of the session's settings, such as 64MB, in bytes."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int) -> Iterator[int]:
    """Within the block, enough shuffle partitions for an input of that size; never fewer than the session has.

    Adaptive execution merges partitions that turn out small, so the number errs on the high side.
    """
    setting = "spark.sql.shuffle.partitions"
    partitions = max(int(spark.conf.get(setting)), -(-input_bytes // BYTES_PER_TASK))
    with configured(spark, setting, str(partitions)):
        yield partitions


_own_folder = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    A local session without that setting gets a folder of its own, which goes when the process ends.
    """
    global _own_folder
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="shipflow-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


def shared_path(spark: SparkSession, name: str, recorded: bool = False) -> str:
    """A new path below the shared folder; ``recorded`` if it is deleted as stored tables are."""
    path = f"{shared_folder(spark)}/shipflow/{name}-{uuid.uuid4().hex}"
    if recorded:
        for paths in _recorders.get():
            paths.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of tables that are stored within the block, by the thread that runs it; blocks can be nested."""
    paths: list[str] = []
    outer = _recorders.set((*_recorders.get(), paths))
    try:
        yield paths
    finally:
        _recorders.reset(outer)


def discard(paths: list[str]) -> None:
    """Delete stored tables that no frame needs any more; ones that are gone already are no error."""
    while paths:
        path = paths.pop()
        files, place = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))
        with suppress(FileNotFoundError):
            files.delete_dir(place)


@contextmanager
def own_tables() -> Iterator[None]:
    """For work that is done when the block ends: the tables stored within it are deleted then, also if it fails."""
    with recorded() as paths:
        try:
            yield
        finally:
            discard(paths)


def stored(df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back; ``options`` are the writer's.

    ``rows``, a bound on its rows where one is known, deals it to files of that many rows each, instead of a file
    per task: for tables that are small next to what they are made from.

    Cuts the lineage for inputs that are read several times; unlike cached blocks, the files outlive
    a lost executor and keep column pruning.
    """
    path = shared_path(df.sparkSession, name, recorded=True)
    if rows is not None:
        df = df.repartition(max(1, -(-rows // ROWS_PER_FILE)))
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
