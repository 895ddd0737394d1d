"""A table of mergeable rows that grows by generations: appended in turn, merged when read, folded now and then.

A generation is written as a whole and counts once its writer has marked it complete, so one that was cut short is
not seen and is simply written again. Its number comes from the caller (a micro-batch, a day's run): writing the same
number twice replaces the first attempt and adds nothing. Files of complete generations are never changed.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shipflow.sources.files import Folder
from shipflow.sources.layers import COMPRESSION

GENERATION = "generation"
BASE = "base"
COMPLETE = "_SUCCESS"


class StateLog:
    """``schema`` is that of the rows; the number of its generation is added to each row when it is read."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.schema, self.folder = spark, schema, Folder(spark, path)

    def _numbers(self, kind: str) -> list[int]:
        names = (name for name in self.folder.names() if name.startswith(f"{kind}="))
        return sorted(int(name.split("=")[1]) for name in names if self.folder.exists(f"{name}/{COMPLETE}"))

    def generations(self, before: int | None = None) -> tuple[int | None, list[int]]:
        """The last fold and the generations since, both below ``before``."""
        base = max((n for n in self._numbers(BASE) if before is None or n < before), default=None)
        later = [n for n in self._numbers(GENERATION) if (base is None or n > base) and (before is None or n < before)]
        return base, later

    def append(self, rows: DataFrame, number: int) -> None:
        """Write a generation, or write it again; only the last one can be replaced."""
        base, later = self.generations()
        last = max([*later, -1 if base is None else base])
        if number < last:
            raise ValueError(f"generation {number} comes before {last}, which is there already")
        columns = [F.col(field.name).cast(field.dataType).alias(field.name) for field in self.schema]
        rows.select(*columns).write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{self.folder.path}/{GENERATION}={number}")

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder.path}/{name}" for name in names])

    def read(self, before: int | None = None) -> DataFrame:
        """All rows below ``before``, unmerged; folded rows carry the number of their fold."""
        base, later = self.generations(before)
        parts = []
        if base is not None:
            parts.append(self._read([f"{BASE}={base}"]).withColumn(GENERATION, F.lit(base).cast("long")))
        if later:
            schema = StructType([*self.schema.fields, StructField(GENERATION, LongType())])
            paths = [f"{self.folder.path}/{GENERATION}={n}" for n in later]
            parts.append(self.spark.read.schema(schema).option("basePath", self.folder.path).parquet(*paths))
        if not parts:
            return self.spark.range(0).select(
                *[F.lit(None).cast(field.dataType).alias(field.name) for field in self.schema], F.col("id").alias(GENERATION)
            )
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def one(self, number: int) -> DataFrame:
        """The rows of one generation as they were appended."""
        return self._read([f"{GENERATION}={number}"])

    def fold(self, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Merge all there is into one base, which readers then take instead; old files stay for those still reading.

        ``merge`` takes rows of any generations and returns rows of the same schema that stand for them.
        """
        base, later = self.generations()
        if later:
            merge(self.read()).select(*self.schema.fieldNames()).write.mode("overwrite").option("compression", COMPRESSION).parquet(
                f"{self.folder.path}/{BASE}={later[-1]}"
            )

    def drop_folded(self) -> None:
        """Delete what the last fold stands for, except the generation that may still be written again."""
        base, _ = self.generations()
        for kind in (BASE, GENERATION):
            for number in self._numbers(kind):
                if base is not None and number < base:
                    self.folder.delete(f"{kind}={number}")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Per key the row of the last generation: the view of a log whose rows replace earlier ones."""
    values = [name for name in rows.columns if name not in (key, GENERATION)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), GENERATION).alias("_last"))
    return last.select(key, *[F.col("_last")[name].alias(name) for name in values])
