"""CSV scan and sink of the reference file. A path is a file or a folder of part files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from shipflow import schemas as S
from shipflow.functions.numbers import nan_to_null
from shipflow.operators.quality import require_columns


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, matched by the header and checked against the expected ones.

    The columns may stand in any order, but in the same one in every part file: without
    ``enforceSchema`` a file with another header fails instead of being misread.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    header = reader.csv(path).columns
    schema = StructType([StructField(name, StringType()) for name in header])
    return require_columns(reader.schema(schema).csv(path), list(S.REFERENCE_COLUMNS))


def write_clean(clean: DataFrame, path: str) -> None:
    stamped = clean.withColumn(
        "dataset_timestamp", F.date_format("dataset_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    stamped.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned file; NaN cells count as missing."""
    clean = (
        spark.read.option("header", True)
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .schema(S.REFERENCE_CLEAN)
        .csv(path)
    )
    numeric = [f.name for f in S.REFERENCE_CLEAN if f.dataType == DoubleType()]
    return clean.withColumns({name: nan_to_null(F.col(name)) for name in numeric})
