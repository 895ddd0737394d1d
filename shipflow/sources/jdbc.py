"""JDBC tables: truncate-and-load sink and dimension scan.

The driver jar comes with the submit command. Loads are idempotent per run (the table is emptied
first) but not one transaction; readers may see a half-loaded table.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

@dataclass(frozen=True)
class Database:
    url: str
    user: str
    password: str
    driver: str = "org.postgresql.Driver"

    def options(self, table: str) -> dict[str, str]:
        return {
            "url": self.url,
            "dbtable": table,
            "user": self.user,
            "password": self.password,
            "driver": self.driver,
        }


def load_options(database: Database, table: str, connections: int = 16) -> dict[str, str]:
    """Truncate keeps the table's definition, so its defaults fill generated columns."""
    return database.options(table) | {
        "truncate": "true",
        "numPartitions": str(connections),
        "batchsize": "10000",
    }


def to_load(df: DataFrame, connections: int) -> DataFrame:
    """The rows dealt to as many tasks as there are connections.

    The JDBC writer would merge partitions without a shuffle, and the work before it would run in that few tasks.
    """
    return df.repartition(connections)


def truncate_and_load(df: DataFrame, database: Database, table: str, connections: int = 16) -> None:
    """Counts are sent as bigint; the database checks what its columns hold."""
    options = load_options(database, table, connections)
    to_load(df, connections).write.format("jdbc").options(**options).mode("overwrite").save()


def read_options(
    database: Database, table: str, column: str | None = None, low=None, high=None, partitions: int = 1
) -> dict[str, str]:
    """Options of a scan; with a numeric or date column and its bounds, of one in several partitions."""
    options = database.options(table)
    if column is None:
        return options
    return options | {
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
    }


def read_table(spark: SparkSession, database: Database, table: str, **ranges) -> DataFrame:
    """Filters on the result are pushed into the database. Ranges as in ``read_options``; rows outside the bounds
    are read too, by the first and the last partition."""
    return spark.read.format("jdbc").options(**read_options(database, table, **ranges)).load()


def read_parts(spark: SparkSession, database: Database, table: str, predicates: list[str]) -> DataFrame:
    """A scan with one partition per predicate, for keys that are text."""
    properties = {"user": database.user, "password": database.password, "driver": database.driver}
    return spark.read.jdbc(database.url, table, predicates=predicates, properties=properties)
