"""Input guards and constraint reports."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipflow import schemas as S
from shipflow.operators import keyfilter
from shipflow.session import stored


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame itself, or ValueError naming the columns it lacks; no job runs."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(**tables: DataFrame) -> None:
    """ValueError naming the tables without rows."""
    empty = [name for name, df in tables.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"no rows in: {', '.join(empty)}")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def pk_violations(tables: Mapping[str, DataFrame], keys: Mapping[str, str] = S.PRIMARY_KEYS) -> DataFrame:
    """Per table: keys, keys held by several rows, rows too many. Null keys are left to the null report."""

    def report(name: str, df: DataFrame) -> DataFrame:
        key = keys[name]
        copies = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        return copies.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("key_count"),
            F.count_if(F.col("n") > 1).alias("duplicated_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
        )

    return _union([report(name, df) for name, df in tables.items()])


def not_null_violations(
    tables: Mapping[str, DataFrame],
    required: Mapping[str, Sequence[str]] = S.NOT_NULL,
    keys: Mapping[str, str] = S.PRIMARY_KEYS,
) -> DataFrame:
    """Null rows per required column; each table is read once."""

    def report(name: str, df: DataFrame) -> DataFrame:
        columns = [keys[name], *required[name]]
        counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return counted.unpivot([], columns, "column_name", "null_rows").select(
            F.lit(name).alias("table_name"), "column_name", "null_rows"
        )

    return _union([report(name, df) for name, df in tables.items()])


def fk_violations(
    tables: Mapping[str, DataFrame],
    foreign_keys: Sequence[tuple[str, str, str]] = S.FOREIGN_KEYS,
    keys: Mapping[str, str] = S.PRIMARY_KEYS,
    large_parents: bool = False,
) -> DataFrame:
    """Per foreign key: rows checked, rows and distinct values without a parent. Nulls pass, as in SQL.

    Each child is read once for all its keys and reduced to distinct values before the one join, so
    a value held by most rows does not skew it. With ``large_parents`` the distinct values are stored, and parents
    that cannot be among them are dropped by a Bloom filter before they are shuffled: for parents that are many
    times what their children name.
    """
    children = []
    for child in dict.fromkeys(child for child, _, _ in foreign_keys):
        parents = {column: parent for name, column, parent in foreign_keys if name == child}
        parent_of = F.create_map(*[F.lit(text) for pair in parents.items() for text in pair])
        references = tables[child].unpivot([], list(parents), "column_name", "value")
        children.append(
            references.filter(F.col("value").isNotNull())
            .groupBy("column_name", "value")
            .agg(F.count("*").alias("n"))
            .select(
                F.lit(child).alias("table_name"),
                "column_name",
                parent_of[F.col("column_name")].alias("parent_table"),
                "value",
                "n",
            )
        )
    known = _union(
        [
            tables[parent].select(F.lit(parent).alias("parent_table"), F.col(keys[parent]).alias("value"))
            for parent in dict.fromkeys(parent for _, _, parent in foreign_keys)
        ]
    )
    named, reference = _union(children), ["parent_table", "value"]
    if large_parents:
        named = stored(named, "references")
        blocks = keyfilter.blocks_for(named.count())
        known = keyfilter.possible(known, reference, keyfilter.key_filter(named, reference, blocks), blocks)
    checked = named.join(known.distinct().withColumn("found", F.lit(True)), reference, "left")
    lost = F.col("found").isNull()
    return checked.groupBy("table_name", "column_name", "parent_table").agg(
        F.sum("n").alias("checked_rows"),
        F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("violating_rows"),
        F.count_if(lost).alias("missing_values"),
    )
