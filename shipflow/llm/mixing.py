"""Mixing of sources to target weights: hash-random order, prefix sums of sizes, a cut at each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.session import stored

BUCKET_ROWS = 32_768  # rows of a source ordered by one task, on average
KEY_SPACE = 1 << 32


def words_in(column) -> F.Column:
    return F.coalesce(F.regexp_count(column, F.lit(T.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, weights: Sequence[float], most_repeats: int) -> DataFrame:
    """One row per source with its target, by water filling.

    Sources in code point order, null last, take the weights in turn. A source takes level * weight, or what its cap
    allows. With sources in order of cap / weight, the level that fits the first k capped rises up to the right k
    and falls after it, so the level is the maximum over k.
    """
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("ratio", "turn").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    held = (
        sources.withColumn("turn", F.row_number().over(in_turn) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * most_repeats).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("weight_sum", F.sum("weight").over(everything))
        .withColumn("level", (F.col("budget") - F.col("capped")) / (F.col("weight_sum") - F.col("gone")))
        .withColumn("level", F.max("level").over(everything))
    )
    return held.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def plan(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[float] = (5, 2, 1),
    most_repeats: int = 2,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per distinct (source, doc_id, text): copies, size, source_size, target, budget, begin.

    The key is a hash of doc_id and text, so it is the same in each run. `begin` is the number of words of the source
    before these rows, in the order of the key. Rows that are equal are counted together, before the shuffle; so a
    key that fills a third of the table is one row here. Buckets are ranges of the key, as many as bucket_rows asks
    for: sums of buckets, their prefix sums, and the order within a bucket are each spread over the cluster.
    A null text has size 0, a null source is a source, a null doc_id is a document.
    """
    frame = T.needed(docs, "doc_id", "source", "text")
    digest = F.md5(F.coalesce("text", F.lit("")))
    rows = frame.select(
        "source",
        "doc_id",
        words_in("text").alias("size"),
        digest.alias("digest"),
        F.md5(F.concat_ws(":", F.lit("mix"), F.col("doc_id").cast("string"), digest)).alias("key"),
    )
    rows = stored(rows.groupBy("source", "doc_id", "size", "digest", "key").agg(F.count("*").alias("copies")), "mix")
    buckets = max(1, -(-rows.count() // bucket_rows))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(place * buckets / KEY_SPACE).cast("int"))
    volume = F.sum(F.col("size") * F.col("copies"))
    # sources are those someone gives weights to, so these two tables are small; null sources compare as equal
    sums = rows.groupBy("source", "bucket").agg(volume.alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("at_source"),
        F.col("bucket").alias("at_bucket"),
        F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_begin"),
    )
    aims = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, weights, most_repeats)
    aims = aims.withColumnRenamed("source", "of_source")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("bucket") == F.col("at_bucket")))
        .join(aims, F.col("source").eqNullSafe(F.col("of_source")))
        .select(
            "source",
            "doc_id",
            "digest",
            "copies",
            "size",
            "source_size",
            "target",
            F.floor("target").alias("budget"),
            (F.col("bucket_begin") + F.col("inside")).alias("begin"),
        )
    )


def _taken(begin, size) -> F.Column:
    """Words taken of a document: one share per whole epoch, and what the rest of the budget reaches."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - epochs * F.col("source_size")
    return (epochs * size + F.greatest(F.lit(0), F.least(size, rest - begin))).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    rows = plan(docs, **options).select("*", copy)
    begin = F.col("begin") + F.col("copy") * F.col("size")
    return rows.select("doc_id", "source", "size", "source_size", "target", _taken(begin, F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of docs: each document as often as taken, the last time perhaps cut.

    A cut text is its first words, one space between them. Documents without words are in no budget and are left out.
    """
    names = docs.columns
    planned = plan(docs, **options).select(
        F.col("source").alias("_source"),
        F.col("doc_id").alias("_doc_id"),
        F.col("digest").alias("_digest"),
        F.struct("copies", "size", "source_size", "budget", "begin").alias("_plan"),
    )
    whole = F.struct(*[docs[name] for name in names]).alias("_row")
    rows = docs.select(
        whole, F.col("source").alias("s"), F.col("doc_id").alias("d"), F.md5(F.coalesce("text", F.lit(""))).alias("t")
    )
    same = (
        F.col("s").eqNullSafe(F.col("_source")) & F.col("d").eqNullSafe(F.col("_doc_id")) & (F.col("t") == F.col("_digest"))
    )
    joined = rows.join(planned, same)
    # Rows that share source, doc_id and text differ at most in other columns; they are numbered, all others are 0.
    twins = Window.partitionBy("_source", "_doc_id", "_digest").orderBy("_row")
    alone = joined.filter("_plan.copies = 1").select("_row", "_plan", F.lit(0).alias("_copy"))
    several = joined.filter("_plan.copies > 1").select("_row", "_plan", (F.row_number().over(twins) - 1).alias("_copy"))
    taken = _taken(F.col("begin") + F.col("_copy") * F.col("size"), F.col("size"))
    rows = (
        alone.unionByName(several)
        .select("_row", "_copy", "_plan.*")
        .filter("size > 0")
        .select("_row", "size", taken.alias("taken"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")))))
        .withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
        .filter("words > 0")
    )
    all_words = F.regexp_extract_all(F.col("_row.text"), F.lit(T.WORD), F.lit(0))
    first_words = F.array_join(F.slice(all_words, F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("_row.text")).otherwise(first_words)
    return rows.select(*[(text if name == "text" else F.col(f"_row.`{name}`")).alias(name) for name in names])
