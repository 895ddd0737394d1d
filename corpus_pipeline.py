"""A training corpus from documents: quality rules, line dedup, near duplicates, source mix, packed sequences."""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipflow.llm import line_dedup, mixing, ngram_join, packing, quality
from shipflow.llm.ship import ship
from shipflow.session import discard, prepare, recorded, stored

# Tables that the last stage of this thread has stored; its result is written when the next stage begins.
_spent: ContextVar[tuple[str, ...]] = ContextVar("spent", default=())


def _stage(function):
    """A stage that begins by deleting what the one before it in the thread has stored, and notes what it stores itself."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(list(_spent.get()))
        with recorded() as paths:
            result = function(spark, docs, sf_dir)
        _spent.set(tuple(paths))
        return result

    return run_stage


def _counted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage may have cut."""
    kind = docs.schema["n_chars"].dataType
    return rows.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or are outliers of their language and source go."""
    return quality.good_documents(docs)


@_stage
def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs and of long lines go, and documents of which nothing is left."""
    return _counted(line_dedup.without_repeated_lines(docs, least_words=line_dedup.LEAST_WORDS), docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship(spark)
    return ngram_join.one_of_each(docs)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the one at a source's budget cut."""
    return _counted(mixing.mixed_documents(docs), docs)


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in packed sequences."""
    ship(spark)
    packed = packing.pack_documents(docs, packing.tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_runs", line_runs),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("sequences", sequences),
]

# Robust estimates, shingle components and token ids are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is stored and read by the next.

    What a stage has stored is deleted once its result is, and that result once the next one is. Runs do not share
    any of it, so several can go on at once. The tables of the last stage stay, as its result is not written here.
    """
    docs, before = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with recorded() as used:
            result = stage.__wrapped__(spark, docs, sf_dir)
        with recorded() as kept:
            docs = stored(result, name)
        discard(used)
        discard(before)
        before = kept
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
