"""Registered queries of the operators, (spark, sf_dir) -> DataFrame over whole tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipflow.llm import (
    embeddings,
    exact_dedup,
    importance,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    periodic,
    pii,
    quality,
    secrets,
    substrings,
    warc,
)
from shipflow.llm.oracles import ORACLES as ORACLES
from shipflow.llm.ship import ship
from shipflow.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(prepare(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op2_packing(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), packing.tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


@query
def op5_substrings(spark, sf_dir):
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


@query
def op6_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@query
def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query
def op8_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


@query
def op9_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query
def op10_embedding_dedup(spark, sf_dir):
    return embeddings.embedding_dedup(table(spark, sf_dir, "embeddings"))


@query
def op11_periodic_runs(spark, sf_dir):
    return periodic.figures(periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents"))))


@query
def op12_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query
def op13_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
