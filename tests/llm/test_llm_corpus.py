"""Packing, mixing, archives, the pipeline and the registered queries."""

import base64
import hashlib
import math
import re
import threading
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import check
import corpus_pipeline
from shipflow.llm import mixing, packing, queries, warc
from shipflow.llm import text as T
from shipflow.llm.tokens import Tokens
from shipflow.session import shared_path

WORD = r"[^\x20\x09-\x0D]+"
SMALL = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="test tables are not here")


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


# ---- packing


def _pieces(texts):
    result = []
    for text, found in zip(texts, _tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)):
        ids = found.ids + [0]
        short = len(ids) % 2048
        cuts = ([0] if short else []) + list(range(short, len(ids) + 1, 2048))
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            result.append((text, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return result


def test_ids_are_the_tokenizers():
    texts = ["", "  a", "a  ", "  b", "x　 y", "a\x1c b", "a <|endoftext|> b c<|endoftext|>d  e", "\n\n a\r\n\tb", "é, à! ×, ÷. ë", None]
    texts += ["it's 12 34'll    z", "日本 語 テ", "don't. Stop, it's (a) 'test'...", "a.\n\nB c ,d", "ü.ß;x"]
    tokens = Tokens(packing.tokenizer_path())
    for _ in range(2):  # the second time from memory
        found = [ids[a:b].tolist() for _, at, ids in tokens.ids(pa.array(texts)) for a, b in zip(at, at[1:])]
        assert found == [f.ids for f in _tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packed_pieces(documents, corpus):
    packed = packing.pack_documents(documents, packing.tokenizer_path()).collect()
    texts = [row[1] for row in corpus]
    ids = {id(row): row[0] for row in corpus}
    by_text = defaultdict(list)
    for row in corpus:
        by_text[row[1]].append(ids[id(row)])
    want = Counter()
    for text, piece, start, length, crc in _pieces(list(by_text)):
        for doc_id in by_text[text]:
            want[(doc_id, piece, start, length, crc)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = defaultdict(list)
    for row in packed:
        bins[row.sequence_id].append((row.offset, row.length))
    for parts in bins.values():
        parts.sort()
        assert [offset for offset, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(bins) <= math.ceil(sum(r.length for r in packed) / 2048) + 2
    assert len(texts) == len(corpus)


def test_whole_sequences(documents):
    cut = packing.pieces(documents, packing.tokenizer_path(), with_ids=True)
    cut.write.mode("overwrite").parquet(path := shared_path(documents.sparkSession, "pieces"))
    stored = documents.sparkSession.read.parquet(path)
    for row in packing.sequences(packing.pack(stored)).collect():
        assert len(row.ids) == row.n_tokens == sum(row.lengths)


def test_one_table_of_pieces_packed_under_several_capacities(documents):
    cut = packing.pieces(documents, packing.tokenizer_path())
    cut.write.mode("overwrite").parquet(path := shared_path(documents.sparkSession, "pieces"))
    stored = documents.sparkSession.read.parquet(path)
    columns, n = stored.columns, stored.count()
    for most in (2, 3):
        packed = packing.pack(stored, packing.CAPACITIES | {"documents": most})
        sizes = [row["count"] for row in packed.groupBy("sequence_id").count().collect()]
        assert sum(sizes) == n and max(sizes) <= most
    assert stored.columns == columns == [field.name for field in stored.schema]


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    lengths = np.random.default_rng(1).integers(1, 900, 500)
    capacities = {"tokens": 1000, "documents": 3, "attention": 900_000}
    bins, offsets = packing.best_fit(lengths, capacities, {"tokens": 1.0, "documents": 0.5, "attention": 0.5}, score)
    for number in set(bins):
        own = np.flatnonzero(bins == number)
        assert lengths[own].sum() <= 1000 and len(own) <= 3 and (lengths[own] ** 2).sum() <= 900_000
        order = own[np.argsort(offsets[own])]
        assert (offsets[order] == np.concatenate(([0], np.cumsum(lengths[order])[:-1]))).all()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1001]), capacities, packing.WEIGHTS)


def test_best_fit_takes_the_fullest_bin():
    bins, _ = packing.best_fit(np.array([1500, 1200, 800, 500]), packing.CAPACITIES, packing.WEIGHTS)
    assert bins.tolist() == [0, 1, 1, 0]


def test_packing_of_nothing(no_documents):
    assert packing.pack_documents(no_documents, packing.tokenizer_path()).count() == 0


# ---- mixing


def _aims(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix(documents, corpus):
    result = mixing.mix(documents, bucket_rows=7).collect()
    size = lambda text: len(re.findall(WORD, text or ""))
    sizes = Counter()
    for row in corpus:
        sizes[row[3]] += size(row[1])
    aims = _aims(dict(sizes))
    assert Counter((r.doc_id, r.source, r.size) for r in result) == Counter((row[0], row[3], size(row[1])) for row in corpus)
    taken = Counter()
    for row in result:
        assert row.source_size == sizes[row.source]
        assert math.isclose(row.target, aims[row.source], rel_tol=1e-12)
        assert 0 <= row.taken <= 2 * row.size
        taken[row.source] += row.taken
    assert {s: math.floor(aims[s] + 1e-9) for s in sizes} == {s: taken[s] for s in sizes}
    again = mixing.mix(documents.repartition(5), bucket_rows=50).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, result))


def test_mixed_documents(documents, corpus, no_documents):
    mixed = mixing.mixed_documents(documents).collect()
    assert mixed[0].__fields__ == documents.columns
    words = Counter()
    for row in mixed:
        words[(row.doc_id, row.source)] += len(re.findall(WORD, row.text))
    taken = Counter()
    for row in mixing.mix(documents).collect():
        taken[(row.doc_id, row.source)] += row.taken
    assert words == +taken
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed_documents(no_documents).count() == 0


# ---- archives


def _pages(spark):
    html = ["<p>a</p>", "<p>a</p>", "<p>a</p>", "", None, "<b>é ü\r\n\r\nWARC/1.1\r\n</b>", "x" * 300_000, "x" * 300_000, "alone"]
    rows = [(9 - i, f"http://h/{i}\nx", text, "r") for i, text in enumerate(html)]
    rows += [rows[0], rows[0], (None, None, "no id", "r"), (4, "http://other", "<b>é ü\r\n\r\nWARC/1.1\r\n</b>", "r")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("least", [0, 9])
def test_archive_round_trip(spark, multiset, least):
    rows, pages = _pages(spark)
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        payload = (row[2] or "").encode()
        groups[payload if len(payload) >= least else i].append((row[0], payload))
    want = []
    for members in groups.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0))
        for k, (page_id, payload) in enumerate(members):
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            want.append((page_id, len(payload), digest, "revisit" if k else "response", members[0][0] if k else None))
    result = warc.round_trip(pages, least, chunk_bytes=1000).drop("url")
    assert result.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert multiset(result.collect()) == multiset(want)


def test_chunks_give_the_payload_back(spark):
    rows, pages = _pages(spark)
    files = warc.write(warc.records(pages), shared_path(spark, "warc"), file_bytes=200)
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    table = warc.chunks(files, chunk_bytes=4096).cache()
    assert table.agg(F.max("chunk_bytes")).first()[0] == 4096
    whole = {row.record_id: bytes(row.payload) for row in warc.payloads(table).collect()}
    for row in table.orderBy("record_id", "chunk_no").collect():
        head = whole[row.record_id][: row.total_bytes]
        assert row.running_digest == base64.b32encode(hashlib.sha1(head).digest()).decode()
        assert row.is_last == (row.total_bytes == len(whole[row.record_id]))
    texts = {(row[2] or "").encode() for row in rows}
    assert {whole[r.record_id] for r in table.filter("record_type = 'response' AND is_last").collect()} == texts
    table.unpersist()


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- pipeline and queries


def test_stages_keep_the_columns(spark, documents, no_documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_runs", "near_duplicates", "source_mix", "sequences"]
    for docs in (documents.select(*no_documents.columns), no_documents):
        for name, stage in corpus_pipeline.STAGES:
            path = shared_path(spark, name)
            stage(spark, docs, "").write.parquet(path)
            after = spark.read.parquet(path)
            if name != "sequences":
                assert after.schema.simpleString() == docs.schema.simpleString()
            docs = after


@has_tables
def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    run = corpus_pipeline.run(spark, SMALL)
    assert Counter(map(tuple, run.select(*same).collect())) == Counter(map(tuple, docs.select(*same).collect()))


@has_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_an_oracle(spark, name):
    result = check.spark_rows(entry_points.queries()[name](spark, SMALL))
    assert result[1]
    assert check.difference(result, check.oracle_rows(check.oracle_connection(SMALL), queries.ORACLES[name])) is None


def test_each_operator_has_a_query():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES}
    assert numbers == set(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_points.queries())


@has_tables
def test_pipelines_at_the_same_time(spark):
    """Each run deletes only what it has stored itself."""
    results = {}

    def work(name):
        results[name] = corpus_pipeline.run(spark, SMALL).count()

    threads = [threading.Thread(target=work, args=(i,)) for i in range(2)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert set(results) == {0, 1} and results[0] == results[1] > 0


def test_columns_that_differ_in_case(spark):
    frame = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, TEXT string, Doc_ID int")
    assert T.needed(frame, "doc_id", "text").collect() == [(1, "a b")]
    with pytest.raises(ValueError, match="missing columns: Text"):
        T.needed(frame, "Text")
