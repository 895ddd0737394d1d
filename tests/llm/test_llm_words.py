"""Periodic runs, exact duplicates and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from shipflow.llm import exact_dedup, importance, periodic
from shipflow.llm import text as T

WORD = r"[^\x20\x09-\x0D]+"
ODD_COLUMNS = "doc_id long, text string, TEXT string, Doc_Id int, tags map<string,int>"


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- periodic runs


def _runs(words, least_length=6, least_exponent=4):
    """All runs, period by period; one whose stretch has a smaller period is not of this period."""
    found = []
    for period in range(1, len(words) // least_exponent + 1):
        start = 0
        while start + period < len(words):
            end = start
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end - start + period
            smaller = (all(words[i] == words[i + q] for i in range(start, start + length - q)) for q in range(1, period))
            if end > start and length >= max(least_length, least_exponent * period) and not any(smaller):
                found.append((start, length, period))
            start = max(end, start + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


def _planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]


def _figures(doc_id, text):
    words = _planted(doc_id, re.findall(WORD, text or ""))
    runs = _runs(words)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = max(runs, key=lambda run: (Fraction(run[1], run[2]), -run[0], -run[2]), default=None)
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    left = " ".join(word for i, word in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or [None] * 3), best and 1000 * best[1] // best[2], sha256(listed), sha256(left))


def test_runs_of_short_sequences():
    chance = random.Random(1)
    for _ in range(1500):
        count, kinds = chance.randrange(0, 60), chance.choice([1, 2, 2, 3, 5])
        words = [chance.randrange(kinds) for _ in range(count)]
        if count > 5 and chance.random() < 0.5:
            first, period = chance.randrange(count), 1 + chance.randrange(6)
            words = [word if i < first else words[min(count - 1, first + (i - first) % period)] for i, word in enumerate(words)]
        for limits in ((6, 4), (1, 2), (9, 3)):
            assert periodic.find_runs(np.array(words, np.int64), *limits) == _runs(words, *limits)


def test_long_sequences_take_their_time():
    for symbol in (lambda i: 0, lambda i: i % 7):
        runs = periodic.find_runs(np.array([symbol(i) for i in range(200_000)], np.int64))
        assert [(start, length) for start, length, _ in runs] == [(0, 200_000)]


def test_periodic_runs(spark, documents, corpus, multiset):
    short = [row for row in corpus if len(row[1] or "") < 20_000]
    docs = spark.createDataFrame([row[:2] for row in short], "doc_id long, text string")
    result = periodic.figures(periodic.periodic_runs(periodic.planted(docs))).collect()
    assert multiset(result) == multiset(_figures(*row[:2]) for row in short)
    assert sum(row.n_runs > 0 for row in result) > 3
    assert periodic.periodic_runs(documents).count() == len(corpus)


def test_collapsed_texts_and_odd_columns(spark):
    text = "a  b a\nb a b a b x y"
    rows = [(1, text, "other", 7, {"k": 1}), (2, None, "x", 1, None), (3, "", "x", 1, {})]
    found = {row.doc_id: row for row in periodic.periodic_runs(spark.createDataFrame(rows, ODD_COLUMNS)).collect()}
    assert found[1].collapsed == "a b x y" and [tuple(run) for run in found[1].runs] == [(0, 8, 2)]
    assert [(found[i].n_words, found[i].runs, found[i].collapsed) for i in (2, 3)] == [(0, [], "")] * 2
    assert periodic.figures(periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_words_are_read_by_stretches(monkeypatch):
    monkeypatch.setattr(T, "SLICE_BYTES", 5)
    text = b"  one two\tthree \n four five one two  "
    assert periodic.symbols_of(text).tolist() == [0, 1, 2, 3, 4, 0, 1]
    assert periodic.collapsed(text, 7, [(1, 4, 2)]) == b"one two three one two"
    assert periodic.collapsed(b"", 0, []) == b""


# ---- exact duplicates


def _owners(rows):
    groups = defaultdict(list)
    for place, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id or 0, place))
    expected = []
    for text, members in groups.items():
        least = min(members)
        for member in members:
            ids = [None if m[0] else m[1] for m in (member, least)]
            expected.append((*ids, len(members), member == least, sha256(text)))
    return expected


SPACED = ["a b", " a b", "a b ", "a\n\tb", "a  b", " ", "\n", "", None, "ab", "a", "aa", "aaa", " a b", "a b"]


def test_exact_dedup(spark, documents, corpus, multiset):
    assert multiset(exact_dedup.exact_dedup(documents).collect()) == multiset(_owners([row[:2] for row in corpus]))
    rows = list(enumerate(SPACED)) + [(5, "a b"), (None, "a b"), (None, "null id"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert multiset(exact_dedup.exact_dedup(docs).collect()) == multiset(_owners(rows))


@pytest.mark.parametrize("trie_bytes", [1, 3_000, 20_000])
def test_spilled_subtrees_meet_in_later_rounds(spark, documents, corpus, multiset, trie_bytes):
    result = exact_dedup.exact_dedup(documents.repartition(3), trie_bytes, 20_000).collect()
    assert multiset(result) == multiset(_owners([row[:2] for row in corpus]))


def test_a_group_with_most_rows(spark, multiset):
    rows = [(i, "the same\ttext" if i % 4 else f"text {i}") for i in range(2_000)]
    docs = spark.createDataFrame([(*row, "x", 1, {"k": 1}) for row in rows], ODD_COLUMNS).repartition(5)
    assert multiset(exact_dedup.exact_dedup(docs).collect()) == multiset(_owners(rows))
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tries_hold_and_spill_whole_texts():
    chance = random.Random(3)
    for bound in (0, 20_000):
        keys = [bytes(chance.choice(b"ab") for _ in range(chance.randrange(12))) * chance.choice([1, 1, 9]) for _ in range(300)]
        trie, found = exact_dedup.Trie(), defaultdict(list)
        for place, key in enumerate(keys):
            node = trie.node(key)
            node.value = (node.value or []) + [place]
            if bound and trie.held > bound:
                for gone, places in trie.spill(bound // 2):
                    found[gone] += places
                assert trie.held <= bound // 2
        left = set(found)
        for key, places, spilled in trie.texts():
            assert spilled or key not in left
            found[key] += places
        expected = defaultdict(list)
        for place, key in enumerate(keys):
            expected[key].append(place)
        assert {key: sorted(places) for key, places in found.items()} == expected


# ---- importance resampling


def _resampled(rows, target, most, buckets, percent, least):
    def grams(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    def code(gram):
        return zlib.crc32(gram.encode()) % buckets

    s = Counter(code(gram) for _, text in rows for gram in grams(text)[1])
    t = Counter(code(gram) for text in target for gram in grams(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    scored = []
    for place, (doc_id, text) in enumerate(rows):
        words, found = grams(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in map(code, found)]
        weight = sum(gain) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append([doc_id, len(found), weight, score, None, len(words) >= least])
    eligible = sorted((row for row in scored if row[5]), key=lambda row: (-row[3], row[0] is None, row[0] or 0))
    for rank, row in enumerate(eligible[: percent * len(eligible) // 100], 1):
        row[4] = rank
    return [tuple(row[:5]) for row in scored]


@pytest.mark.parametrize("most, buckets, percent", [(1, 10_000, 10), (3, 50, 60)])
def test_resampling(documents, corpus, spark, multiset, most, buckets, percent):
    target = [corpus[3][1], corpus[41][1], None, "", "Ünder_score x2 É é"]
    aims = spark.createDataFrame([(i, text, "x") for i, text in enumerate(target)], "item_id long, text string, TEXT string")
    result = importance.resample(documents, aims, max_words=most, buckets=buckets, percent=percent).collect()
    assert multiset(result) == multiset(_resampled([row[:2] for row in corpus], target, most, buckets, percent, 20))


def test_resampling_of_nothing(spark, documents, no_documents, corpus, multiset):
    nothing = no_documents.select("text")
    result = importance.resample(documents, nothing).collect()
    assert multiset(result) == multiset(_resampled([row[:2] for row in corpus], [], 1, 10_000, 10, 20))
    assert importance.resample(no_documents, documents).collect() == []


def test_equal_scores_go_to_the_smaller_id(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(7, text)] * 30 + [(i, text) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    result = importance.resample(docs, docs, percent=100).collect()
    assert sorted(row.rank for row in result) == list(range(1, 51))
    ordered = sorted(result, key=lambda row: row.rank)
    assert [(-row.score, row.doc_id) for row in ordered] == sorted((-row.score, row.doc_id) for row in result)


def test_spans_of_word_runs():
    line = importance.collapsed(b"One, two--THREE  four!")
    assert line == b"one two three four "
    grams = [line[begin:end] for begin, end in importance.spans(line, importance.run_pattern(3))]
    assert grams == [b"one two three", b"two three four"]


def test_settings_are_as_before(spark, documents):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(name) for name in names]
    with pytest.raises(ValueError, match="missing"), T.text_batches(spark):
        assert spark.conf.get(names[0]) == str(T.BATCH_ROWS)
        T.columns_of(documents, "absent")
    assert [spark.conf.get(name) for name in names] == before
