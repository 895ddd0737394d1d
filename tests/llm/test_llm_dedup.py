"""Line runs, word windows, near duplicates and embeddings against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from shipflow.llm import embeddings, line_dedup, ngram_join, substrings
from shipflow.llm.graph import components

WORD = r"[^\x20\x09-\x0D]+"


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Sets:
    """Union-find over positions."""

    def __init__(self, count):
        self.up = list(range(count))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


# ---- substrings


def _without_windows(texts, window):
    words = [re.findall(WORD, text or "") for text in texts]
    places = defaultdict(list)
    for d, own in enumerate(words):
        for i in range(len(own) - window + 1):
            places[tuple(own[i : i + window])].append((d, i))
    gone = {(d, i + k) for found in places.values() if len(found) > 1 for d, i in found for k in range(window)}
    left = [[word for i, word in enumerate(own) if (d, i) not in gone] for d, own in enumerate(words)]
    return [(len(own), len(own) - len(rest), sha256(" ".join(rest))) for own, rest in zip(words, left)]


@pytest.mark.parametrize("window", [35, 6])
def test_substrings(documents, corpus, multiset, window):
    expected = _without_windows([row[1] for row in corpus], window)
    result = substrings.substring_dedup(documents, window).collect()
    assert multiset(result) == multiset((row[0], *figures) for row, figures in zip(corpus, expected))


def test_hot_windows_take_the_other_way(documents, corpus, multiset, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_WINDOWS", 2)
    expected = _without_windows([row[1] for row in corpus], 35)
    result = substrings.substring_dedup(documents).collect()
    assert multiset(result) == multiset((row[0], *figures) for row, figures in zip(corpus, expected))


def test_substrings_of_nothing(no_documents):
    assert substrings.substring_dedup(no_documents).count() == 0


# ---- lines


def _without_runs(rows, least):
    """Rows in order of doc_id (null first): figures by deleting every window of lines that was there before."""
    seen = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    result = {}
    for d in order:
        cells = (rows[d][1] or "").split("\n")
        lines = [(i, cell) for i, cell in enumerate(cells) if re.search(WORD, cell)]
        gone = set()
        for n in range(len(lines) - least + 1):
            key = tuple(cell for _, cell in lines[n : n + least])
            if key in seen:
                gone.update(i for i, _ in lines[n : n + least])
            else:
                seen[key] = d
        left = "\n".join(cell for i, cell in enumerate(cells) if i not in gone)
        result[d] = (rows[d][0], len(lines), len(gone), sha256(left))
    return [result[d] for d in range(len(rows))]


@pytest.mark.parametrize("least", [2, 1, 3])
def test_line_runs(documents, corpus, multiset, least):
    result = line_dedup.line_dedup(documents, least_lines=least).collect()
    got = [(row.doc_id, row.n_lines, row.n_removed, row.kept_sha256) for row in result]
    assert multiset(got) == multiset(_without_runs(corpus, least))


def test_maximal_runs(spark):
    texts = ["a\nb\nc\nd\ne", "x\nb\nc\nd\ny", "b\nc\nz", "q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = line_dedup.numbered(docs)
    found = line_dedup.levels(line_dedup.line_table(rows))
    assert len(found) == 2  # lengths 1 and 2 repeat, 4 does not
    runs = line_dedup.runs(found).collect()
    assert sorted((r.order_id, r.line, r.lines, r.first.order_id, r.first.line) for r in runs) == [(1, 1, 3, 0, 1), (2, 0, 2, 0, 1)]
    assert [(r.doc_id, r.text) for r in line_dedup.without_repeated_lines(docs).orderBy("doc_id").collect()] == [
        (0, texts[0]),
        (1, "x\ny"),
        (2, "z"),
        (3, "q"),
    ]


def test_long_lines_are_runs(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(49))
    texts = [f"a\n{long}\nb\n{short}", f"c\n{long}\n{short}\nd", long, f"b\n{short}\n{long}\ne\n{long}", short, f" {long}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = line_dedup.without_repeated_lines(docs, least_words=line_dedup.LEAST_WORDS).orderBy("doc_id").collect()
    assert [tuple(row) for row in left] == [(0, texts[0]), (1, f"c\n{short}\nd"), (3, "e"), (4, short), (5, texts[5])]
    figures = line_dedup.line_dedup(docs, least_words=50).orderBy("doc_id").collect()
    assert [(row.n_removed, row.n_runs, row.longest_run) for row in figures] == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (4, 3, 2), (0, 0, 0), (0, 0, 0)]
    assert [row.n_removed for row in line_dedup.line_dedup(docs).orderBy("doc_id").collect()] == [0, 0, 0, 2, 0, 0]
    stage = dict(corpus_pipeline.STAGES)["line_runs"]
    kept = stage(spark, docs.selectExpr("doc_id", "text", "length(text) AS n_chars"), "").orderBy("doc_id").collect()
    assert [(row.doc_id, row.text) for row in kept] == [tuple(row) for row in left]
    assert all(row.n_chars == len(row.text) for row in kept)


def test_line_runs_of_nothing(spark, no_documents):
    assert line_dedup.line_dedup(no_documents).count() == 0
    unique = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    assert sorted(row.n_removed for row in line_dedup.line_dedup(unique).collect()) == [0, 0]


# ---- shingles


def _shingles(text):
    words = [word.translate({c: c + 32 for c in range(65, 91)}) for word in re.findall(WORD, text or "")]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def _near(rows):
    sets = [_shingles(row[1]) for row in rows]
    groups = Sets(len(rows))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            groups.join(a, b)
    lowest = {}
    for i, row in enumerate(rows):
        if sets[i] and row[0] is not None:
            root = groups.find(i)
            lowest[root] = min(lowest.get(root, row[0]), row[0])
    return [(row[0], len(s), lowest.get(groups.find(i)) if s else row[0]) for i, (row, s) in enumerate(zip(rows, sets))]


def test_ngram_join(documents, corpus, multiset):
    assert multiset(ngram_join.ngram_join(documents).collect()) == multiset(_near(corpus))


def _chain(count):
    """Texts that drift: each is near the next, far ones are not near each other; all share a passage."""
    passage = " ".join(f"p{i}" for i in range(60))
    words = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(count):
        words = words[:]
        for k in range(3):
            words[(i * 17 + k * 61) % 200] = f"e{i}_{k}"
        rows.append((i, passage + " " + " ".join(words)))
    return rows + [(1000 + i, passage + " " + " ".join(f"u{i}_{k}" for k in range(90 + i))) for i in range(40)]


@pytest.mark.parametrize("shared", [64, 3])
def test_chains_and_shared_passages(spark, multiset, monkeypatch, shared):
    monkeypatch.setattr(ngram_join, "SHARED_DOCUMENTS", shared)
    rows = _chain(25)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    result = ngram_join.ngram_join(docs).collect()
    assert multiset(result) == multiset(_near(rows))
    assert Counter(row.component_id for row in result).most_common(1)[0][1] > 5


@pytest.mark.parametrize("mu", [1.0, 0.01, 100.0])
def test_t_occurrence(monkeypatch, mu):
    monkeypatch.setattr(ngram_join, "MU", mu)
    chance = np.random.default_rng(2)
    common = chance.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((chance.choice(common, 300, replace=False), chance.integers(0, 2**63, k).astype(np.uint64)))) for k in range(0, 200, 7)]
    sets += [sets[0], sets[3][:250], np.array([5], np.uint64)]
    lists = ngram_join.Lists(sets)
    for query in sets:
        want = {}
        for i, record in enumerate(sets):
            both = len(np.intersect1d(query, record))
            if 100 * both >= 60 * (len(query) + len(record) - both):
                want[i] = both
        assert lists.search(query, 60) == want
    assert lists.search(np.array([7], np.uint64), 60) == {}


def test_dense_groups_are_searched_by_blocks(spark, multiset, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    chance = np.random.default_rng(6)
    rows = []
    for i in range(60):  # edits of one text, some near each other and some not
        words = [f"w{k}" for k in range(120)]
        for k in chance.choice(120, int(chance.integers(0, 6)), replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert multiset(ngram_join.ngram_join(docs).collect()) == multiset(_near(rows))


def test_one_of_each(documents, corpus, no_documents):
    rows = ngram_join.one_of_each(documents).collect()
    expected = {(doc_id, component) for doc_id, n, component in _near(corpus) if n and component is not None}
    kept = {row.doc_id for row in rows if _shingles(row.text)}
    assert {component for _, component in expected} <= kept
    assert len({row.text for row in rows if _shingles(row.text)}) == sum(1 for row in rows if _shingles(row.text))
    assert ngram_join.one_of_each(no_documents).count() == 0
    assert ngram_join.ngram_join(no_documents).count() == 0


def test_components(spark):
    chance = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in chance.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    groups = Sets(1100)
    for a, b in links:
        groups.join(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: groups.find(n) for pair in links if pair[0] != pair[1] for n in pair}


# ---- embeddings


def _vectors():
    chance = np.random.default_rng(4)
    centres = chance.normal(size=(12, 24))
    rows = [(centres[i % 12] + chance.normal(size=24) * (0.05 + 0.02 * (i % 9))).astype(np.float32).tolist() for i in range(300)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [-x for x in rows[2]]]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [1.0] * 23]
    odd += [[1.0, 2.0], [2.0, 4.0], [1.0, 2.0] + [0.0] * 22, [1e-30] * 24, [1.0] * 24]
    rows += odd
    return [(i, row) for i, row in enumerate(rows)] + [(None, rows[5]), (7, rows[7]), (None, None)]


def _unit(vector):
    if not vector or any(x is None or not np.isfinite(x) for x in vector) or not any(vector):
        return None
    scaled = np.array(vector, np.float32).astype(float)
    scaled = scaled / np.abs(scaled).max()
    return scaled / np.linalg.norm(scaled)


def _linked(rows, threshold):
    units = [_unit(vector) for _, vector in rows]
    groups, counts = Sets(len(rows)), [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        x, y = units[a], units[b]
        if x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
            counts[a], counts[b] = counts[a] + 1, counts[b] + 1
            groups.join(a, b)
    lowest = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            lowest[groups.find(i)] = min(lowest.get(groups.find(i), vec_id), vec_id)
    return [(vec_id, counts[i], lowest.get(groups.find(i)), vec_id == lowest.get(groups.find(i))) for i, (vec_id, _) in enumerate(rows)]


@pytest.mark.parametrize("tile_rows", [4096, 32])
def test_embeddings(spark, multiset, tile_rows):
    rows = _vectors()
    frame = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    assert multiset(embeddings.embedding_dedup(frame, tile_rows=tile_rows).collect()) == multiset(_linked(rows, 0.95))


def test_no_embeddings(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.embedding_dedup(spark.createDataFrame([], schema)).count() == 0
    only_bad = spark.createDataFrame([(1, None), (2, [0.0])], schema)
    assert sorted(map(tuple, embeddings.embedding_dedup(only_bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def _tile(rows, dims, heads, axes=None):
    row = {"tile": 0, "size": dims, "low": [0.0], "high": [0.0], "vectors": rows.astype(np.float64).tobytes()}
    numbers = np.arange(len(rows), dtype=np.int64).tobytes()
    return embeddings.Tile(row | {"nodes": numbers, "times": numbers}, dims, np.eye(dims) if axes is None else axes, heads)


@pytest.mark.parametrize("heads", [(16, 32), (8, 16, 32), (16,), ()])
def test_bounds_drop_no_pair(heads):
    chance = np.random.default_rng(7)
    rows = chance.normal(size=(200, 40)) * np.linspace(2, 0.1, 40)
    rows = np.concatenate((rows, rows[:80] + chance.normal(size=(80, 40)) * 0.05))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    tile, whole = _tile(rows, 40, heads), slice(0, 280)
    i, j = embeddings.block_links(tile, whole, tile, whole, heads, 0.95)
    want = set(zip(*np.nonzero(rows @ rows.T >= 0.95)))
    assert want <= set(zip(i, j)) and len(want) > 280


def test_links_at_the_threshold(spark, multiset):
    rows, chance = [], np.random.default_rng(2)
    for i in range(40):  # pairs whose cosine is a little above or below
        base, other = chance.normal(size=(2, 48))
        base /= np.linalg.norm(base)
        other -= (other @ base) * base
        other /= np.linalg.norm(other)
        cosine = 0.95 + (-1) ** i * 10.0 ** -(i % 11 + 2)
        rows += [(2 * i, base.tolist()), (2 * i + 1, (cosine * base + np.sqrt(1 - cosine**2) * other).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    found = {row.vec_id: row.n_links for row in embeddings.embedding_dedup(frame).collect()}
    clear = [i for i in range(0, 80, 2) if abs(units[i] @ units[i + 1] - 0.95) > 1e-14]
    assert len(clear) >= 36
    assert all(found[i] == found[i + 1] == int(units[i] @ units[i + 1] >= 0.95) for i in clear)


def test_a_cluster_with_half_of_all_vectors(spark, multiset):
    chance = np.random.default_rng(8)
    centre = chance.normal(size=24)
    rows = [(i, (centre + chance.normal(size=24) * 0.1 if i % 2 else chance.normal(size=24)).astype(np.float32).tolist()) for i in range(400)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, VEC_ID string").repartition(6)
    found = embeddings.embedding_dedup(frame, tile_rows=7).collect()  # dozens of groups of small tiles
    assert multiset(found) == multiset(_linked(rows, 0.95))
    assert sum(row.n_links for row in found) > 10_000


def test_order_keeps_close_vectors_together():
    turned = np.array([[-0.9, 0.5, 0, 0], [-0.9, 0.51, 0, 0], [0.9, -0.5, 0, 0], [1.0, -1.0, 1.0, -1.0]])
    codes = embeddings._code(turned)
    assert abs(codes[0] - codes[1]) < abs(codes[0] - codes[2]) and codes.min() >= 0 and codes.max() < 1 << 40
