"""Personal data, quality rules and secrets against plain versions."""

import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from shipflow.llm import pii, quality, secrets

WORD = r"[^\x20\x09-\x0D]+"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PERSONAL = [
    "mail a.b@c.de.fr, x@y z@q.com.-.x@y.org and ..@a.b-c.d. tail",
    "a@b.c.+d@e.f a@b@c.d a_b@c.d_x@y.zz",
    "at 1.2.3.4 and 256.1.1.1 and 001.002.003.0004 1.2.3.4.5.6.7.8 0000000000000000000001.1.1.1",
    "card 4199338693996156 and 4199 3386 9399 6156, 4199-3386-9399-6157 1 2",
    "+1 (386) 555-3733 or +49 30 1234 or +1234567890123456 +12345678901",
    "日本 é +49 (30) 123-4567 ü 4199338693996156 x@y.zz",
    "9" * 3000 + " " + "x" * 3000 + "@",
    None,
    "",
]


def _luhn(digits):
    total = 0
    for i, digit in enumerate(reversed(digits)):
        number = int(digit) * (2 if i % 2 else 1)
        total += number - 9 if number > 9 else number
    return total % 10 == 0


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def _base(text):
    found = []
    for order, (kind, form) in enumerate(FORMS.items()):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(form, text or "") if _valid(kind, m.group())]
    return sorted(found)


def _expected_base(doc_id, text):
    found = _base(text)
    spans = ",".join(f"{kind}:{begin}:{end}" for begin, _, end, kind in found)
    counts = [sum(item[3] == kind for item in found) for kind in FORMS]
    return (doc_id, *counts, hashlib.sha256(spans.encode()).hexdigest())


def test_base_spans(spark, documents, corpus, multiset):
    rows = [(i, text) for i, text in enumerate(PERSONAL)] + [(row[0], row[1]) for row in corpus]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    result = pii.personal_data(docs).collect()
    assert multiset(row[:6] for row in result) == multiset(_expected_base(*row) for row in rows)
    assert pii.personal_data(documents).count() == len(corpus)


def test_addresses_with_zero_parts(spark, multiset):
    texts = ["10.0.0.1 192.168.0.1 127.0.0.1", "255.255.255.0 and 0.0.0.0 or 1.00.2.3", "10.0.0.256 0300.1.1.1 000.0255.00.1", "0" * 3000 + ".0.0.300"]
    rows = list(enumerate(texts))
    result = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert multiset(row[:6] for row in result) == multiset(_expected_base(*row) for row in rows)
    assert sorted((row.doc_id, row.n_ip) for row in result) == [(0, 3), (1, 3), (2, 1), (3, 0)]


def test_contexts_find_more(spark):
    rows = [(i, f"please write to mailbox: user{i}@host{i}.org or visit room {i}") for i in range(8)]
    rows += [(100, "please write to mailbox: carol@localhost or go"), (101, "room 4711 is at carol@elsewhere now")]
    result = {row.doc_id: row for row in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    begin = rows[8][1].index("carol")
    assert result[100].spans == f"email:{begin}:{begin + len('carol@localhost')}"
    assert (result[100].n_found, result[100].n_email) == (1, 0)
    assert result[101].spans == ""  # the context there is no pattern
    assert result[3].n_found == 0


def test_held_out_recall(spark, no_documents):
    """Addresses after a telling word come back when withheld; numbers after words that tell nothing do not."""
    texts = [f"please write to mailbox: user{i}@host{i}.org today" for i in range(60)]
    texts += [f"w{chr(97 + i % 26)}{chr(97 + i // 26)} +1386555{i:04d} rest" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None), (901, "")], "doc_id long, text string")
    result = {row.kind: row for row in pii.held_out_recall(docs, 4).collect()}
    assert set(result) == {"email", "phone"}
    assert result["email"].withheld > 5 and result["email"].reached == result["email"].withheld
    assert result["phone"].withheld > 5 and result["phone"].reached == result["phone"].wrong == 0
    assert pii.held_out_recall(no_documents).count() == 0


def test_contexts_find_runs_of_words(spark):
    texts = [f"please call +1 (386) 555-37{i:02d} now or write to mailbox: user{i}@host{i}.org today" for i in range(30)]
    hidden = ["555 123 4567", "(555) 123-4567", "030 12345678", "(0)30 1234 5678", "5551234567"]
    hidden += ["john at host dot org", "john-at-host-dot-org", "jane (at) host [dot] org", "a dot b at c dot d DOT e", "x_y_at_z_dot_com"]
    kinds = ["phone"] * 5 + ["email"] * 5
    odd = [f"please {'call' if kind == 'phone' else 'write to mailbox:'} {value} now" for value, kind in zip(hidden, kinds)]
    odd += ["in 555 123 4568 rows", "look at that dot there", "(555) 12th at 555 1st"]
    rows = list(enumerate(texts + odd))
    result = {row.doc_id: row for row in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, text), value, kind in zip(rows[30:], hidden, kinds):
        begin = text.index(value)
        assert (value, result[i].spans) == (value, f"{kind}:{begin}:{begin + len(value)}")
    assert [result[i].n_found for i in range(40, 43)] == [0, 0, 0]
    assert [(result[i].n_phone, result[i].n_email, result[i].n_found) for i in range(30)] == [(1, 1, 0)] * 30


def test_discovery_goes_on_until_it_rests(spark):
    """Each context shows some of the values of the next one; the last are five rounds away from the addresses."""
    sizes, layers = [60, 36, 20, 11, 6, 3], []
    for layer, size in enumerate(sizes):
        layers.append([f"v{layer}x{i}@local" if layer else f"user{i}@host{i}.org" for i in range(size)])
    names = ["alpha", "beta", "gamma", "delta", "epsilon"]
    texts = [f"see {names[k]}: {value} today" for k in range(5) for value in layers[k] + layers[k + 1]]
    texts += [f"room v9x{i}@local elsewhere" for i in range(3)]
    rows = list(enumerate(texts))
    result = {row.doc_id: row.n_found for row in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [result[i] for i, text in rows] == [int("v" in text and "v9" not in text) for _, text in rows]


def test_contexts_and_addresses_have_no_length(spark):
    long = "w" * 300
    texts = [f"call {long}mail user{i}@host{i}.org today" for i in range(8)] + [f"{long}call user{i}x at room{i}" for i in range(8)]
    spelled = " dot ".join(f"p{i}" for i in range(12)) + " at host dot org"
    hidden = [f"call {long}mail carol@local today", f"call {long}mail {spelled} today", f"call x{long}mail dora@local then"]
    hidden += ["a1 dot " * 20_000 + "b", "z@ " + "q" * 30_000 + " " * 30_000 + "1"]
    rows = list(enumerate(texts + hidden))
    result = {row.doc_id: row for row in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, value in ((16, "carol@local"), (17, spelled)):
        begin = rows[i][1].index(value)
        assert result[i].spans == f"email:{begin}:{begin + len(value)}"
    assert [result[i].n_found for i in (18, 19, 20)] == [0, 0, 0]


def test_personal_data_of_nothing(no_documents):
    assert pii.personal_data(no_documents).count() == 0


def _counts(text):
    words = re.findall(WORD, text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for starts in windows.values() if len(starts) > 1 for i in starts for k in range(8)}
    lines = [line for line in (text or "").split("\n") if re.search(WORD, line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(documents, corpus, multiset):
    result = quality.quality(documents).collect()
    expected = [(row[0], row[2], row[3], *_counts(row[1])) for row in corpus]
    assert multiset(row[:8] for row in result) == multiset(expected)
    for row in result:
        failed = row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words
        assert row.base_failed == failed
        assert row.kept is False if failed else row.kept == (row.distance <= quality.CUTOFF)


NOISE = np.diag([value**2 for _, value in quality.COORDINATES.values()])
COUNT = len(quality.NAMES)


def _moments(vectors):
    """Centre, covariance with noise, and its log determinant, of whole-numbered rows of a language's only group."""
    centre = vectors.mean(axis=0) / quality.UNIT
    covariance = ((vectors.T @ vectors) / len(vectors) / quality.UNIT**2 - np.outer(centre, centre)) * quality.CONSISTENCY + NOISE
    return centre, covariance, np.linalg.slogdet(covariance)[1]


def _distances(vectors, centre, covariance):
    apart = vectors / quality.UNIT - centre
    return np.einsum("ij,jk,ik->i", apart, np.linalg.inv(covariance), apart)


def _nearest(vectors, centre, covariance):
    bucket = np.floor(np.log1p(_distances(vectors, centre, covariance)) * quality.BUCKETS_PER_E)
    below = np.searchsorted(np.sort(bucket), bucket)
    return vectors[below < quality.KEPT_SHARE * len(vectors)]


def _rested(vectors, centre, covariance):
    """C-steps until the determinant rests."""
    found = _moments(_nearest(vectors, centre, covariance))
    while True:
        after = _moments(_nearest(vectors, *found[:2]))
        if not after[2] < found[2] - quality.LEAST_FALL:
            return found
        found = after


def _medians(vectors):
    cells = np.floor(vectors / 50)
    lower = lambda a: np.sort(a, axis=0)[(len(a) + 1) // 2 - 1]
    middle = lower(cells)
    return (middle + 0.5) * 50 / quality.UNIT, np.diag((1.4826 * lower(np.abs(cells - middle)) * 50 / quality.UNIT) ** 2) + NOISE


def _plain_starts(vectors):
    centre, spread = _medians(vectors)
    scale = np.sqrt(np.diag(spread))
    towards = (vectors / quality.UNIT - centre) / scale
    size = np.linalg.norm(towards, axis=1, keepdims=True)
    unit = np.round(quality.UNIT * towards / np.where(size > 0, size, 1))
    directions = np.outer(scale, scale) * COUNT * (unit.T @ unit) / len(unit) / quality.UNIT**2 + NOISE
    return [(centre, spread), _moments(vectors)[:2], (centre, directions)]


def test_outliers_as_numpy_finds_them(spark):
    chance = np.random.default_rng(3)
    n = chance.lognormal(5, 0.6, 300).astype(int) + 30
    chars = (n * chance.normal(5, 0.3, 300)).astype(int)
    symbols = np.where(np.arange(300) % 20 == 0, n, 0)
    rows = [(i, "en", "s", int(n[i]), int(chars[i]), int(symbols[i]), i % 3, 0) for i in range(300)]
    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    result = quality.judge(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    columns = [np.log1p(n), np.log(chars / n), np.log1p(100 * symbols / chars), np.log1p(np.arange(300) % 3), np.zeros(300)]
    # as Spark rounds: half away from zero
    vectors = np.floor(np.stack(columns, axis=1) * quality.UNIT + 0.5)
    best = min((_rested(vectors, *start) for start in _plain_starts(vectors)), key=lambda found: round(found[2], 9))
    assert np.allclose([row.distance for row in result], _distances(vectors, *best[:2]), rtol=1e-6)
    assert [row.kept for row in result] == [bool(s == 0) for s in symbols]


def _contaminated(seed):
    """A narrow, tilted majority, and a cloud beside it that single coordinates do not tell apart."""
    chance = np.random.default_rng(seed)
    mixing = np.eye(COUNT) + 2.2 * np.outer(np.ones(COUNT), [1, 0, 0, 0, 0])
    good = chance.normal(size=(225, COUNT)) @ mixing.T
    bad = chance.normal(size=(75, COUNT)) * 0.3 + np.array([2.5, -2.5, 2.5, -2.5, 0])
    return np.round(np.concatenate([good, bad]) * quality.UNIT)


def test_the_least_determinant_stays(spark):
    """Of several starts, each at rest, the best stays; one start of a fixed number of steps does worse somewhere."""
    tables = {f"s{seed}": _contaminated(seed) for seed in range(6)}
    names = ", ".join(f"{name} long" for name in quality.NAMES)
    rows = [(f"l{source}", source, *map(int, row)) for source, table in tables.items() for row in table]
    result = quality.estimates(spark.createDataFrame(rows, f"lang string, source string, {names}"))
    found = {row.source: row.log_determinant for row in result.collect()}
    assert sorted(found) == sorted(tables)
    chance, fixed_is_worse = np.random.default_rng(1), 0
    for source, table in tables.items():
        rested = [_rested(table, *start)[2] for start in _plain_starts(table)]
        assert abs(found[source] - min(rested)) < 1e-6
        drawn = [_moments(table[chance.choice(len(table), 8, replace=False)])[:2] for _ in range(200)]
        assert found[source] < min(_rested(table, *start)[2] for start in drawn) + 0.05
        fixed = _medians(table)
        for _ in range(4):
            fixed = _moments(_nearest(table, *fixed[:2]))
        assert found[source] <= fixed[2] + quality.LEAST_FALL
        fixed_is_worse += found[source] < fixed[2] - 0.05
    assert fixed_is_worse


def test_good_documents_are_unchanged(documents, corpus, no_documents):
    kept = quality.good_documents(documents)
    assert kept.columns == documents.columns
    assert 0 < kept.count() < len(corpus)
    assert quality.good_documents(no_documents).count() == 0
    assert quality.quality(no_documents).count() == 0


def _with_secrets(spark, first, count):
    rows = []
    for i in range(first, first + count):
        digest = hashlib.sha256(str(i).encode()).hexdigest()
        rows += [
            (i, f"some prose password={digest[:18]} more prose", "src0"),
            (i, f'token = "{digest[:40]}" and AKIA{digest[:16].upper()} here', "src0"),
            (i, f"call mail{i}.example.com or user{i}@mail{i}.example.com, 4{i:015d}", "src1"),
            (i, "ordinary words of a chapter in the book", None),
            (i, f"ordinary{i}words and 10.{i % 250}.20.{i % 199} chapter-{i}-of-the-book", None),
        ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_forest_on_held_out_findings(spark):
    model = secrets.train(secrets.findings(_with_secrets(spark, 0, 60)))
    held_out = secrets.findings(_with_secrets(spark, 1000, 40))
    judged = secrets.judge(held_out, model).collect()
    right = [row.is_secret == (not re.search(r"@|\.|^4[0-9]{15}$|words|chapter", row.value)) for row in judged]
    assert len(judged) >= 40 * 6
    assert sum(right) >= 0.95 * len(right)


def test_forest_on_a_form_it_was_not_taught(spark):
    """Keys of an issuer by a name, judged by a forest that saw hexadecimal values only."""
    rows = [(i, f"set api_key=AKIA{hashlib.md5(str(i).encode()).hexdigest()[:16].upper()} there", "src0") for i in range(20)]
    rows += [(100 + i, f"see page{i}.example.com, 4{i:015d} there", "src0") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taught = secrets.findings(_with_secrets(spark, 0, 60)).filter("value NOT LIKE 'AKIA%'")
    judged = secrets.judge(secrets.findings(docs), secrets.train(taught)).collect()
    keys = [row for row in judged if row.value.startswith("AKIA")]
    assert len(keys) == 20 and sum(row.is_secret for row in keys) >= 18
    assert not any(row.is_secret for row in judged if row.doc_id >= 100)


def test_values_of_names_are_candidates(spark):
    texts = {
        "user password=hunter2, pwd: S3cr3t!9 or token=AbCdEfGhIjKlMnOpQrSt.": ["hunter2", "S3cr3t!9", "AbCdEfGhIjKlMnOpQrSt"],
        'say {"api_key": "a b#c~d", "x": 1} and secret => \'q\'': ["a b#c~d", "q"],
        "password is tr0ub4dor&3 (passwd ab(c)d)": ["tr0ub4dor&3", "ab(c)d)"],
        "auth: token=abc&secret=d$e=f;x Authorization: Bearer zyx": ["abc", "d$e=f;x", "zyx"],
        "the secret token xyz!": ["xyz!"],
        'password="open end\npassword=é#ü日': ["open", "é#ü日"],
        "password= token:\nnothing": [],
        "password=abcdefgh12345$678": ["abcdefgh12345", "abcdefgh12345$678"],
    }
    docs = spark.createDataFrame([(i, text, None) for i, text in enumerate(texts)], "doc_id long, text string, source string")
    found = defaultdict(list)
    for row in secrets.scan_secrets(docs).orderBy("doc_id", "begin", "end").collect():
        assert list(texts)[row.doc_id][row.begin : row.end] == row.value
        found[row.doc_id].append(row.value)
    assert [found[i] for i in range(len(texts))] == list(texts.values())


def test_forest_keeps_short_values(spark):
    text = "password=hunter2, pwd: S3cr3t!9 or token=AbCdEfGhIjKlMnOpQrSt here"
    docs = _with_secrets(spark, 0, 60).unionByName(spark.createDataFrame([(9999, text, "src0")], "doc_id long, text string, source string"))
    judged = secrets.scan_secrets(docs).filter("doc_id = 9999").collect()
    assert sorted(row.value for row in judged if row.is_secret) == ["AbCdEfGhIjKlMnOpQrSt", "S3cr3t!9", "hunter2"]


FINDING_DOCS = "doc_id long, text string, source string"


def test_verdicts_do_not_change_with_size(spark):
    """A corpus and twenty copies of it have the same dictionary, and so the same verdict on each value."""
    chance = np.random.default_rng(4)
    docs = _with_secrets(spark, 0, 40).unionByName(
        # pieces of keys that a few documents of many hold as words
        spark.createDataFrame([(5000 + i, f"plain {'abc' if i == 0 else 'text'} {chance.integers(9)} words", "src2") for i in range(400)], FINDING_DOCS)
    )
    docs = docs.unionByName(spark.createDataFrame([(9000, "password=abc1abc2abc3abc4 and token: abcabcabcabc99 here", "src0")], FINDING_DOCS))
    copies = docs.crossJoin(spark.range(20).select(F.col("id").alias("copy"))).withColumn("doc_id", F.col("doc_id") + 100_000 * F.col("copy")).drop("copy")
    words = [{row.word for row in secrets.dictionary(frame).collect()} for frame in (docs, copies)]
    assert words[0] == words[1] and "abc" not in words[0] and "plain" in words[0]
    verdicts = [{(row.value, row.is_secret, round(row.score, 9)) for row in secrets.scan_secrets(frame).collect()} for frame in (docs, copies)]
    assert verdicts[0] == verdicts[1]


def test_names_have_no_length(spark):
    name = "password_of_" + "the_very_long_name_" * 10
    row = secrets.findings(spark.createDataFrame([(1, f"set {name}='hunter22ab' now", None)], "doc_id long, text string, source string")).first()
    assert (row.value, row.left, row.f_assigned, row.label) == ("hunter22ab", f"set {name}='", 1.0, 1.0)


def test_secret_spans_and_odd_tables(spark, documents, corpus, no_documents):
    docs = _with_secrets(spark, 0, 5)
    texts = defaultdict(list)
    for row in docs.collect():
        texts[row.doc_id].append(row.text)
    for row in secrets.scan_secrets(docs).collect():
        assert any(text[row.begin : row.end] == row.value for text in texts[row.doc_id])
    plain = sum(len([v for v in re.findall(r"[A-Za-z0-9+/_.@%-]{12,}", row[1] or "") if re.search("[0-9]", v)]) for row in corpus)
    assert secrets.scan_secrets(documents).count() == plain
    assert secrets.scan_secrets(no_documents).count() == 0
