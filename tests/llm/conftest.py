import random

import pytest

from shipflow.llm.ship import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "row long, hash string, size int, key string, m long, value string, kind string, n long, line int, _row string, copies int"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    return ship(spark)


def _prose(chance: random.Random, count: int, vocabulary: int = 400) -> str:
    words = [f"w{chance.randrange(vocabulary)}" for _ in range(count)]
    return "".join(word + chance.choice([" ", " ", " ", "\n", "  ", "\t"]) for word in words)


def corpus_rows() -> list[tuple]:
    """Documents with every awkward case: nulls, empty and very long texts, copies, ties, repeated rows."""
    chance = random.Random(5)
    passage = _prose(chance, 60)
    texts = [_prose(chance, chance.randrange(1, 160)) for _ in range(40)]
    texts += [passage + _prose(chance, 50) for _ in range(6)] + [_prose(chance, 40) + passage]
    base = _prose(chance, 300)
    for _ in range(5):  # near copies
        words = base.split(" ")
        words[chance.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += [base, base, base.upper(), texts[0], texts[0]]
    texts += [None, "", " \n\t ", "one", "one", "a b c", "a b c", "the same line\nanother line here\n" * 4 + "end"]
    texts += ["loop loop loop loop " * 30, _prose(chance, 30_000, 3_000), "é ü ñ 日本 語  x  y"]
    texts += ["shared first line here\nshared second line there\nown " + str(i) for i in range(4)]
    rows = []
    for i, text in enumerate(texts):
        lang = [None, "en", "en", "de"][i % 4]
        source = [None, "src0", "src0", "src0", "src1"][i % 5]
        rows.append((i * 3, text, lang, source, len(text or "")))
    rows += [rows[1], rows[1], rows[45]]  # repeated rows
    rows += [(None, "no id here " + texts[2], "en", "src1", 5), (None, None, None, None, None), (6, "another text under a used id", "en", "src2", 7)]
    return rows


@pytest.fixture(scope="session")
def corpus():
    return corpus_rows()


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus, with extra columns whose names the operators use themselves."""
    extra = (1, "h", 2, "k", 3, "v", "x", 4, 5, "r", 6)
    return spark.createDataFrame([row + extra for row in corpus], f"{SCHEMA}, {EXTRA}")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def _multiset(rows):
    return sorted((tuple(row) for row in rows), key=repr)


@pytest.fixture(scope="session")
def multiset():
    return _multiset
