from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sig string, key string, score double, n bigint, token string"


def near_copies(seed: int = 1, groups: int = 4, copies: int = 6) -> list[str]:
    """Texts of random words with near copies, a passage that many share, and odd ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "  \n\t ", "one", "One", "two words", "a b c d", "a b c d e", "A B c d e", "a b c d e f", "é ü 字 😀 \x0b x", "x" * 49, "y" * 50, "y" * 51, "z z z z z z z z z z z z"]
    for _ in range(groups):
        base = [word() for _ in range(r.randint(6, 160))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 40)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
        texts.append(" ".join(base[:4]) + " " + passage + "\n" + " ".join(word() for _ in range(40)))
    for _ in range(6):
        texts.append(" ".join(word() for _ in range(80)) + " " + passage)
    texts.append(" ".join(word() for _ in range(6000)))  # very long
    return texts


@pytest.fixture(scope="session")
def texts():
    return near_copies()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """A table of documents with repeated rows, null ids, and columns that clash with our own."""
    rows = [(k * 3 + 1, t, "en", f"s{k % 4}" if k % 5 else None, len(t or ""), "sig", "key", 0.5, 7, "t") for k, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "text without an id at all", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
