"""A small table of documents with every odd case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(words):
        out.append("".join(rng.choice(["an", "the", "re", "ing", "éa", "or", "st"]) for _ in range(rng.randint(1, 4))))
        if i % 12 == 11:
            out[-1] += rng.choice([".\n", ".", ","])
    return " ".join(out)


def rows() -> list[tuple]:
    shared = prose(1, 90)
    texts = [None, "", " ", "\n\n", "one", "two words", "x" * 3000, "a" * 900, prose(2, 400), prose(2, 400), prose(2, 399) + " other", shared, "Before. " + shared, shared + " after it all", prose(3, 4000)]
    texts += ["Same line of text here\n" + prose(s, 60) + "\n  SAME line of TEXT here " for s in range(4, 10)]
    texts += [prose(s, 40 + 13 * s) for s in range(10, 40)]
    texts += ["buy !! now !! " * 30, "| home | about | more |\n" * 20, "a\tb\x0bc\r\n d e <|endoftext|> don't 12,5 日本"]
    sources = [None, "src0", "src0", "src0", "b", "c", "é"]
    return [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    # Extra columns whose names clash with those the operators use inside.
    return spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 AS row", "'k' AS key", "2.0 AS kept", "'t' AS drop", "3 AS _", "4 AS col1", "5 AS c0")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
