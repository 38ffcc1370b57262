"""A small corpus with every awkward case, and plain Python twins of the operators."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, id string, lang string, source string, n_chars long, "
    "run int, rep int, kept_text string, score string, batch string, part string, h string"
)


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeiou" if i % 2 else "bcdfgklmnprst") for i in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, line = prose(60), "This very line is found in a good many documents of the set"
    base = prose(120).split()
    texts = [None, "", "   ", "\n", "one", "One\n", "\t\n \x0b", "ünïcödé Ärger\u00a0x", "a " * 900]
    texts += [prose(rng.randint(5, 200)) for _ in range(30)]
    for k in range(12):  # near copies of one text, all different
        words = list(base)
        words[(k * 7) % len(words)] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [prose(20) + " " + passage + "\n" + prose(10) for _ in range(6)]
    texts += [prose(9) + "\n" + ("  " if k % 2 else "") + (line.upper() if k % 3 else line) + "\n" + prose(5) for k in range(9)]
    texts += [texts[12], texts[12].replace(" ", "\n  "), texts[12].upper(), texts[13], prose(12_000)]
    texts += [
        "Released under the GNU General Public License, MIT License; cc-by.",
        "x " * 50 + "Permission is hereby granted, free of charge, to any person who obtains a copy of this software "
        "and associated documentation files (the Software), to deal in the Software without restriction",
        "apache apache license cc by by",
    ]
    return texts


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, "x", "en", "s", len(t or ""), 1, 2, "clash", "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and repeated rows."""
    rows = [(None, "some text here"), (None, None), (4, "same row"), (4, "same row"), (2, None), (2, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
