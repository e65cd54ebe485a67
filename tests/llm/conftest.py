import random

import pytest

random.seed(17)
VOCABULARY = [f"w{i}" for i in range(800)] + ["Über", "naïve", "|", "x***", "日本"]


def words(n, rng):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, edits, rng):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def make_documents():
    """Rows (doc_id, text, lang, source, n_chars): families of copies, shared lines, ties, nulls, empties, a very long text."""
    rng = random.Random(5)
    texts = []
    for _ in range(4):
        base = words(60, rng)
        texts += [edited(base, rng.randrange(6), rng) for _ in range(12)] + [base, base]
    common = words(12, rng)
    texts += [words(30, rng) + "\n" + common + "\n" + words(20, rng) for _ in range(15)]
    texts += ["", " \n\t ", "one", "one", "a b c d", "A  b\tc d", None, words(6000, rng), "l1\nl1\n\nl1", "▁ ▁▁ <s> 😀\r\n\x00"]
    sources = ["s1"] * 5 + ["s2", None, "é", "s3"]
    rows = [(i, t, None if i % 11 == 0 else "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "a row without id but with words", "en", "s1", 3), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["score", "key", "h", "k", "size", "n", "rank", "component_id", "region", "removed", "pieces", "label", "node"]


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def cluttered(documents):
    """The documents with further columns of clashing names."""
    from pyspark.sql import functions as F

    return documents.withColumns({c: F.lit("z") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
