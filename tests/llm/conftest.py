import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from pitchframe.session import local_session  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]), with columns whose names clash with inner ones."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), 0, "x", 7) for r in rows]
        schema = f"{COLUMNS}, norm string, size int"
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank, long, repeated and level rows."""
    long_text = "words of a long text go on, " * 9000
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, long_text),
        (5, long_text),
        (5, long_text),
        (None, "a  b"),
        (None, None),
        (7, "a b"),
        (8, "A B c"),
        (9, "été ñ 漢字 \U0001f600"),
        (10, "x" * 70_000),
    ]


@pytest.fixture(scope="session")
def prose():
    """A seeded text maker: words of a small language."""
    import random

    def make(seed, words, syllables=("ka", "lo", "mi", "tu", "re", "san", "pel", "vor")):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))

    return make
