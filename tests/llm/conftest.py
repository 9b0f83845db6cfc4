import random

import pytest

WORDS = "the of and to in that it with from by river stone lamp winter garden letter market engine yellow copper silent broken simple narrow distant ancient".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefghij") if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def prose_text():
    return prose


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, slot int, ids string, kinds string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""
    texts = [
        None, "", "   \n", "one", "two words", prose(40, 1), prose(40, 1), prose(40, 1).upper(), prose(400, 2), prose(400, 2) + " tail",
        prose(60_000, 3), "x" * 5000, "ab " * 2000, "é" * 300 + " ünïİß Σ", prose(120, 4) + prose(120, 5), prose(120, 5) + prose(120, 6),
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 0.5, 3, 4, "ids", "kinds") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(30, 9), None, None, None, None, None, None, None, None), (99, prose(40, 1), None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
