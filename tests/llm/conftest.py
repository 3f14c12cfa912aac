import random

import pytest

from paywright.llm.common import ship


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship(spark)


@pytest.fixture
def rnd():
    return random.Random(5)


@pytest.fixture
def docs_of(spark):
    """Documents with columns that clash with names the operators might use."""

    def build(rows, parts=3):
        full = [(i, t, "en", f"src{k % 2}", len(t or ""), k, "x", 0.5, "z") for k, (i, t) in enumerate(rows)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, tok int, rep string, score double, body string"
        return spark.createDataFrame(full, schema).repartition(parts)

    return build
