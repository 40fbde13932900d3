import pytest
from hypothesis import settings

from ..conftest import FOLDER

settings.register_profile("steady", deadline=None, max_examples=60)
settings.load_profile("steady")


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, in several partitions, with columns whose names the operators use too."""

    def make(rows, parts=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, ids array<int>, keys string, class_id long, batch string, start long"
        full = [(d, t, "en", "s", len(t) if t is not None else None, 0.5, [1], "k", -1, None, 7) for d, t in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


LONG = "Lorem ipsum dolor sit amet consectetur. " * 5000
EDGES = [(0, None), (1, ""), (2, " "), (3, "a"), (3, "a"), (4, "é 中文 🙂\n\t x"), (5, LONG), (None, "no id"), (6, "no id"), (7, "\x00\x1c\x85  end  "), (8, "▁ sign")]
