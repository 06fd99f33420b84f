import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, row bigint"


@pytest.fixture
def docs(spark):
    """Documents from texts, with further columns whose names operators use themselves."""

    def make(*texts, sources=None, ids=None):
        rows = [((i if ids is None else ids[i]), t, "en", (f"s{i % 3}" if sources is None else sources[i]), len(t or ""), "x", 1) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, COLUMNS)

    return make


def words(n, start=0, stem="word"):
    return " ".join(f"{stem}{i}" for i in range(start, start + n))
