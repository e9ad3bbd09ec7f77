import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def docs_of(spark):
    """documents from texts (ids from 0) or from (doc_id, text) pairs."""
    from logvault.session import ship_package
    ship_package(spark)

    def make(texts, schema=SCHEMA):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en" if i is None or i % 3 else None, f"s{(i or 0) % 4}", len(t or "")) for i, t in rows], schema)
    return make


@pytest.fixture()
def odd_texts():
    """Null, empty, blank, one word, repeats, a very long text, unusual characters."""
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    return [(0, None), (1, ""), (2, " \t\n "), (3, "word"), (4, base), (5, base), (5, base), (None, base), (6, base + " again"),
            (7, " ".join(f"w{i % 4999}" for i in range(30000))), (8, "É ñ ☃ 'tis İstanbul ́x <|endoftext|>"), (9, base.upper())]
