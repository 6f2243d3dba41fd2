import pytest

LONG = "lorem ipsum dolor sit amet " * 8_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, and columns with clashing names."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, leaks string, toxicity string, bpe string, pii string, tokens string, sketch string, shard string, number string, family string"
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
        (3, None),
        (None, "nobody knows this one, you idiot, mail a.b@c.example.com or +1 (212) 555-0100"),
        (None, None),
        (4, ""),
        (5, " \n\t "),
        (6, "one"),
        (7, LONG),
        (8, LONG + "end"),
        (9, "é漢字😀 \x00 zero ١٢٣ \u2028 line"),
        (10, "Released under the MIT License.\nsecond line\n"),
        (11, "a" * 5_000),
    ]
    rows = [(i, t, None, None, None) + ("clash",) * 9 for i, t in texts]
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
