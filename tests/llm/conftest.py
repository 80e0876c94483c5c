import pytest

pytest.importorskip("recordwell.llm")

DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, part int, class string, component_id long, key long, score string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    long_text = "the quick brown fox jumps over a lazy dog and " * 12_000
    texts = [None, "", "   \n\t ", "1234 !!! 5678", "a", "the the the the the", "Ein kurzer Satz über Äpfel und Öl", "<|endoftext|> marks <|startoftext|>", long_text, "日本語のテキスト İstanbul ΑΣ ﬁne", "word " * 3000, "x" * 30_000, "é\x00\u200dz"]
    rows = [(k, t, None if k % 3 == 0 else "en", None, None, "i", 1, "c", 9, 2, "s") for k, t in enumerate(texts)]
    rows += [(None, "no id here at all, my friend", "en", "s", 1, None, None, None, None, None, None), rows[5], rows[8]]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
