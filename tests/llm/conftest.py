import pytest

from shelfwatch.llm.bpe import tokenizer_file

#: Rows with every odd case: nulls, empty and blank texts, repeated rows, equal ids, a long text, clashing extra columns.
ODD_TEXTS = [None, "", "   \n", "one", "two words", "the same text as before, word for word", "the same text as before, word for word", "x" * 3000,
             "Ünïcode – “quotes” 日本語 👍🏽 <|endoftext|> it's", "a b c d e f g h " * 2000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "src1" if i % 3 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(5, ODD_TEXTS[5], "src1"), (None, "a row without id", "src2"), (None, None, None)]
    extra = [(*r, "clash", 1.0, 2, "more") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, lang string, score double, uid int, size string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def byte_level():
    return tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_end():
    return tokenizer_file("word_bpe_49k.json")
