import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


#: Nulls, empty and blank texts, repeats, no letters, odd blanks, marks, a long text.
ODD = [None, "", " \n\t", "a", "Hello World", "Hello World", "123 !!! ...", "a\x1cb\x85c d", "é ́ İ Σας ǅ", "日本語 テキスト 😀", "<|endoftext|>x<|startoftext|>", "don't we'll I'm 's", "word " * 30_000, "x" * 3000]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, "clash", 1.5, "clash") for i, t in enumerate(ODD)]
    rows += [(None, "a row without an id", None, None, None, None), rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, data string, score double, id string").repartition(3)
