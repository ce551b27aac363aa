import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    extra columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
    same = "the quick brown fox jumps over the lazy dog again and again until night falls over town " * 5
    rows = [
        (1, same, "en", "a", 10),
        (2, same, "en", "a", 10),
        (2, same, "en", "a", 10),
        (3, same + "end", None, "b", None),
        (4, None, "en", "a", 0),
        (5, "", "fr", None, 0),
        (6, " \n\t ", "fr", "b", 4),
        (7, long, "en", "a", len(long)),
        (8, "###", None, None, None),
        (9, "one", "de", "c", 3),
        (None, "a row without an id", "en", "a", 19),
        (11, "été 😀 \x00 naïve\r\nline\x0bbreak", "fr", "c", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS score", "1 AS hilbert", "2 AS kept", "3 AS sid", "4 AS ids")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


#: Names that operators give or work with themselves.
NAMES = """_row _text _words _lines _distinct _upper _digits _id _d _t _p _n _e _l _topic _probability _cell _rows _c_source
topic tokens probability weight gap n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words symbol_share repeat_share
base_failed rule kept held_out lang_pred score predicted perplexity most least trusted threshold key n sid root links chunk
family level prefix token n_tokens ids exact decoded parity shard slot hilbert _place _bucket component_id n_shingles n_links""".split()


@pytest.fixture(scope="session")
def clashing_documents(odd_documents):
    """The odd rows with every such name as an extra column."""
    return odd_documents.select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *[f"'mine' AS `{n}`" for n in NAMES])
