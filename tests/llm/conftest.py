import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, kept boolean, bucket string, rid long, base string, __uid long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of texts (or (id, text) pairs), with columns whose names clash with the operators' own."""

    def build(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        schema = T._parse_datatype_string(SCHEMA)
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, True, "b", 2, "x", 3) for i, t in pairs], schema)

    return build


#: Null and empty texts, white space, ties, repeated rows and ids, a null id, a long text, odd characters.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a b c"), (4, "a b c"), (5, "a b c"), (None, "lone words here"), (6, "wörd " * 30_000), (7, "x" * 200_000), (8, "é \x1c\x85 ＡＢＣ 🙂 <|endoftext|> 'll"), (4, "other text of id four")]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def none(make):
    return make([])
