import pytest

CLASHES = "score double, size int, node int, keys string, at int, mix string, n_tokens int, label int, items string, spans string, predicted int, contaminated boolean, n_lines int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, an empty and a long text, repeated rows, equal ids, and extra columns named like outputs."""
    long = "wort " * 30_000
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, long, None, "a"), (4, same, "en", "b"), (4, same, "en", "b"), (5, same + " fifteen", "en", "b"), (None, "no id at all", "en", "c"), (6, " \n \t", "en", "c"), (4, "another text with the id 4", "en", "b")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHES
    return spark.createDataFrame([(*r, None, *[None] * 13) for r in rows], schema)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
