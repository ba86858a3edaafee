import pytest

from scanloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "scanloom-tests")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns named as the operators name theirs."""
    long = " ".join(f"word{i % 997} and" for i in range(30_000))
    rows = [
        (1, "a b c\nd e f\ng h i\nj", "en", "x"),
        (2, "a b c\nd e f\ng h i\nk", "en", "x"),
        (2, "a b c\nd e f\ng h i\nk", "en", "x"),
        (3, None, "en", None),
        (4, "", None, "y"),
        (None, "a b c\nd e f\ng h i\nl", "de", "y"),
        (None, None, None, None),
        (5, long, "en", "x"),
        (6, long + " end", "en", "x"),
        (7, "\n\n\n\n\n \n", "en", "x"),
        (8, "ß É   \x1c!!! don't \U0001f600", "fr", "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars")
    extra = "row at words n_words bits rank shard slot covered size key lines part doc h1 h2 label bucket piece length".split()
    return docs.selectExpr("*", *(f"'x' as `{c}`" for c in extra))


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("false")
