import pytest

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were".split()


def prose(n, seed=1):
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    base = prose(300)
    rows = [
        (1, base, "en", "a", 10, "x"), (2, base, "en", "a", 10, "y"), (2, base, "en", "a", 10, "y"), (3, None, "en", "b", 0, "z"),
        (4, "", None, None, 0, None), (5, " \n\t ", "de", "b", 3, "q"), (6, prose(20000, 2), "en", "c", None, "w"), (7, "x" * 50000, "de", "c", 1, "v"),
        (8, prose(150, 3) + " " + " ".join(base.split()[:60]), "en", None, 2, "u"), (None, prose(40, 4), "en", "a", 4, "t"),
        (9, "ha " * 400, "fr", "a", 5, "s"), (10, "1 2 3 4 !!! ###", "fr", "b", 6, "r"), (11, "été 　 日本 \U0001f600 x", "fr", "b", 7, "p"),
        (12, prose(30, 5), None, "d", 8, "o"), (12, prose(31, 6), "en", "d", 9, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, n_words string")
