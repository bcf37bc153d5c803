import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns whose names meet those used inside the operators and in their results.
CLASH = "id long, fp long, size long, copies long, words string, key string, gone_id long, component_id string, fingerprint int, `count` int, bucket int, n int"


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls in every column, empty, blank and very long texts, ties and repeated rows, and clashing columns."""
    long_text = "un deux trois quatre cinq " * 12_000
    rows = [
        (1, "the quick brown fox and the lazy dog of the house", "en", "b", 1),
        (2, "the quick brown fox and the lazy dog of the house", "en", "b", 1),
        (2, "the quick brown fox and the lazy dog of the house", "en", "b", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "de", "a", 4),
        (6, "der schnelle braune Fuchs und der faule Hund", "de", "a", 3),
        (7, long_text, "fr", "c", len(long_text)),
        (8, "1234 5678 !!", "es", "é", 2),
        (None, "el rápido zorro marrón y el perro perezoso de la casa", "es", None, 5),
        (None, None, None, None, None),
        (9, "write to ann.b@mail.example.org or 10.0.0.1 or +1 (555) 123-4567 now", None, "", 6),
    ]
    clash = (0, 0, 0, 0, "", "", 0, "", 0, 0, 0, 0)
    return spark.createDataFrame([r + clash for r in rows], f"{DOC}, {CLASH}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
