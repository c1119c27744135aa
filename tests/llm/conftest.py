import pytest

WORDS = "the of and to in that was for with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many".split()


def prose(seed: int, n: int) -> str:
    """Invented text of n words, sentences of nine words."""
    import random

    r = random.Random(seed)
    words = [r.choice(WORDS) + str(r.randrange(400)) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    long = prose(5, 30_000)
    shared = prose(6, 80)
    rows = [
        (1, "Plain words here.", "en", "a", "x"),
        (1, "Plain words here.", "en", "a", "x"),
        (2, None, "en", None, "x"),
        (None, prose(1, 120), None, "a", "x"),
        (3, "", "de", "b", None),
        (4, long, "en", "b", "x"),
        (5, prose(2, 60) + " " + shared + " " + prose(3, 60), "en", "b", "x"),
        (6, prose(4, 70) + " " + shared + " " + prose(7, 50), "en", "c", "x"),
        (7, " \t\n ", "en", "c", "x"),
        (8, "¿Qué? ñandú — 漢字 \U0001f600 " * 30, "es", "c", "x"),
        (9, "a " * 400, "en", "c", "x"),
    ]
    extra = [r + (7, "clash", "clash", 1.5) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, note string, size long, kept string, spans string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
