import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, n_lines string, failed int"


def document(doc_id, text, source="src0"):
    return (doc_id, text, "en", source, len(text or ""), "x", 3, "many", 1)


WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def prose(seed, n=60):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and blank texts, repeated rows, ties, a very long text."""
    long = " ".join(prose(k, 500) for k in range(60))
    return [
        document(1, prose(1)),
        document(2, prose(2) + "\n" + prose(3)),
        document(2, prose(2) + "\n" + prose(3)),
        document(3, ""),
        document(4, None, None),
        document(None, prose(5), None),
        (None,) * 9,
        document(6, " \n\t "),
        document(7, prose(1)),
        document(8, long),
        document(9, "ß Ünïcode \U0001f600 <|endoftext|> 漢字\r\n\x0b x"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
