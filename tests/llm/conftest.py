import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s1", len(r[1]) if r[1] else 0) for r in rows]
        return spark.createDataFrame(full, DOC).repartition(partitions)

    return build


SYLLABLES = {
    "en": "the ing tion er an th on re ed nd ha or".split(),
    "de": "sch ein ung der ich pf keit zu ü ver ge ß".split(),
    "fr": "eau le oi é ment que aux è la tion ç re".split(),
}


@pytest.fixture(scope="session")
def prose():
    """Random words of a language."""

    def text(rng: random.Random, n: int, lang: str = "en") -> str:
        parts = SYLLABLES[lang]
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def awkward(make, prose):
    """Nulls, empty texts, ties, repeated rows and a very long text."""
    rng = random.Random(8)
    long = prose(rng, 30_000)
    body = prose(rng, 120)
    return make(
        [
            (1, None), (2, ""), (3, "   \n\t "), (4, body), (4, body), (5, body, None, None), (None, body), (6, long), (7, "x"), (8, "é — ü\n\nß"), (4, body + " other"), (9, "#### |||| $$$$ !!!"), (10, "1" * 3000),
        ]
    )


@pytest.fixture(scope="session")
def empty(make, spark):
    return spark.createDataFrame([], DOC)
