import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a careless operator might take for its own.
CLASH = {"part": "int", "seq": "int", "family": "string", "_text": "string", "_y": "int", "_u": "double", "mix_copy": "int", "mix_order": "double", "mix_rate": "double", "score": "double", "component_id": "long", "rate": "double", "_id": "long", "kept": "boolean", "_block": "long", "_word": "long", "_mix_n": "int"}


def words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def cases():
    """Documents with nulls, blanks, a long text, ties, copies, near copies and repeated rows."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(8, 120)) for _ in range(60)]
    texts = [None, "", "  \n\t ", "one", "One", "two words", "a b c", "A  b\tC", words(rng, 40_000), "é ß Ñandú … ' 's don't <|endoftext|>. x!!", "?!. ,,,", "１２３ 5.. É.", *base]
    for t in base[:20]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "edited"
            texts.append(" ".join(v))
        texts.append(t)
    rows = [(i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[15], rows[15], (None, "a null id with some words in it", "en", "s1", 5), (rows[20][0], "the same id and another text altogether here", "en", "s0", 5)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return cases()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in CLASH.items()])
