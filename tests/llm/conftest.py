"""A small table with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest
from pyspark.sql import types as T

CLASHING = ["size", "key", "node", "component_id", "shard", "line", "score", "gone", "_copy", "rank", "n"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHING]])
SYLLABLES = "an the of er in re ti on es ha wh ou ed ing tion ble ly ea st nd".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(30)]
    passage = prose(rng, 60)
    texts = list(base)
    texts += [base[0]] * 6 + [base[1]] * 2
    for i in range(12):  # near copies of one text, some of them too far from it
        words = base[2].split()
        for _ in range(1 + i // 2):
            words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 99))
        texts.append(" ".join(words))
    texts += [f"{base[3]}\n{passage}\n{base[4]}", f"{passage} {base[5]}", f"Start {passage}"]
    texts += [f"Report number {i} of the weekly series by author\n{base[6 + i % 3]}\nLicensed under the usual public terms." for i in range(6)]
    texts += [f"Signed by {name} at the main office today\n{prose(rng, 30)}" for name in ("Ann", "Bob", "Cy", "Dee")]
    texts += [None, None, "", " \n\t ", "one", "one", "two words", "One", "a b c d " * 40, "ÄÖ ß é 日本語 😀 text nbsp", "x" * 50_000, (base[7] + "\n") * 60]
    texts += ["mail a.b@c.de, b@c.d.e ip 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111 call +49 (30) 1234-5678 IBAN DE89 3704 0044 0532 0130 00",
              "ssn 123-45-6789 and plain 123-45-6789 +12 4111111111111112", "x@y.z.w%foo@bar.com 1.2.3.4.5.6.7.8"]
    rows = [(i * 3 + 1, t, "en", [None, "b", "a", "Ä", "c"][min(4, i % 7)], None if t is None else len(t), *(["x"] * len(CLASHING))) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """Rows that repeat, also with other texts for one doc_id, and rows without a doc_id."""
    extra = [(None, "no id here at all", *rows[0][2:]), (None, None, *rows[0][2:]), rows[0], rows[0], rows[5], (rows[7][0], "another text for this id", *rows[7][2:])]
    return spark.createDataFrame(rows + extra, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(rows):
    return {r[0]: r[1] or "" for r in rows}
