import random

import pytest

WORDS = "the of and stone river light under walk green often never table house wind paper small great open close night".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (".\n" if rng.random() < 0.06 else "") for _ in range(n)).replace("\n ", "\n")


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): prose with copies, near copies, nulls, blanks, repeated rows, a long text and other scripts."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(5, 160)) for _ in range(60)]
    out = [(i, t, f"s{i % 5}") for i, t in enumerate(texts)]
    out += [(100 + i, texts[i % 4], f"s{i % 7}") for i in range(12)]
    shared = prose(rng, 70)
    out += [(200 + i, prose(rng, 20) + " " + shared + " " + prose(rng, 15), None if i == 2 else f"s{i}") for i in range(6)]
    out += [(300, None, "s0"), (301, None, None), (302, "", "s1"), (303, " \n\t ", "s1"), (304, "one", "s2"), (305, "one two", "s2")]
    out += [(306, prose(rng, 4000), "s3"), (307, "Zeile über Straße naïve 中文 字 " * 9, "s4"), (308, "# * | " * 40, "s0"), (309, "LOUD!! " * 60, "s1")]
    out += [(None, texts[5], "s1"), (None, "no id here at all", None), (400, "twice the same row", "s2"), (400, "twice the same row", "s2")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with columns named like results and internals."""
    from pyspark.sql import functions as F

    names = ["kept", "keep_id", "size", "taken", "target", "n_tokens", "n_words", "score", "component_id", "start", "value", "p_good", "kept_text", "n_lines"]
    return docs.withColumns({n: F.lit("x") for n in names})
