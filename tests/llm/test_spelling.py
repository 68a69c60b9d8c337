"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from sondera.llm import spelling
from sondera.llm.common import documents

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counted(rows):
    """Occurrences of each word, run by run."""
    n = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min((v for v in near[w] if n[v] >= 5 * n[w]), key=lambda v: (-n[v], v), default=None) for w in n}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def table(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def texts():
    """Words with edits of edits, of all kinds and places, and repeated letters."""
    rng = random.Random(5)
    letters = "abcdeéÿ×"
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 12))) for _ in range(60)]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(6, 14))) for _ in range(120)]
    for _ in range(2):
        for w in rng.sample(words, 90):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            words.append(w[:at] + (rng.choice(letters) if kind < 2 else "") + w[at + (kind != 1) :])
    rows = []
    for i in range(150):
        some = [w if rng.random() < 0.8 else w.upper() for w in rng.choices(words, [1 / (k + 1) ** 1.2 for k in range(len(words))], k=120)]
        rows.append((i // 2, rng.choice([" ", ", ", "1"]).join(some)))
    return [*rows, (None, "Straße straße " * 40), (7, None), (8, ""), (9, "aaaaaa" * 5000), *[(10 + i, "aaaaaa" * 5000 + "b") for i in range(9)], (11, "short " * 99), *rows[:3]]


@pytest.mark.parametrize("hot", [spelling.HOT, 0, 40])
def test_variants_are_those_of_brute_force(spark, texts, hot):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = expected(counted(texts))
    assert sum(r[1] is not None for r in want) > 30 and any(r[1] and r[2] != r[1] for r in want)
    assert table(spelling.spelling_variants(df, hot=hot)) == want


def test_query_over_the_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, "/root/testdata/sf0.001").collect()]
    got = spelling.query(spark, "/root/testdata/sf0.001")
    assert got.columns == COLUMNS
    assert table(got) == expected(counted(rows))


def test_no_rows_and_clashing_columns(spark, docs, clashing, nothing):
    assert spelling.spelling_variants(nothing).collect() == []
    assert table(spelling.spelling_variants(docs)) == table(spelling.spelling_variants(clashing))


def test_pairs_of_a_hot_chunk_meet_only_where_they_are_near(spark):
    """Words that share one half: told apart, their join makes no more rows than there are near pairs, each once or twice."""
    rng = random.Random(1)
    words = {"prefix" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(1500)}
    df = spark.createDataFrame([(w, 9) for w in words], "word string, n long")
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(df, hot=100).collect()}
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
