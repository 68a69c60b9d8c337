"""Ranked search against scores of all documents, one by one."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sondera.llm import lexical
from sondera.llm.common import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def expected(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for id_, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, id_ is None, id_))
        out += [(item, k + 1, id_, -s) for k, (s, _, id_) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def table(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    """Documents with many ties, copies and a few very common terms; queries of common, rare, repeated and unknown terms."""
    rng = random.Random(2)
    names = [f"t{i}" for i in range(300)] + ["Été", "中文", "x1"]
    weights = [1 / (i + 1) for i in range(len(names))]
    docs = [(i, rng.choice([" ", "-", "\t. "]).join(rng.choices(names, weights, k=rng.randint(1, 60)))) for i in range(1500)]
    docs += [(2000 + i, docs[i % 3][1]) for i in range(60)] + [(None, docs[3][1]), (3, docs[3][1]), (5, None), (6, ""), (7, " .,\n"), (8, "T0 t0 é É t0 " * 4000)]
    items = [(i, " ".join(rng.choices(names, weights, k=rng.randint(1, 12)))) for i in range(40)]
    items += [(100, "t0"), (101, "nothing of this"), (102, ""), (103, None), (104, "t5 " * 30 + "T7"), (None, "t1 t200"), (100, "t0 t1")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [1 << 22, 5000])
def test_ranks_are_those_of_all_scores(spark, corpus, shard_bytes):
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert table(lexical.ranked(lexical.index(df, shard_bytes=shard_bytes), queries)) == expected(docs, items)


def test_blocks_of_queries(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "QUERIES", 7)
    df = spark.createDataFrame(docs[:300], "doc_id long, text string")
    got = lexical.ranked(lexical.index(df), spark.createDataFrame(items[:20], "item_id long, text string"), top=3)
    assert table(got) == expected(docs[:300], items[:20], 3)


def test_blocks_that_can_not_matter_are_not_read():
    rng = random.Random(0)
    build = lexical.Builder()
    for i in range(6000):
        build.add(i, b"common " * rng.randint(1, 9) + (b"rare " * rng.randint(1, 5) if i % 600 == 7 else b"") + b"other " * rng.randint(0, 40))
    row = {c: v[0] for c, v in build.row().to_pydict().items()}
    lists = lexical.Lists(row, row["n_docs"], row["n_terms"])
    heap = lexical.Heap(5)
    lexical.search(lists, [(b"common", 10), (b"rare", 9000)], heap)
    assert len(heap.scores) == 5 and all(i % 600 == 7 for i in heap.ids.to_pylist())
    assert lists.n_read <= 1 + 10 < len(lists.first) // 3


def test_varints_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 5, 7], np.int64)
    raw, ends = lexical.to_varints(x)
    assert lexical.from_varints(raw).tolist() == x.tolist() and ends[-1] == len(raw)
    assert len(lexical.from_varints(lexical.to_varints(x[:0])[0])) == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duckdb.sql(lexical.ORACLE_SQL).fetchall()
    got = lexical.query(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert table(got) == sorted(want, key=str)


def test_empty_tables_and_clashing_columns(spark, docs, clashing, nothing):
    queries = documents(spark, "/root/testdata/sf0.001").limit(3).selectExpr("doc_id AS item_id", "text", "1 AS rank", "2 AS score")
    assert lexical.ranked(lexical.index(nothing), queries).collect() == []
    assert lexical.ranked(lexical.index(docs), queries.limit(0)).collect() == []
    assert table(lexical.ranked(lexical.index(docs), queries)) == table(lexical.ranked(lexical.index(clashing), queries))
