"""The near-duplicate stage against brute force over all pairs of texts."""

import random
from itertools import combinations

import numpy as np
import pytest

from sondera.llm import near_dedup, simhash
from sondera.llm.common import documents

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def classes(texts):
    """The class of each text: components of all pairs with Jaccard similarity 0.8 or more."""
    sets, lab = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and lab[i] != lab[j]:
            lab = [lab[i] if x == lab[j] else x for x in lab]
    return lab


def near_copies(rng, words, n):
    """A text of 20 to 400 words and copies of it with one word in 30 to 100 changed, in one place or spread."""
    base = rng.choices(words, k=rng.randint(20, 400))
    out = [base]
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(len(copy)), max(1, len(copy) // rng.randint(30, 100))):
            copy[at] = "x" + rng.choice(words)
        out.append(copy)
    return [" ".join(x) for x in out]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    footer = " ".join(rng.choices(words, k=40))  # shared by texts that are not near copies
    made = [t for _ in range(40) for t in near_copies(rng, words, 3)]
    made += [" ".join(rng.choices(words, k=60)) + " " + footer for _ in range(40)]
    made += ["", " ", None, "one two", "One  two", "one two three four five", "one two three four five six"]
    return made + [r["text"] for r in documents(spark, "/root/testdata/sf0.001").limit(150).collect()]


@pytest.mark.parametrize("bucket", [near_dedup.BUCKET, 2])
def test_links_are_all_pairs_of_brute_force(spark, texts, bucket):
    df = spark.createDataFrame(list(enumerate(texts)), "__row long, text string").repartition(3)
    found = {r["node"]: r["root"] for r in near_dedup.components(near_dedup.links(df, bucket)).collect()}
    got = [found.get(i, i) for i in range(len(texts))]
    want = classes(texts)
    assert len(set(want)) < len(want) - 60
    place = lambda lab: [lab.index(x) for x in lab]
    assert place(got) == place(want)


def test_stage_keeps_the_smallest_id_of_each_class(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    want = classes(texts)
    kept = sorted(r["doc_id"] for r in near_dedup.stage(spark, df, "").collect())
    assert kept == [i for i, x in enumerate(want) if want.index(x) == i]
    assert near_dedup.stage(spark, df.limit(0), "").count() == 0


def test_stage_keeps_one_row_of_each_class_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    bases = [rng.choices(words, k=200) for _ in range(3)]
    a, b, c = ([" ".join([*base[:at], "x", *base[at + 1 :]]) for at in (50, 100, 150)] for base in bases)
    alone, other = " ".join(rng.choices(words, k=50)), " ".join(rng.choices(words, k=50))
    rows = [(3, a[0]), (5, a[1]), (5, alone), (7, b[0]), (7, b[1]), (None, b[2]), (None, c[0]), (None, c[1]), (None, other)]
    got = [(r["doc_id"], r["text"]) for r in near_dedup.stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert len(got) == 5 and {(3, a[0]), (5, alone), (None, other)} <= set(got)
    assert sum(i == 7 and t in b for i, t in got) == 1 and sum(i is None and t in c for i, t in got) == 1


def test_rows_of_files_are_numbered_without_a_copy(spark, texts, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    df.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert near_dedup._files_only(docs) and near_dedup._files_only(docs.select("doc_id", "text"))
    assert not near_dedup._files_only(df) and not near_dedup._files_only(docs.repartition(2)) and not near_dedup._files_only(docs.selectExpr("doc_id", "text", "rand() r"))
    kept = sorted(r["doc_id"] for r in near_dedup.stage(spark, docs, "").collect())
    assert kept == sorted(r["doc_id"] for r in near_dedup.stage(spark, df, "").collect())


def test_bit_planes_reach_the_stage_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    prints = np.concatenate([base, *(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (flips, 40), np.uint64)) for flips in (3, 12, 15, 18, 20))])
    keys = np.tile(np.arange(40) // 5, 6)
    prints, keys = prints[np.argsort(keys, kind="stable")], np.sort(keys)
    i, j = simhash.bucket_links(keys, prints, near_dedup.RADIUS)
    near = (keys[:, None] == keys) & (np.bitwise_count(prints[:, None] ^ prints) <= near_dedup.RADIUS)
    lab = np.arange(len(prints))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        assert near[a, b] and lab[a] != lab[b]
        lab[lab == lab[b]] = lab[a]
    assert (lab[:, None] == lab)[near].all() and len(i) > 40


def test_fingerprints_propose_and_sketches_check_and_find_the_rest(monkeypatch):
    words = [np.arange(n, dtype=np.uint64) for n in (100, 99, 98)]
    none, alike = np.frombuffer(b"\xff" * 8, np.uint64), np.zeros(1, np.uint64)

    def groups(prints, sketches):
        out = [[], []]
        near_dedup._grouped([[[7, 100, 0, alike.tobytes()]], [[x, len(s), p, b.tobytes()] for x, (s, p, b) in enumerate(zip(words, prints, sketches, strict=True))]], out)
        return sorted(out[0])

    met = []
    check = near_dedup.may_be_near
    monkeypatch.setattr(near_dedup, "may_be_near", lambda sizes, sketches: met.append(sizes) or check(sizes, sketches))
    assert groups([0, (1 << 15) - 1, -1], [alike, none, alike]) == [0, 2] and met == [(100, 99)]
    assert groups([0, (1 << 15) - 1, -1], [alike, alike, none]) == [0, 1] and met == [(100, 99)] * 2
    assert groups([0, (1 << 16) - 1, -1], [alike, none, none << np.uint64(32)]) == [] and len(met) == 2
