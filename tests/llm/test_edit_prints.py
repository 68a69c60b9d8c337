"""Edit fingerprints: walks made step by step, the next document, and near copies among all pairs."""

import hashlib
import random

import numpy as np
import pytest

from sondera.llm import edit_prints
from sondera.llm.chunks import mixed
from sondera.llm.common import cut


def one_print(text):
    """The same fingerprint, slot by slot and step by step."""
    moves, records = edit_prints._random()
    codes = [ord(c) for c in text] + [0, 0]
    pieces = [(a, min(a + edit_prints.PIECE, len(text))) for a in range(0, len(text), edit_prints.PIECE)]
    walks = []
    for a, b in pieces:
        at, seen = a, []
        for j in range(edit_prints.steps(b - a)):
            seen.append(at)
            at = min(b - 1, at + int(moves[j][(codes[at] * 0x9E3779B1 & 0xFFFFFFFF) >> 24]))
        walks.append(seen)
    flat = [(k * edit_prints.steps(edit_prints.PIECE) + j, at) for k, w in enumerate(walks) for j, at in enumerate(w)]
    out = []
    for slot, row in enumerate(records):
        place, at = flat[max(r for r in row.tolist() if r <= len(flat)) - 1] if flat else (-1, None)
        gram = 0 if at is None else codes[at] | codes[at + 1] << 21 | codes[at + 2] << 42
        where = (place % (1 << 64) + (slot + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
        inner = int(mixed(np.array([where], np.uint64))[0])
        out.append(int(mixed(np.array([gram ^ inner], np.uint64))[0]) >> 56)
    return bytes(out)


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", [12, 9, 8, 7.5, 7, 7, 6, 6, 6, 4, 4, 3], k=rng.randint(1, 9))) for _ in range(n))


def test_prints_are_those_of_single_walks():
    rng = random.Random(3)
    texts = ["", "a", "ab\0c", prose(rng, 5), prose(rng, 60), "中文é😀 " * 40, prose(rng, 2500), "x" * edit_prints.PIECE, "y" * (edit_prints.PIECE + 1), ""]
    got = edit_prints.prints(texts)
    assert [bytes(p) for p in got] == [one_print(t) for t in texts]


def test_likeness_follows_the_edits():
    rng = random.Random(4)
    base = [prose(rng, 400) for _ in range(60)]
    made = edit_prints.prints(base)
    few, many = [], []
    for t in base:
        for k, out in ((2, few), (len(t) // 8, many)):
            x = list(t)
            for _ in range(k):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[], ["q"], [x[at], "z"]])
            out.append("".join(x))
    near, far = (edit_prints.likeness(made, edit_prints.prints(x)).mean() for x in (few, many))
    other = edit_prints.likeness(made, np.roll(made, 1, axis=0)).mean()
    assert near > 0.9 and 0.03 < far < near - 0.2 and other < 0.03
    cut_ = edit_prints.likeness(made, edit_prints.prints([t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(base, base[1:] + base[:1], strict=True)]))
    assert abs(cut_.mean() - 2 / 3) < 0.05


def expected(rows):
    """(id, n_chars, sha, print, edited print, likenesses) of rows with ids, in descending order."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (id_, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        a, b, c = edit_prints.prints([text, edited, after])
        out.append((id_, len(text), hashlib.sha256(edited.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), float((a == b).mean()), float((a == c).mean())))
    return sorted(out)


def table(df):
    return sorted((r["id"], r["n_chars"], r["edited_sha256"], bytes(r["print"]).hex(), bytes(r["edited_print"]).hex(), r["near_edited"], r["near_next"]) for r in df.collect())


@pytest.mark.parametrize("block", [edit_prints.BLOCK_BYTES, 3000])
def test_next_documents(spark, rows, block, monkeypatch):
    monkeypatch.setattr(edit_prints, "BLOCK_BYTES", block)
    monkeypatch.setattr(edit_prints, "GROUP", 9000)
    own = list({r[0]: r[:2] for r in rows if r[0] is not None}.values())
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    assert table(edit_prints.edited_prints(df)) == expected(own)


def test_hot_and_null_ids_keep_their_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(edit_prints, "BLOCK_BYTES", 2000)
    many = [(r[0] if i % 3 else 7 if i % 2 else None, r[1]) for i, r in enumerate(rows)]
    got = edit_prints.edited_prints(spark.createDataFrame(many, "doc_id long, text string").repartition(3)).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted(((r["id"], r["n_chars"]) for r in got), key=lambda x: (key(x[0]), x[1])) == sorted(((i, len(t or "")) for i, t in many), key=lambda x: (key(x[0]), x[1]))
    assert {bytes(r["print"]) for r in got} == {bytes(p) for p in edit_prints.prints([t or "" for _, t in many])}


def test_blocks_keep_the_order():
    rng = np.random.default_rng(0)
    key, mark = rng.integers(-9, 9, 4000), rng.integers(0, 1 << 63, 4000, dtype=np.uint64).astype(np.int64)
    order = np.lexsort((mark, key))
    for bounds in ([], [0], [-3, 2, 2, 2, 2, 5], [1] * 9, [-9, -9, 8, 8]):
        block = edit_prints.block_of(np.array(bounds, np.int64), key[order], mark[order])
        assert (np.diff(block) >= 0).all() and block.min() >= 0 and block.max() <= len(bounds)
    assert len(set(edit_prints.block_of(np.array([1] * 9), np.full(4000, 1), mark).tolist())) == 9


@pytest.mark.parametrize("bucket", [edit_prints.BUCKET, 3])
def test_classes_are_those_of_pairs_that_share_a_band(spark, bucket):
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randint(60, 300))
        texts += [base, base]
        for _ in range(4):
            at = rng.randrange(len(base))
            texts.append(base[:at] + rng.choice(["", "x", "yz"]) + base[at + 1 :])
    texts += [prose(rng, 80) for _ in range(30)] + ["", "", " "]
    rng.shuffle(texts)
    made = edit_prints.prints(texts)
    keys = edit_prints._keys(made)
    lab = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if lab[i] != lab[j] and (keys[i] == keys[j]).any() and (made[i] == made[j]).mean() >= edit_prints.LIKENESS or texts[i] == texts[j]:
                lab = [min(lab[i], lab[j]) if x in (lab[i], lab[j]) else x for x in lab]
    df = cut(spark.createDataFrame([(i, bytes(p)) for i, p in enumerate(made)], "id long, print binary").repartition(3), "test-prints")
    got = {r["id"]: r["class_id"] for r in edit_prints.classes(df, bucket=bucket).collect()}
    assert len(set(lab)) < 75
    assert got == dict(enumerate(lab))


def test_query_and_no_rows(spark, docs, clashing, nothing):
    got = edit_prints.query(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"]
    found = {r["doc_id"]: r for r in got.collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert [tuple(found[e[0]])[:7] for e in expected([tuple(r) for r in rows])] == expected([tuple(r) for r in rows])
    first = {}
    for r in sorted(rows):
        first.setdefault(r["text"], r["doc_id"])
    assert all(found[r["doc_id"]]["class_id"] <= first[r["text"]] for r in rows)
    assert edit_prints.edited_prints(nothing).collect() == []
    assert edit_prints.edited_prints(docs).count() == edit_prints.edited_prints(clashing).count() == docs.count()
