"""Corpus counts of 2**32 and more, and messages of packs and buckets."""

import numpy as np
import pyarrow as pa
import pytest

from sondera.llm import chunks, scoring


def asked(messages):
    """A bucket's questions: (chunk, kind, keys, counts) for order 1, and nothing of the other orders."""
    rows = []
    for chunk, kind, keys, counts in messages:
        keys, counts = np.array(keys, np.uint64), np.array(counts, np.uint64)
        rows.append((0, chunk, kind, [len(keys), 0, 0], [chunks.planes(chunks.deltas(keys), counts), chunks.planes(), chunks.planes()]))
    return scoring._table(list(zip(*rows, strict=True)), scoring._ASKED)


@pytest.mark.parametrize("repeats", [1, 4])
def test_counts_pass_32_bits(repeats):
    most = 2**32 - 1
    told = scoring._tell(asked([(c, 0, [5, 7, 900], [most, 1, 3]) for c in range(repeats)] + [(9, 1, [7, 8], [most, most]), (10, 2, [5, 11], [4, 4])]))
    of = lambda c: told.filter(pa.compute.equal(told.column("chunk"), c))
    assert scoring._answers(of(0), 1, 3).tolist() == [repeats * most, repeats + most, 3 * repeats]
    assert scoring._answers(of(9), 1, 2).tolist() == [repeats + most, most]
    assert scoring._answers(of(9), 1, 2, kept=True).tolist() == [repeats, 0]
    assert scoring._answers(of(10), 1, 2).tolist() == [repeats * most, 0]
    total = of(-1).to_pylist()[0]
    assert (total["total"], total["v"], total["n_kept"], total["v_kept"]) == (repeats * (most + 4) + 2 * most, 4, repeats * (most + 4), 3)


def test_planes_give_back_what_was_put_in():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        a, b = rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 3, n, dtype=np.uint64)
        got = chunks.from_planes(chunks.planes(a, b), n)
        assert n == 0 or ((got[0] == a).all() and (got[1] == b).all())


def test_packs_hold_every_row(docs, rows):
    from collections import Counter

    packed = chunks.packs(docs, "doc_id", "text", 2000).toArrow()
    found = [chunks.opened(packed, i) for i in range(len(packed))]
    assert len(found) > 10 and len({f[0] for f in found}) == len(found)
    assert Counter((i, t.decode()) for f in found for i, t in zip(f[2], f[3], strict=True)) == Counter((i, t or "") for i, t, _ in rows)
