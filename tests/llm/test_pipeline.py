"""The pipeline's stages on the smallest tables, and what each has to hold."""

from collections import Counter

import pytest

import corpus_pipeline
from sondera.llm import exact_dedup, quality
from sondera.llm.common import cut, documents

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, D), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, D), "test")
        out[name] = docs
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mixing", "packing"]
    assert all(stages[n].columns == stages["input"].columns for n in ("quality rules", "exact dedup", "near dedup", "source mixing"))


def test_every_stage_takes_effect(stages):
    ids = lambda n: Counter(r["doc_id"] for r in stages[n].select("doc_id").collect())
    judged = quality.judged(stages["input"].select("doc_id", "text"))
    assert ids("quality rules") == Counter(r["doc_id"] for r in judged.where("kept").collect())
    texts = [r["text"] for r in stages["exact dedup"].collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] for r in stages["quality rules"].collect()})
    assert set(ids("near dedup")) <= set(ids("exact dedup")) and set(ids("source mixing")) <= set(ids("near dedup"))
    assert {r["doc_id"] for r in stages["packing"].collect()} == set(ids("source mixing"))


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, D)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, got.select(cols).collect())) == Counter(map(tuple, stages["packing"].select(cols).collect()))


def test_exact_stage_keeps_one_of_each(spark):
    docs = documents(spark, D)
    kept = exact_dedup.stage(spark, docs, D)
    assert kept.count() == docs.select("text").distinct().count()
