"""The pipeline's stages against what brute force leaves."""

import collections
import os

import pytest

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_stages_chain_and_keep_columns(spark, tmp_path):
    import corpus_pipeline as P
    from test_free_style import brute_components
    from test_native import naive_hits, naive_pii

    from tracewell.llm import simhash
    from tracewell.llm.common import table

    docs = table(spark, SMALL, "documents")
    out = {}
    for name, stage in P.STAGES:
        found = stage(spark, docs, SMALL)
        found.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = (before.collect(), docs.collect())
        if name != "pack":
            assert docs.columns == table(spark, SMALL, "documents").columns
    before, after = out["quality"]
    assert 0.5 * len(before) < len(after) <= len(before)
    before, after = out["deduplicate"]
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in before}
    comp = brute_components(sorted(set(fps.values())))
    least = collections.defaultdict(list)
    for d, fp in fps.items():
        least[comp[fp]].append(d)
    assert sorted(r["doc_id"] for r in after) == sorted(min(v) for v in least.values())
    before, after = out["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not naive_hits(r["text"], items)[-1])
    before, after = out["redact"]
    text = {r["doc_id"]: r["text"] for r in after}
    assert len(before) == len(after) and not any(naive_pii(t) for t in text.values())
    assert all(text[r["doc_id"]] == r["text"] for r in before if not naive_pii(r["text"]))
    packed = collections.Counter(r["doc_id"] for r in out["pack"][1])
    assert set(packed) == set(text)


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P
    from cases import documents, stored

    docs = stored(documents(spark), tmp_path)
    for name, stage in P.STAGES:
        found = stage(spark, docs, SMALL)
        found.write.parquet(f"{tmp_path}/{name}")
        none = stage(spark, docs.where("doc_id < 0"), SMALL)
        assert none.count() == 0
        if name == "pack":
            assert found.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
        else:
            assert found.columns == docs.columns == none.columns and 0 < spark.read.parquet(f"{tmp_path}/{name}").count() <= docs.count()
            docs = spark.read.parquet(f"{tmp_path}/{name}")
