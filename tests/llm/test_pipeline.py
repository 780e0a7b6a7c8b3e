"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
import pytest
from tests.llm import plain

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from tessera.llm.scratch import Scratch

    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(scratch.table(stage(spark, out[-1], DATA), str(k)))
    return out


def test_stages(spark, stages):
    docs, good, single, clean, mixed, shards = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = ids(good)
    assert all((labels[i] == 1) == (i in kept) for i in ids(docs) & set(labels))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert ids(single) == {c if n else i for i, n, c in plain.components(rows, 5, 4, 5)}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in single.collect()}
    leaked = {i for i, t in texts.items() if any(x in t for x in items)}
    assert ids(clean) == set(texts) - leaked
    assert ids(mixed) <= ids(clean) and mixed.count() == shards.count()
    assert [r.doc_id for r in shards.orderBy("shard", "slot").collect()] == sorted(r.doc_id for r in mixed.collect())


def test_run_agrees(spark, stages):
    again = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, stages[-1].collect()), key=repr)
