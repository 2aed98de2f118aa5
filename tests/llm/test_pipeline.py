

import corpus_pipeline
from millrace.llm import packing, quality_model, quality_rules
from millrace.llm.common import table
from millrace.session import store

from tests.llm.test_operators import check_packing, plain_components, plain_fingerprint


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    kept = store(corpus_pipeline.rules(spark, docs, sf), "stage")
    good = {r["doc_id"] for r in quality_rules.ruled(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good and kept.columns == docs.columns
    better = store(corpus_pipeline.classifier(spark, kept, sf), "stage")
    fine = quality_model.scored(docs, table(spark, sf, "labels")).filter("predicted = 1")
    assert {r["doc_id"] for r in better.collect()} == good & {r["doc_id"] for r in fine.collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    long = {r["doc_id"] for r in docs.collect() if len(r["text"].split()) >= 50}
    clean = {i for i, q in labels.items() if q and i in long}
    assert len(clean & {r["doc_id"] for r in better.collect()}) >= 0.97 * len(clean)
    single = store(corpus_pipeline.near_duplicates(spark, better, sf), "stage")
    want = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in better.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(want.values()))
    mixed = store(corpus_pipeline.mix(spark, single, sf), "stage")
    assert mixed.columns == docs.columns and mixed.count() >= single.count()
    rows = corpus_pipeline.pack(spark, mixed, sf).collect()
    check_packing(mixed, rows, packing.CAPACITY)
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
