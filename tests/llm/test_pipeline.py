import corpus_pipeline

from millrace.llm import decontamination, simhash
from millrace.llm.shared import Scratch

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scratch, columns, before = Scratch(spark, "test_pipeline"), docs.columns, docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.write(stage(spark, docs, SMALL), name)
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
        if name == "simhash_dedup":
            prints = simhash.near_duplicates(docs, max_bits=simhash.STAGE_BITS)
            assert prints.where("doc_id <> component_id").count() == 0
        if name == "decontamination":
            left = decontamination.find_passages(docs.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))
            assert left.where("size(hits) > 0").count() == 0
    assert docs.where("not round_trip").count() == 0
    a = sorted(map(repr, corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens").collect()))
    assert a == sorted(map(repr, docs.select("doc_id", "n_tokens").collect()))


def test_odd_rows(spark, odd_documents):
    docs, scratch = odd_documents, Scratch(spark, "test_pipeline")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, SMALL), name)
    assert docs.count() > 0
    empty = odd_documents.where("false")
    for name, stage in corpus_pipeline.STAGES:
        empty = scratch.write(stage(spark, empty, SMALL), f"{name}_of_nothing")
    assert empty.count() == 0
