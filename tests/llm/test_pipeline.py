import corpus_pipeline
from plumeline.llm import near_dedup


def test_stages_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    all_ids = {r.doc_id for r in docs.select("doc_id").collect()}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in left.collect()}
        out = stage(spark, left, sf)
        assert out.columns == docs.columns, name
        after = {r.doc_id: r.text for r in out.collect()}
        assert after.items() <= before.items()
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(" ".join(before[i].split()), i)
            assert set(after) == set(first.values())
        left = spark.createDataFrame(out.collect(), docs.schema)
    assert near_dedup.near_duplicates(left).where("not kept").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, sf)
    assert {r.doc_id for r in pieces.collect()} == set(after) <= all_ids


def test_empty_tables_and_further_columns_pass_through(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.selectExpr("*", "'x' AS readable", "1 AS maybe_in", "2 AS asked", "3 AS hash", "4 AS item_id", "5 AS tokens")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.limit(0), sf).collect() == [], name
        out = stage(spark, odd.where("doc_id < 60"), sf)
        assert out.columns == odd.columns and {tuple(r)[-6:] for r in out.collect()} == {("x", 1, 2, 3, 4, 5)}, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf).collect() == []
