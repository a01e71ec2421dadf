import corpus_pipeline
from waymark.llm.queries import ORACLES, QUERIES


def test_queries_are_registered_once_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_pipeline_over_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    n = out.count()
    assert 0.7 * docs.count() < n <= docs.count() and out.select("doc_id").distinct().count() == n
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert frame.columns == docs.columns, name
