import corpus_pipeline


def test_stages_keep_the_columns(spark):
    sf, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    n = out.groupBy("sequence_id").sum("length").collect()
    assert n and max(r[1] for r in n) <= 2048
