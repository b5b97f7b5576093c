import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeats", "mixture", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    got = P.run(spark, SF).collect()
    assert got and {r["doc_id"] for r in got} <= before
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (docs.limit(0), docs.filter("doc_id % 4 = 0")):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, rows, SF).columns == docs.columns
