"""The whole pipeline on odd rows and on an empty table, and the seed of the mix."""

import corpus_pipeline
from tidemark.llm import mixing

SMALL = "/root/testdata/sf0.001"


def _folder(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_keep_the_columns_and_take_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "z", 0), (-2, "word", None, None, 4), (-2, "word", None, None, 4)], docs.schema)
    sf = _folder(spark, tmp_path, docs.unionByName(odd).selectExpr("*", "1 AS row", "2 AS h", "3 AS size"))
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rows, sf)
        assert got.columns == rows.columns, name
        assert 0 < got.count()
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert (got.length == got.text.str.encode("utf-8").map(lambda t: len(t.split()))).all() and (got.groupby("bin_id").length.sum() <= 8192).all()


def test_no_documents_give_no_rows(spark, tmp_path):
    sf = _folder(spark, tmp_path, spark.read.parquet(f"{SMALL}/documents.parquet").limit(0))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_another_seed_takes_other_words_of_the_same_number(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, same, other = (mixing.mix(docs, seed=s).toPandas().sort_values("doc_id", ignore_index=True) for s in (1, 1, 2))
    assert (one.taken == same.taken).all() and (one.taken != other.taken).any()
    assert one.groupby("source").taken.sum().to_dict() == other.groupby("source").taken.sum().to_dict()
