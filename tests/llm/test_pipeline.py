"""The pipeline's stages on a small corpus with every odd row."""
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_stage_keeps_columns_and_rows_in_kind(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(1)).withColumn("class_id", F.lit(0.5))
    odd = docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    odd = odd.union(docs.limit(1).withColumn("text", F.lit(""))).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(1))
    docs = docs.union(odd).cache()
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        assert out.exceptAll(docs).count() == 0, name
        sizes.append(out.count())
        docs = out
    assert sizes[1] == sizes[0] - 2 and sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    pieces = P.STAGES[-1][1](spark, docs, SF).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096
    assert pieces.doc_id.nunique() == docs.select("doc_id").distinct().filter("doc_id is not null").count()


@pytest.mark.parametrize("k", range(5))
def test_empty_corpus(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert P.STAGES[k][1](spark, docs, SF).count() == 0
