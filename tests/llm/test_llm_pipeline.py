"""The pipeline on documents with planted cases, and the queries' SQL."""

import random

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from wellspring.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert differences(ours, connect(SF).execute(SQL[name]).df()) == []


def test_stages(spark, tmp_path):
    rnd = random.Random(8)

    def prose(n):
        return " ".join(f"w{rnd.randint(0, 900)}" for _ in range(n))

    clean = [(i, prose(rnd.randint(60, 300))) for i in range(200)]
    junk = [(1000 + i, " | ".join(prose(100).split())) for i in range(30)]
    copies = [(2000 + i, clean[i][1]) for i in range(5)] + [(3000 + i, clean[i][1] + " x") for i in range(5)]
    passage = prose(70)
    carriers = [(4000 + i, f"{prose(80)} {passage} {prose(80)}") for i in range(4)]
    secret = (5000, f"{prose(60)} password=abcdefgh1234 {prose(60)}")
    rows = [(*r, "en", None, len(r[1]), "x") for r in [*clean, *junk, *copies, *carriers, secret]]
    rows += [(6000, None, None, None, None, "x"), (None, prose(90), "en", "s", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    docs = spark.createDataFrame(rows, schema)
    labelled = [(i, 1, 0) for i, _ in clean[::2]] + [(i, 0, 0) for i, _ in junk[::2]]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
    left = {r.doc_id: r for r in out.collect()}
    assert len({i for i, _ in clean} & set(left)) >= 198
    assert not {i for i, _ in junk} & set(left) and not {i for i, _ in copies} & set(left)
    assert sum(passage in left[i].text for i, _ in carriers if i in left) == 1
    assert "[assign]" in left[5000].text and "abcdefgh1234" not in left[5000].text
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(left)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
