"""Held-out accuracy of the trained models, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnwork.llm import jaccard, queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label"), [("op5_quality_cnn", "quality"), ("op6_toxicity_trees", "toxic")])
def test_held_out(spark, name, label):
    s = queries.queries()[name](spark, DATA)
    m = s.where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    assert len(m) > 50 and (m.predicted == m[label]).mean() > 0.93
    assert s.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(400)
    columns = docs.columns
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], DATA)
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in kept[:5]]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4]
    c = jaccard.jaccard_components(kept[2])
    assert {r["doc_id"] for r in c.where("doc_id = component_id").collect()} == ids[3]
    again = kept[4].groupBy("doc_id").count()
    assert again.where("count > 2").count() == 0
    tokens = kept[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).join(again, "doc_id")
    assert tokens.where("n <> t * count").count() == 0 and tokens.count() == len(ids[4])


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_stages_by_plain_versions(spark):
    """Each stage's decision, taken again from its operator's scores, components and counts, on odd rows and clashing names."""
    from cairnwork.llm import cnn, mixing, toxicity
    from cairnwork.llm.common import table

    base = spark.read.parquet(f"{DATA}/documents.parquet").limit(250)
    odd = base.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "n_chars")
    docs = base.union(base.limit(5)).union(odd).selectExpr("*", "1 AS score_of_stage", "2 AS row_number_of_this_stage", "3 AS copy_of_stage", "4 AS copies_of_stage", "5 AS component_id").cache()
    rows = docs.toPandas()
    labels = table(spark, DATA, "labels")
    quality, toxic, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    key = lambda d: sorted(zip(d.doc_id.fillna(-1), d.text.fillna("")))
    for stage, keep in ((quality, cnn.train(docs, labels).score(list(rows.text.where(rows.text.notna(), None))) >= 0.5), (toxic, toxicity.train(docs, labels).score(list(rows.text.where(rows.text.notna(), None))) < 0.5)):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and key(out.toPandas()) == key(rows[keep])
    out = near(spark, docs, DATA).toPandas()
    c = jaccard.jaccard_components(docs).toPandas()
    assert sorted(out.doc_id.dropna()) == sorted(c.component_id.dropna().unique()) and out.doc_id.isna().sum() == 1
    out = mix(spark, docs, DATA)
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").toPandas()
    again = out.groupBy("doc_id").count().toPandas()
    assert out.columns == docs.columns and dict(zip(copies.doc_id, copies.n)) == dict(zip(again.doc_id, again["count"]))
    assert pack(spark, docs, DATA).where("start = 0").count() == len(rows)


def test_run_leaves_one_folder(spark):
    from cairnwork.llm.common import checkpoint_folder

    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before = {str(f.getPath()) for f in fs.listStatus(path)}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    new = [f.getPath() for f in fs.listStatus(path) if str(f.getPath()) not in before and "rdd-" not in f.getPath().getName()]
    assert len(new) == 1 and [f.getPath().getName() for f in fs.listStatus(new[0])] == ["3"]
