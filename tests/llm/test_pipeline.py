"""Every stage of the pipeline against its rule."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from slicegrad.llm import spaced_seeds
from slicegrad.llm.common import saved
from slicegrad.llm.queries import table


def test_stages(spark, sf_dir):
    sf_dir = os.path.join(os.path.dirname(sf_dir), "sf0.01")  # the smallest tables have too few labels
    columns = table(spark, sf_dir, "documents").columns
    docs, kept = table(spark, sf_dir, "documents"), {}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = saved(stage(spark, docs, sf_dir), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    good = kept["quality classifier"]
    assert sum(labels[d] for d in good if d in labels) >= 0.95 * sum(labels.values())
    assert sum(labels.get(d) == 0 for d in good) <= 0.1 * sum(q == 0 for q in labels.values())
    single = table(spark, sf_dir, "documents").filter(F.col("doc_id").isin(kept["SimHash near-dedup"]))
    assert single.select("text").distinct().count() == single.count() == len(kept["SimHash near-dedup"])
    clean = table(spark, sf_dir, "documents").filter(F.col("doc_id").isin(kept["benchmark decontamination"]))
    assert spaced_seeds.contaminated(clean, table(spark, sf_dir, "benchmark")).count() == 0
    assert set(kept["mixing sources"]) <= set(kept["benchmark decontamination"])
    assert sorted(kept["token files"]) == sorted(kept["mixing sources"])
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept["token files"])


def test_stages_take_odd_rows_and_an_empty_table(spark, sf_dir):
    sf_dir = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    good = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, sf_dir, "documents").orderBy("doc_id").limit(400).collect()]
    long = "a long text without an end " * 20_000
    odd = [(None, "no id but a text of its own", "en", "web", 1), (-1, None, None, None, None), (-2, "", "en", None, 0), (-3, long, "en", "web", 1), (-3, long, "en", "web", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(good + odd, schema)
    for name in ("sg_k1", "sg_rank", "copy", "key", "score", "sg_row", "order"):
        docs = docs.withColumn(name, F.lit(3))
    columns = docs.columns
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows, _ = saved(stage(spark, rows, sf_dir), "odd-stage")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert rows.columns == columns and rows.filter("sg_k1 <> 3 or score <> 3 or copy <> 3").count() == 0
            if name == "SimHash near-dedup":
                kept = [(r.doc_id, r.text) for r in rows.collect()]
                assert len(set(t or "" for _, t in kept)) == len(kept)
        left = rows.count()
        assert left == 0 or left > 100
