"""The pipeline against its operators, stage by stage, and on empty and odd tables."""
import corpus_pipeline as pipeline
from claimlake.llm import language, leaks, lines, near


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = pipeline.language(spark, docs, folder)
    pred = language.classify(docs, *language.learn(docs))
    assert kept.columns == docs.columns and kept.count() == pred.where("lang_pred <> 'und' and score >= 0.5").count()
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    out = pipeline.lines(spark, kept, folder)
    assert out.dtypes == docs.dtypes and out.where("n_chars <> length(text)").count() == 0
    assert out.count() == lines.dedup_lines(kept).where("n_kept > 0 or n_lines = 0").count() < kept.count()
    out = pipeline.near(spark, kept, folder)
    assert out.count() == near.near_duplicates(kept, pipeline.NEAR).where("kept").count() < kept.count()
    out = pipeline.decontamination(spark, kept, folder)
    hit = leaks.find_leaks(kept, spark.read.parquet(f"{folder}/benchmark.parquet")).select("doc_id").distinct()
    assert out.count() == kept.count() - hit.count() < kept.count()


def test_run_packs_what_is_left(spark, folder):
    got = pipeline.run(spark, folder)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_empty_and_odd(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(1, None, None, None, None), (None, "some words of a text here", "en", "s", 1), (3, "", "en", "s", 0), (3, "12 34", "en", "s", 0)]
    for own in (docs.limit(0), spark.createDataFrame(rows, docs.schema)):
        for _, stage in pipeline.STAGES:
            stage(spark, own, folder).collect()


def test_texts_are_not_dealt_where_few_rows_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (pipeline.near, pipeline.decontamination):
        plan = stage(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_near_keeps_one_of_repeated_rows(spark, folder):
    text = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(5, text, "en"), (5, text, "en"), (5, text, "de"), (None, other, None), (None, other, None), (6, other + " end", "en"), (7, text + " end", "en"), (7, "no copy of any of the others here", "en"), (8, None, None), (8, None, None)]
    got = pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), folder).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, other), (5, text), (7, "no copy of any of the others here"), (8, ""), (8, "")]
