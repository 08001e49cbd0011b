import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.odd import DIR, odd, table
from tests.llm.test_exact_dedup import lowered
from tests.llm.test_simhash import brute_classes, brute_print


def test_stages_and_run(spark, tmp_path):
    docs, columns, kept = table(spark, "documents"), table(spark, "documents").columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == columns and after.schema == docs.schema
        kept.append((docs.collect(), after.collect()))
        docs = after
    before, after = kept[1]
    assert len({lowered(r.text) for r in before}) == len(after) == len({lowered(r.text) for r in after})
    before, after = kept[2]
    classes = brute_classes([(r.doc_id, brute_print(r.text)) for r in before])
    assert {r.doc_id for r in after} == set(classes)
    before, after = kept[4]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    whole = entry.queries()["pipeline"](spark, DIR)
    assert sorted((r.doc_id, r.piece, r.length) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.length) for r in kept[4][1])


def test_stages_take_odd_rows(spark, tmp_path):
    docs = odd(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark, []), DIR).collect() == []


def test_one_query_per_operator():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
