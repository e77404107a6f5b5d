import subprocess
import sys

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        left = step(spark, seen, SF)
        assert left.columns == docs.columns and left.join(seen, "doc_id", "left_anti").count() == 0
        seen = left.cache()
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == \
        {r.doc_id for r in seen.select("doc_id").collect()}


def test_stages_on_edge_cases(spark, edge, nothing):
    for docs in (edge, nothing):
        for _, step in corpus_pipeline.STAGES:
            out = step(spark, docs, SF)
            assert out.count() <= 2 * docs.count() + 100


def test_registered(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op") and "_" in n and n[2].isdigit()]
    assert len(names) == 13 and "pipeline" in entry.queries()


def test_the_rest_does_not_import_this_subpackage():
    code = ("import sys; sys.modules['churnlens.llm'] = None; sys.modules['corpus_pipeline'] = None; "
            "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 50")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
