import os
import shutil
import subprocess
import sys

import pytest

import corpus_pipeline
from formweave.llm import langid, linededup, mixing, simhash


@pytest.fixture(scope="module")
def sf_dir(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_follow_each_other(spark, docs, sf_dir):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, sf_dir)
        assert now.columns == docs.columns, name
        rows, was = now.collect(), before.collect()
        if name == "language_id":
            scored = langid.predict(before, langid.train(before, before.doc_id.isNotNull())).collect()
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in scored if not r.rejected)
            assert {r.doc_id for r in was if r.text and r.lang and len(r.text) > 40} <= {r.doc_id for r in rows}
        elif name == "line_dedup":
            wanted = {r.doc_id: r.text for r in linededup.dedup_lines(before).collect()}
            assert {r.doc_id: r.text for r in rows} == wanted and all(r.n_chars == len(r.text) for r in rows if r.text != {x.doc_id: x.text for x in was}[r.doc_id])
        elif name == "near_dedup":
            comps = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(set(comps.values()))
        else:
            taken = {r.doc_id: r.epochs for r in mixing.mix(before).collect()}
            assert len(rows) == sum(taken.values())
        now = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    assert sorted(r.doc_id for r in last if r.piece == 0) == sorted(r.doc_id for r in now.collect())


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_empty_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_broken_subpackage_is_an_error(tmp_path):
    here = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{here}/formweave", tmp_path / "formweave", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run().stdout.split() == ["True"]
    broken = tmp_path / "formweave/llm/queries.py"
    broken.write_text(broken.read_text().replace("from pyspark.sql import DataFrame", "import a_library_that_is_not_there\nfrom pyspark.sql import DataFrame", 1))
    assert "a_library_that_is_not_there" in run().stderr
    shutil.rmtree(tmp_path / "formweave/llm")
    assert run().stdout.split() == ["False"]
