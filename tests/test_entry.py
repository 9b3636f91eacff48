import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from formweave.plans import forms, oracle

DATA = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(frame):
    import pandas as pd

    columns = sorted(frame.columns)
    show = lambda v: "" if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted(tuple(map(show, r)) for r in frame[columns].astype(object).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert plain(forms.queries()[name](spark, DATA).toPandas()) == plain(con.sql(oracle.oracle_sql()[name]).df())


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 7500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(f"{HERE}/formweave", tmp_path / "formweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(forms.queries())), str(len(oracle.oracle_sql())), "False"]
