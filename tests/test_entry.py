"""The driver contract holds, with and without the document operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from leadtime import plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ("flagship", "resample_argmax", "lag_window_masks", "missing_intervals", "clean_features", "asof_nearest_segmented", "event_groups", "split_assign", "skill_scores", "histogram", "src_samples_csv")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.oracle_sql()) <= set(plans.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = plans.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    expected = con.sql(plans.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    assert sorted((repr([plain(r[c]) for c in columns]) for r in got.collect())) == sorted(repr([plain(r[i]) for i in order]) for r in expected.fetchall())


def test_entry_imports_without_the_document_operators(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "leadtime", tmp_path / "leadtime", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(k[:2] == 'op' and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
