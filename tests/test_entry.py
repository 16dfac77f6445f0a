"""Each lookup query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from specweave.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{SF}/{file}')")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect())))
    assert rows == sorted(map(repr, (tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())))


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_without_training_data_operators(tmp_path):
    """The rest stands alone when their folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(driver.__file__).parent
    shutil.copytree(root / "specweave", tmp_path / "specweave", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) >= set(e.oracle_sql()) and 'answer_all' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_without_a_package_of_theirs():
    """The rest stands alone where their packages can't be imported."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(driver.__file__).parent)
    code = "import sys; sys.modules['regex'] = None; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert 'answer_all' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=root, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": root})
