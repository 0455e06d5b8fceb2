"""Every registered query against its SQL at the smallest scale."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_check_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("without", [["sitelake/llm", "tests/llm"], ["sitelake/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_works_without_the_training_data_operators(tmp_path, without):
    root = Path(contract.__file__).resolve().parent
    left = {str(root / name) for name in without}

    def ignored(folder, names):
        return [n for n in names if str(Path(folder) / n) in left or n in (".git", "__pycache__")]

    shutil.copytree(root, tmp_path / "repo", ignore=ignored)
    said = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "repo"), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", said], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    names, checks = (set(line.split()) for line in done.stdout.strip().splitlines()[-2:])
    rest = {n for n in QUERIES if not re.match(r"op\d+_|pipeline$", n)}
    assert names == rest and checks == rest & set(ORACLE)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        result = sql.sql(ORACLE[name])
        assert got == rows_of(list(result.columns), result.fetchall())
    else:
        assert got[1]
