"""Every query against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from cadastra.plans import registry
from cadastra.session import TABLES


@pytest.fixture(scope="module")
def oracle(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


def shaped(values, order):
    return sorted((tuple("nan" if isinstance(row[i], float) and math.isnan(row[i]) else repr(row[i]) for i in order) for row in values))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, small_dir, name):
    df = registry.QUERIES[name](spark, small_dir)
    rows = df.collect()
    if name in registry.ORACLE_SQL:
        want = oracle.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert shaped(rows, range(len(df.columns))) == shaped(want.fetchall(), [want.columns.index(c) for c in df.columns])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for item in ("__spark_entry__.py", "cadastra"):
        source = root / item
        if source.is_dir():
            for file in source.rglob("*.py"):
                if "llm" not in file.relative_to(root).parts:
                    target = tmp_path / file.relative_to(root)
                    target.parent.mkdir(parents=True, exist_ok=True)
                    target.write_text(file.read_text())
        else:
            (tmp_path / item).write_text(source.read_text())
    done = subprocess.run([sys.executable, "-c", "import re, __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [n for n in q if re.match(r'op\\d+_', n)]; e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
