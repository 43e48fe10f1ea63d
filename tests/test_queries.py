"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from lodestack.plans import index_queries, registry

FOLDER = "/root/testdata/sf0.001"
assert index_queries.QUERIES is registry.QUERIES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(records, columns):
    value = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[c]) for c in columns) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert rows(df.collect(), columns) == rows([dict(zip(names, r, strict=True)) for r in result.fetchall()], columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_reruns_agree(spark, name):
    one, two = (registry.QUERIES[name](spark, FOLDER) for _ in range(2))
    columns = sorted(one.columns)
    first = rows(one.collect(), columns)
    assert first and first == rows(two.collect(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lodestack", tmp_path / "lodestack", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) == len(registry.QUERIES)
