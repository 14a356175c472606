"""Every registered query against its SQL counterpart, as the driver compares them."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from catalogspark.registry.queries import QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry_module.queries()[name](spark, SF_DIR)
    wanted = duck.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    left, right = sorted_rows(got.columns, [tuple(r) for r in got.collect()]), sorted_rows(columns, wanted.fetchall())
    assert len(left) > 0 and len(left) == len(right)
    assert left == right


def test_every_catalog_query_has_sql():
    assert set(QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_works_without_the_optional_operators(tmp_path):
    """A copy without the optional folder and its pipeline imports and keeps the other queries."""
    root = Path(entry_module.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "catalogspark", tmp_path / "catalogspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "catalogspark" / "llm" / "__pycache__").mkdir(parents=True)
    told = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
        cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)},
    )
    assert told.stdout.split() == [str(len(QUERIES))] * 2, told.stderr


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0
