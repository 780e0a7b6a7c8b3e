"""Every query with SQL against DuckDB at the smallest scale; the entry module without its optional part."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA), duck.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).first().asDict() == {"matches": 152, "revenue": 42_964_675}
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_training_part(tmp_path):
    """The folders of the training-data part and its pipeline deleted: the rest imports, registers and runs."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = f"""
import sys
import __spark_entry__ as e
q = e.queries()
assert 'q6_revenue' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(e.oracle_sql()) == set(q)
assert not [m for m in sys.modules if m.startswith('tessera.llm')]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert q['native_logic'](spark, '{DATA}').count() == 1 and e.entry(spark).count() == 1
print(len(q))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) == len(catalogue.QUERIES)
