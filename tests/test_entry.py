import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SMALL):
        pytest.skip("the small tables are not there")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows_of(frame):
    cols = sorted(frame.columns)
    return cols, sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(entry.queries()[name](spark, SMALL).toPandas()) == rows_of(duck.sql(entry.oracle_sql()[name]).df())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0].separation > 0


def test_entry_works_without_the_subpackage(tmp_path):
    """With the pipeline and its subpackage gone, the entry imports and has the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/pointloom", f"{root}/__spark_entry__.py", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/pointloom/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'separation' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_entry_works_without_modules_of_the_subpackage(tmp_path):
    """Where a library that only the subpackage needs is missing, the other queries are there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'separation' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, check=True)
