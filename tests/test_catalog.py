import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from marlstone import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, oracle, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got)
        return
    want = oracle.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ordered = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert ordered(got).equals(ordered(want))


def test_entry_stands_without_the_training_part():
    code = "import sys; sys.modules['marlstone.llm'] = None; import __spark_entry__ as e; n = list(e.queries()); assert 'search_bm25' in n and 'pipeline' not in n and not [x for x in n if x.startswith('op')], n; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)


def test_library_never_imports_the_training_part():
    root = Path(__file__).parents[1] / "marlstone"
    for source in root.rglob("*.py"):
        if "llm" not in source.relative_to(root).parts:
            assert "llm" not in source.read_text(), source
