"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import os
import subprocess
import sys
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TRACELOOM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    yield con
    con.close()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (datetime, date)):
        return str(x)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    wanted = duck.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, wanted.fetchall())


def test_every_query_has_sql_or_is_known_to_have_none():
    none: set[str] = set()
    llm = {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()} | {"pipeline"}
    assert set(entry.queries()) - set(SQL) - llm == none


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_llm_is_optional():
    """Without the subpackage and the pipeline the entry imports and has the library's queries alone."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('traceloom.llm', 'corpus_pipeline'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert names == set(e.oracle_sql()), names ^ set(e.oracle_sql())\n"
        "print(len(names), sum(n.startswith('op') and n[2].isdigit() for n in names), 'pipeline' in names)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=False)
    assert found.returncode == 0, found.stderr
    n, ours, pipeline = found.stdout.split()
    assert int(n) > 100 and (ours, pipeline) == ("0", "False")
