"""Every query with an oracle gives the rows that DuckDB gives for it on sf0.001."""

import os

import duckdb
import pandas as pd
import pytest

from chronolex.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(frame):
    def value(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        return repr(round(x, 6) + 0.0) if isinstance(x, float) else x.isoformat() if hasattr(x, "isoformat") else str(x)

    return sorted("|".join(map(value, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    got = pd.DataFrame([tuple(r) for r in found.collect()], columns=found.columns, dtype=object)
    assert rows(got) == rows(pd.DataFrame(want.fetchall(), columns=columns, dtype=object))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"ablations"}))  # ablation_importance runs them
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0


def test_entry_modules_import_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
