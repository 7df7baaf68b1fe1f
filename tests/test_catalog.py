"""Every query against its SQL oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessella.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def lines(df: pd.DataFrame) -> list[str]:
    def show(v):
        if v is None or pd.isna(v):
            return "NULL"
        return f"{float(v):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted("|".join(show(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert lines(got.toPandas()) == lines(duck.sql(ORACLES[name]).df())
    else:
        assert got.count() > 0


def test_entry_imports_without_the_training_data_package(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fuse_clips' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
