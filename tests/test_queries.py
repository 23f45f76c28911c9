"""Every registered query of the library against its SQL on the smallest tables, and that it stands without the optional subpackage."""

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessera.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name in ORACLE_SQL:
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert mine == sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {quoted} FROM ({ORACLE_SQL[name]}) z").fetchall())


def test_entry_without_the_optional_subpackage():
    code = "import sys\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'pipeline' not in e.queries() and 'q_feed' in e.queries() and not [n for n in sys.modules if n.startswith('tessera.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
