import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    out = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(data).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return normal(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    if isinstance(v, dict):
        return tuple(sorted((k, normal(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame has the rows of a SQL text, in any order."""

    def check(df, sql):
        got = [r.asDict(True) for r in df.collect()]
        cur = duck.execute(sql)
        cols = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(cols)
        names = sorted(cols)
        key = lambda rows: sorted((tuple(normal(r[c]) for c in names) for r in rows), key=repr)
        assert key(got) == key(dict(zip(cols, r, strict=True)) for r in cur.fetchall())
        return got

    return check
