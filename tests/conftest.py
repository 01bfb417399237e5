"""One session for all tests, and the test tables for SQL."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))

DATA = Path(os.environ.get("LEXIARC_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test tables")
    return str(folder)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return db


def same_rows(left, right) -> None:
    """Both frames have the same columns and, in any order, the same rows."""
    import pandas as pd

    def one(x) -> str:
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return "NULL"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if type(x).__name__.startswith("float"):
            return f"{float(x):.6f}" if float(x) != int(x) else str(int(x))
        return str(x)

    assert sorted(left.columns) == sorted(right.columns)
    rows = [sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)) for df in (left, right)]
    assert rows[0] == rows[1]


@pytest.fixture(scope="session")
def compare():
    return same_rows
