import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.checkpoint.dir", f"{shared}/checkpoint")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def compare(spark, sf):
    """Run a registered query and its SQL over sf0.001 and hold their rows against each other."""
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")

    def plain(x):
        return round(float(x), 6) if isinstance(x, float) else x

    def run(name):
        frame = __spark_entry__.queries()[name](spark, sf)
        columns = sorted(frame.columns)
        mine = sorted([tuple(map(plain, r)) for r in frame.select(*columns).collect()], key=repr)
        table = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        theirs = sorted([tuple(map(plain, r)) for r in table], key=repr)
        assert mine == theirs

    return run
