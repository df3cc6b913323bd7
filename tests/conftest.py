import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ.setdefault("OMP_NUM_THREADS", "1")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir, duck):
    """Runs a query and its SQL on the same tables and compares all rows."""
    plain = lambda v: None if isinstance(v, float) and v != v else v

    def compare(query, sql):
        frame = query(spark, sf_dir)
        columns = sorted(frame.columns)
        ours = sorted((tuple(map(plain, r)) for r in frame.select(columns).collect()), key=repr)
        answer = duck.execute(sql)
        names = [d[0] for d in answer.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=repr)
        assert ours == theirs

    return compare
