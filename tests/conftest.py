import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _plain(v):
    import datetime
    import decimal

    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v) + 0.0:.9g}"
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return str(v.date())
    return str(v)


@pytest.fixture(scope="session")
def same(spark, duck, sf):
    """Compare a Spark query with its SQL: same columns, same rows in any order."""

    def check(query, sql):
        df = query(spark, sf)
        names = sorted(df.columns)
        got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
        cur = duck.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == names
        at = [columns.index(c) for c in names]
        want = sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
        assert len(got) == len(want)
        assert got == want

    return check
