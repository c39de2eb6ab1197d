import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    """Sorted rows with columns by name; doubles to nine digits, missing values as None."""

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "item"):
            return f"{float(v) + 0.0:.9g}"
        if hasattr(v, "isoformat"):
            return v.isoformat().removesuffix("T00:00:00")
        return str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def agree(spark, duck):
    def check(query, sql):
        a, b = query(spark, SF).toPandas(), duck.execute(sql).fetchdf()
        assert sorted(a.columns) == sorted(b.columns)
        x, y = (sorted(map(repr, rows_of(d))) for d in (a, b))
        assert len(x) == len(y)
        wrong = [(i, j) for i, j in zip(x, y) if i != j]
        assert not wrong, wrong[:3]
        return len(a)

    return check
