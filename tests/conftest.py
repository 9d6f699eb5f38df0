import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


def same(spark, name, query, sql, sf=SF):
    """Whether a query and its SQL give the same rows, whatever their order."""
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names), name
    text = lambda v: "-" if v is None else f"{float(v):.9g}" if isinstance(v, float) else str(v)
    ours = sorted(tuple(text(r[c]) for c in names) for r in df.collect())
    theirs = sorted(tuple(text(v) for v in r) for r in cur.fetchall())
    assert ours == theirs, name
