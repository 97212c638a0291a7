import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    top = tmp_path_factory.mktemp("spark")
    settings = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.sql.warehouse.dir": f"{top}/warehouse", "spark.checkpoint.dir": f"{top}/shared", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[8]").config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A function that answers SQL over a folder of the driver's tables."""
    import duckdb

    def ask(sql: str, sf: str = "sf0.001"):
        con = duckdb.connect()
        for f in sorted((DATA / sf).glob("*.parquet")):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        out = con.execute(sql)
        names = [d[0] for d in out.description]
        return names, out.fetchall()

    return ask


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Assert that a registered query and its SQL agree on columns and rows."""
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()

    def check(name: str, sf: str = "sf0.001") -> None:
        df = queries[name](spark, str(DATA / sf))
        assert table_of(df.columns, df.collect()) == table_of(*duck(oracle[name], sf))

    return check
