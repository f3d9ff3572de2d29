import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


def rows_of(pdf):
    """Columns in order of name, rows as sorted text."""
    import math

    def form(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return repr([form(x) for x in v])
        if v is None or isinstance(v, float) and math.isnan(v):
            return "None"
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(form, r)) for r in pdf[cols].astype(object).itertuples(index=False))
