import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from varloom.session import local_session

    s = local_session(4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows_of(df):
    """Rows in a form that is equal for both engines: columns by name, nulls and NaN marked, numbers as floats."""
    cols = sorted(df.columns)

    def one(v):
        try:
            if v is None or v != v:
                return "~"
        except (TypeError, ValueError):
            return "~"
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(one(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)
