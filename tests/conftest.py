import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from seqloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(value):
    """Values of Spark and DuckDB in one form."""
    import numpy as np

    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    return plain(value.item()) if hasattr(value, "item") else value


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, data):
    def check(query, sql):
        df = query(spark, data)
        cols = sorted(df.columns)
        ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        got = duck.execute(sql)
        names = [x[0] for x in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
        assert ours == theirs

    return check
