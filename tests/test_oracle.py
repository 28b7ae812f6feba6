"""Every query of the catalogue against its SQL on the smallest driver tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallysheet.plans import catalog, codes, more, pixels, regions  # noqa: F401  all add to one registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    out = df[sorted(df.columns)].map(one)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_matches_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in catalog.ORACLE_SQL:
        want = con.sql(catalog.ORACLE_SQL[name]).df()
        pd.testing.assert_frame_equal(normal(got), normal(want))
