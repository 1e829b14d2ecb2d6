"""Every query of the subpackage: those with SQL give its rows, the others one row per document."""

import pytest

from tablelens.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        assert differences(df, connect(sf), ORACLE[name]) is None
    else:
        assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
