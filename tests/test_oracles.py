"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from quarry import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    cut = lambda v: round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v
    return sorted((tuple(cut(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = registry.queries()[name](spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert norm(tuple(r) for r in df.select(*cols).collect()) == norm(want)
