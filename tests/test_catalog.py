"""Queries on the given tables against their SQL, as far as they are there.

LOOKALIKE_ALL=1 runs every query instead of the quick ones.
"""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = Path("/root/testdata/sf0.001")
QUICK = (
    "asset_key", "random_pairs", "select_patches", "select_quadrants", "to_rgb", "resize",
    "phash_ngrams", "block_median_fuzz", "pixel_rows", "lookup_io", "native_band_percentiles",
    "word_count", "token_cap", "inspect_type", "full_join_ab",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("LOOKALIKE_ALL") else QUICK

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    number = float(value)
    return int(number) if number == int(number) else round(number, 9)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(TABLES))
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_most_altered_pictures_find_their_original(spark):
    found = entry.entry(spark).collect()
    right = sum(r.cand == r.best_match for r in found)
    assert right >= 0.9 * len(found) and len(found) >= 400
