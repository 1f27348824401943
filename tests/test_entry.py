import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from loomtext.plans import catalogue as core
from tests.conftest import SF


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


#: Its SQL asks a part of the words only; and queries that take long, whose parts are tested (lm_tuning, next_words_kn, the ranking's and the winner's operators).
PARTIAL = {"spell_suggest", "lm_ranking", "lm_winner", "next_words_kn_head"}


@pytest.mark.parametrize("name", sorted(set(core.oracle_sql()) - PARTIAL))
def test_against_sql(spark, tables, name):
    """Every query beside its SQL, over the whole small tables."""
    want = tables.execute(core.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    text = lambda row: tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)
    rows = core.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(text(r) for r in rows) == sorted(text(r) for r in want.fetchall())
