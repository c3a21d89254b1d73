"""Every query that has SQL, against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from brindle.catalogue import storage  # noqa: F401
from brindle.catalogue.relational import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, small, name):
    df = QUERIES[name](spark, small)
    rel = db.sql(SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(rel.columns, rel.fetchall())


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_nothing_outside_imports_the_training_data_operators():
    root = Path(__file__).resolve().parents[1]
    for path in (root / "brindle").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(__import__("sys").modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
