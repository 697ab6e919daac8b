"""All queries over the reference's own operators, with the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a (spark, sf_dir) function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    from tessera.plans import load_all

    load_all()


def queries() -> dict:
    load()
    return QUERIES


def oracle_sql() -> dict:
    load()
    return ORACLES


def flagship(spark, sf_dir):
    load()
    return QUERIES["v15_retrieve"](spark, sf_dir)
