"""The driver's contract, with or without the training-data operators."""

import __spark_entry__ as entry


def test_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len([q for q in queries if q.startswith("q_")]) >= 60


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
