"""Every id of the operator inventory is shown by some query."""

from freightnet.catalog import load

INVENTORY = {
    "S": 12, "P": 8, "F": 10, "J": 14, "A": 12, "W": 4, "O": 2, "R": 6, "C": 16, "B": 15, "N": 9, "K": 8, "Q": 5,
}


def test_every_operator_is_shown():
    shown = {i for q in load().values() for i in q.covers.split()}
    wanted = {f"{k}{n}" for k, most in INVENTORY.items() for n in range(1, most + 1)}
    assert shown == wanted


def test_every_query_has_independent_sql():
    assert [n for n, q in load().items() if q.sql is None] == []
