"""Every line of the operator inventory has a query."""

from workload import QUERIES

INVENTORY = {"A": 14, "B": 33, "C": 10, "D": 10, "E": 11, "F": 5, "G": 5, "I": 19, "J": 5, "K": 3}


def test_every_operator_has_a_query():
    wanted = {f"{letter}{i}" for letter, n in INVENTORY.items() for i in range(1, n + 1)}
    covered = {line for q in QUERIES.values() for line in q.covers.split()}
    assert wanted - covered == set()
    assert covered - wanted == set()


def test_every_operator_is_checked_by_sql():
    checked = {line for q in QUERIES.values() if q.sql for line in q.covers.split()}
    everything = {line for q in QUERIES.values() for line in q.covers.split()}
    assert everything == checked
