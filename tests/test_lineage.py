import pytest

from covenant.functions import lineage
from covenant.plans import views


@pytest.mark.parametrize("query, want", [
    ("SELECT 'orders', a.orders FROM t AS a -- FROM lost", {("t",)}),
    ("WITH c AS (SELECT * FROM x), d AS (SELECT * FROM c) SELECT * FROM d JOIN s.y ON d.k = y.k", {("x",), ("s", "y")}),
    ("SELECT (SELECT max(k) FROM p) AS m FROM q WHERE EXISTS (SELECT 1 FROM r WHERE r.k = q.k) AND k IN (SELECT k FROM u)", {("p",), ("q",), ("r",), ("u",)}),
    ("SELECT * FROM a, (SELECT * FROM b UNION SELECT * FROM c) z", {("a",), ("b",), ("c",)}),
    ("SELECT 1", set()),
])
def test_relations(spark, query, want):
    assert lineage.relations(spark, query) == want


@pytest.mark.parametrize("text, want", [
    ("a + t.b > 0 AND 'c' <> 'd'", {("a",), ("t", "b")}),
    ("exists(list, x -> x > low)", {("list",), ("low",)}),
    ("CASE WHEN `odd name` IS NULL THEN upper(s) END", {("odd name",), ("s",)}),
    ("current_timestamp() > at", {("at",)}),
    ("1", set()),
])
def test_columns(spark, text, want):
    assert lineage.columns(spark, text) == want


def test_view_order_is_not_misled(spark):
    """A column that is named like a view makes no cycle."""
    assert views.view_order({"a": "SELECT k AS b FROM t", "b": "SELECT * FROM a"}) == ["a", "b"]
    assert views.view_order({"B": "SELECT 1 AS k", "a": "SELECT * FROM b"}) == ["B", "a"]
    with pytest.raises(ValueError):
        views.view_order({"a": "SELECT * FROM b", "b": "SELECT * FROM a"})
    assert views.view_order({"a": "SELECT * FROM b", "b": "SELECT 1"}, {"a": []}) == ["a", "b"]
