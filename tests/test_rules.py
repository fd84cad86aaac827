import pytest

from isobath.operators import facts
from isobath.operators.rules import Rule, verdict, violations

RULES = [
    Rule("id", "a", "required", ("id", "name")),
    Rule("size", "a", "range", ("x",), {"low": 0.0, "high": 1.0}),
    Rule("floor", "a", "range", ("y",), {"low": 0.0}, "warning"),
    Rule("kind", "a", "among", ("kind",), {"values": ["p", "q"]}),
    Rule("ordered", "a", "order", ("x", "y")),
    Rule("same", "a", "equal", ("x", "z"), {"tolerance": 0.01}),
    Rule("both", "a", "together", ("y", "z")),
    Rule("form", "a", "matches", ("name",), {"pattern": "^[a-z]+$"}, "warning"),
    Rule("sum", "a", "holds", ("x", "y"), {"condition": "x + y < 1.5"}),
    Rule("once", "a", "unique", ("name",)),
    Rule("known", "a", "reference", ("kind",), {"to": "b", "columns": ("k",)}),
]
SOUND = (1, "one", 0.5, 0.6, 0.5, "p")
PLANTED = {
    "id": [(2, " ", 0.5, 0.6, 0.5, "p"), (None, "three", 0.5, 0.6, 0.5, "p")],
    "size": [(2, "two", -0.1, 0.6, -0.1, "p")],
    "floor": [(2, "two", None, -0.5, 0.5, "p")],
    "kind": [(2, "two", 0.5, 0.6, 0.5, "r")],
    "ordered": [(2, "two", 0.5, 0.4, 0.5, "p")],
    "same": [(2, "two", 0.5, 0.6, 0.52, "p")],
    "both": [(2, "two", 0.5, None, 0.5, "p")],
    "form": [(2, "Two", 0.5, 0.6, 0.5, "p")],
    "sum": [(2, "two", 0.9, 0.9, 0.9, "p")],
    "once": [(2, "one", 0.5, 0.6, 0.5, "p")],
    "known": [(2, "two", 0.5, 0.6, 0.5, "q")],
}


def tables(spark, rows):
    return {"a": spark.createDataFrame(rows, "id int, name string, x double, y double, z double, kind string"), "b": spark.createDataFrame([("p",), ("r",), (None,)], "k string")}


@pytest.mark.parametrize("name", sorted(PLANTED))
def test_each_planted_fault_is_found(spark, name):
    found = violations(tables(spark, [SOUND, *PLANTED[name]]), RULES, {"a": "id", "b": "k"}).collect()
    also = {"id": {"form"} if name == "id" else set()}.get(name, set())
    assert {r["rule"] for r in found} - also == {name}
    assert len([r for r in found if r["rule"] == name]) == len(PLANTED[name])


def test_verdict(spark):
    of = lambda rows: verdict(violations(tables(spark, rows), RULES, {"a": "id", "b": "k"}), RULES).first()
    assert tuple(of([SOUND])) == ("passed", 0, 0, 11, 0)
    assert tuple(of([SOUND, *PLANTED["floor"]])) == ("warning", 0, 1, 11, 1)
    assert of([SOUND, *PLANTED["sum"], *PLANTED["form"]])["status"] == "failed"


def test_rules_are_checked(spark):
    with pytest.raises(ValueError):
        Rule("x", "a", "no such kind", ("id",))
    with pytest.raises(ValueError, match="aren't there"):
        violations(tables(spark, [SOUND]), [Rule("x", "c", "unique", ("id",))], {"a": "id"})


def test_negation_ends_with_its_sentence(spark):
    texts = [("a", "This is not a forecast."), ("b", "It was not warm. It will rise."), ("c", "No cause is known; damage due to heat"), ("d", "see https://x"), ("e", "not according to a study"), ("f", None)]
    df = spark.createDataFrame(texts, "text_id string, text string")
    got = sorted((r["text_id"], r["category"]) for r in facts.prohibited_claims(df).collect())
    assert got == [("b", "forecast"), ("c", "causal_attribution"), ("d", "external_reference"), ("e", "external_reference")]
    assert [tuple(r) for r in facts.prohibited_claims(df, patterns={"warmth": "warm"}).collect()] == []
    assert [tuple(r) for r in facts.prohibited_claims(df, patterns={"rise": "rise"}).collect()] == [("b", "rise")]
