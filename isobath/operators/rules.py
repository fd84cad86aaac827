"""Checks of product tables by rules that are data: one violation row per rule and offending key.

A rule is a row: its table, kind, columns and arguments.  All row rules of a table are tested in one pass over
it; uniqueness is one aggregation and a reference one anti join for each rule.  Nothing is read that
no rule names.

Kinds: ``required`` (not null, NaN or blank), ``range`` (``low`` to ``high``, either may be missing), ``among``
(``values``), ``order`` (each column at most the next), ``equal`` (columns agree, to ``tolerance``), ``together`` (all
columns null or none), ``matches`` (``pattern``), ``holds`` (any SQL ``condition``), ``unique``, and
``reference`` (to the ``columns`` of table ``to``).  Null values only break ``required`` and ``together``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_KINDS = ("required", "range", "among", "order", "equal", "together", "matches", "holds")
VIOLATION = "rule string, severity string, table string, key string, detail string"


@dataclass(frozen=True)
class Rule:
    name: str
    table: str
    kind: str
    columns: tuple[str, ...]
    arguments: dict = field(default_factory=dict)
    severity: str = "error"

    def __post_init__(self) -> None:
        if self.kind not in (*ROW_KINDS, "unique", "reference") or self.severity not in ("error", "warning"):
            raise ValueError(f"unknown kind or severity of rule {self.name}")


def broken(rule: Rule, types: dict[str, str]) -> Column:
    """Where a row breaks a row rule."""
    cols, a = [F.col(c) for c in rule.columns], rule.arguments
    if rule.kind == "required":
        void = lambda c: F.isnan(c) if types[c] in ("double", "float") else F.trim(F.col(c)) == "" if types[c] == "string" else F.lit(False)
        return reduce(or_, [F.col(c).isNull() | F.coalesce(void(c), F.lit(False)) for c in rule.columns])
    if rule.kind == "range":
        low = [c < F.lit(a["low"]) for c in cols if a.get("low") is not None]
        high = [c > F.lit(a["high"]) for c in cols if a.get("high") is not None]
        return reduce(or_, low + high)
    if rule.kind == "among":
        return reduce(or_, [~c.isin(*a["values"]) for c in cols])
    if rule.kind == "order":
        return reduce(or_, [x > y for x, y in zip(cols, cols[1:], strict=False)])
    if rule.kind == "equal":
        gap = a.get("tolerance")
        return reduce(or_, [x != y if gap is None else F.abs(x - y) > gap for x, y in zip(cols, cols[1:], strict=False)])
    if rule.kind == "together":
        return reduce(or_, [c.isNull() for c in cols]) & ~reduce(and_, [c.isNull() for c in cols])
    if rule.kind == "matches":
        return reduce(or_, [~c.rlike(a["pattern"]) for c in cols])
    return ~F.expr(a["condition"])


def violations(tables: dict[str, DataFrame], rules: Iterable[Rule], keys: dict[str, str]) -> DataFrame:
    """``rule, severity, table, key, detail``: one row per rule and row (``unique``: per repeated value) that breaks it; ``keys``: a table's key column."""
    rules = list(rules)
    if not rules:
        raise ValueError("no rules")
    if lost := sorted({r.table for r in rules} - set(tables)):
        raise ValueError(f"rules of tables that aren't there: {', '.join(lost)}")
    found = []
    shown = lambda r: F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in r.columns])
    entry = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.table).alias("table"), F.col(keys[r.table]).cast("string").alias("key"), shown(r).alias("detail"))
    for name, df in tables.items():
        own = [r for r in rules if r.table == name]
        types = dict(df.dtypes)
        if rows := [F.when(F.coalesce(broken(r, types), F.lit(False)), entry(r)) for r in own if r.kind in ROW_KINDS]:
            found.append(df.select(F.explode(F.array_compact(F.array(*rows))).alias("v")).select("v.*"))
        for r in own:
            head = [F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.table).alias("table")]
            there = df.dropna(subset=list(r.columns))
            if r.kind == "unique":
                many = there.groupBy(*r.columns).agg(F.min(F.col(keys[name])).cast("string").alias("key"), F.count(F.lit(1)).alias("n")).where("n > 1")
                found.append(many.select(*head, "key", F.concat(shown(r), F.lit(": "), F.col("n").cast("string"), F.lit(" rows")).alias("detail")))
            elif r.kind == "reference":
                target = r.arguments.get("columns", r.columns)
                known = tables[r.arguments["to"]].select(*[F.col(t).alias(c) for c, t in zip(r.columns, target, strict=True)]).distinct()
                found.append(there.join(known, list(r.columns), "left_anti").select(*head, F.col(keys[name]).cast("string").alias("key"), shown(r).alias("detail")))
    return reduce(DataFrame.unionByName, found)


def verdict(found: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One row: ``status`` (failed, warning or passed), numbers of errors and warnings, and of rules tested and broken."""
    counts = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.countDistinct("rule").alias("rules_broken"))
    status = F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed")
    return counts.select(status.alias("status"), "errors", "warnings", F.lit(len(list(rules))).alias("rules"), "rules_broken")
