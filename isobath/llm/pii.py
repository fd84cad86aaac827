"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

1. Generators with high recall propose spans, which may overlap: the four base patterns, and looser
   ones (spelled-out addresses, national numbers, cards with other separators and so on).  All of a
   document's candidates are found in one pass over the table and written, with their context, to
   the shared folder; texts are not read again.
2. Binary features describe a candidate's format and context and leave the check out.  Boosted depth-2
   trees with logistic loss are fitted to labelled examples (``pii_examples``: made by rule, ``EXAMPLES``
   per looser generator, the same for every corpus), which pass through the same generators and
   features.  The driver sees counts per (generator, features), at most one per example.
3. Per looser generator the least threshold is taken at which the held-out examples have
   ``precision``; where there is none, the generator adds nothing.
4. Base spans that pass their check are always reported.  A looser candidate is added if it passes
   its check, its score reaches its generator's threshold and it overlaps no base span.

Model and thresholds hang on nothing but the examples, so a text has the same spans in any table,
however its rows lie.

Everything is DataFrame and SQL functions.  Patterns are possessive and anchored at the start of a
run, so they take linear time on any text, and match what the plain base patterns match.

Defined results: null text is empty; texts are searched whole; rows are independent (each has its
own row number), so repeated rows give repeated results; an empty table gives no rows; other columns
of the input aren't returned.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobath.llm.common import cut
from isobath.llm.pii_examples import EXAMPLES, examples

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
ROUNDS, RATE, SHRINK = 30, 0.3, 1.0
PRECISION = 0.98
CONTEXT = 24


class Generator(NamedTuple):
    name: str
    kind: str
    #: Only texts with a match of this are searched.
    needs: str
    pattern: str
    #: SQL over ``value``: the strict check.
    strict: str
    #: Words that announce such a value.
    cue: str = ""


_BYTE = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace(value, '[^0-9]', '')"
_LUHN = f"length({_DIGITS}) BETWEEN 16 AND 19 AND luhn_check({_DIGITS})"
#: IBAN: country and check digits to the end, letters as two digits, remainder by 97 digit by digit.
_IBAN = """length(regexp_replace(value, ' ', '')) BETWEEN 15 AND 34 AND aggregate(
  split(concat(substring(regexp_replace(value, ' ', ''), 5), substring(regexp_replace(value, ' ', ''), 1, 4)), ''), 0,
  (r, c) -> CASE WHEN c = '' THEN r WHEN c >= 'A' THEN (r * 100 + ascii(c) - 55) % 97 ELSE (r * 10 + ascii(c) - 48) % 97 END) = 1"""

#: The base patterns come first.  A run is entered at its start, or where the last match ended.
GENERATORS = (
    Generator("email", "email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    Generator("ip", "ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", rf"value RLIKE '^0*{_BYTE}(?:\\.0*{_BYTE}){{3}}$'"),
    Generator("card", "card", r"(?:[0-9][ -]?){15}[0-9]", r"(?:\G|(?<![0-9]))(?=(?:[0-9][ -]?){15}[0-9])[0-9]++(?:[ -][0-9]++)*+", _LUHN),
    Generator("phone", "phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    Generator("email_words", "email", r"(?:\(dot\)|\[dot\]| dot )", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?\(at\) ?| ?\[at\] ?| at )[A-Za-z0-9-]{1,63}+(?:(?: ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]{1,63}+){1,5}", "value RLIKE '[ )\\\\]][A-Za-z]{2,}$'", "mail|contact"),
    Generator("ip6", "ip", "(?:[0-9A-Fa-f]{1,4}:){7}", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "true", "host|addr|address|server|ip"),
    Generator("card_wide", "card", r"[0-9]{4}[._/][0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])", _LUHN, "card|visa|pay|master"),
    Generator("phone_local", "phone", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", "value RLIKE '^[(]?[2-9][0-9]{2}[)]?[ .-][2-9]'", "tel|phone|fax|call|mobile?|telephone"),
    Generator("ssn", "ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "value RLIKE '^(?!000|666|9)' AND value NOT LIKE '%-00-%' AND value NOT LIKE '%-0000'", "ssn|social security"),
    Generator("iban", "iban", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _IBAN, "iban|account"),
)
BASE = ("email", "ip", "card", "phone")

#: The generators whose candidates are scored.
LOOSE = tuple(k for k, g in enumerate(GENERATORS) if g.name not in BASE)
#: Words that announce another number, and what stands behind quantities.
_OTHER = "order|part|item|invoice|serial|isbn|sku|version|ref|reference|model|lot|batch|ticket|code|checksum|fingerprint|hash|build|page|section|score"
_UNIT = "%|(?:units?|kg|g|km|cm|mm|mb|gb|points|pages|items|pcs|dollars|euros)(?![a-z])"
#: Last labels of addresses; those that are English words too are left out.
_ENDS = "com|org|net|edu|gov|info|biz|eu|uk|de|fr|es|ch|nl|io|dev|ca|jp"

#: Binary features of a candidate: SQL over ``value``, ``before``, ``after`` and ``generator``.
FEATURES = {
    "cue": "coalesce(CASE " + " ".join(f"WHEN generator = {k} THEN lower(before) RLIKE '(?:^|[^a-z])(?:e-?)?(?:{GENERATORS[k].cue})(?: (?:me|us|no|number|address|to|card|iban))?[^a-z]*$'" for k in LOOSE) + " END, false)",
    "other": f"lower(before) RLIKE '(?:^|[^a-z])(?:{_OTHER})(?: (?:no|number))?[^a-z]*$'",
    "unit": f"lower(after) RLIKE '^ ?(?:{_UNIT})'",
    "left_clear": "before = '' OR before RLIKE '[ \\t\\n\\r(<\"\\':;,]$'",
    "right_clear": "after = '' OR after RLIKE '^[^A-Za-z0-9_]'",
    "number_before": "before RLIKE '[0-9][ .,/-]?$'",
    "number_after": "after RLIKE '^[ .,/-]?[0-9]'",
    "money_before": "before RLIKE '[$€£#%] ?$'",
    "same_digit": f"{_DIGITS} RLIKE '^(.)\\\\1+$'",
    "counting": f"length({_DIGITS}) > 5 AND (instr('12345678901234567890123456789012345678901234567890', {_DIGITS}) > 0 OR {_DIGITS} RLIKE '^.?.?.?.?(?:123456|000000)')",
    "ending": f"lower(value) RLIKE '(?:{_ENDS})$' AND lower(value) NOT RLIKE '[a-z0-9-](?:{_ENDS})$'",
    "brackets": "value RLIKE '[(\\\\[]'",
    "short_groups": "value RLIKE '^(?:[0-9A-Fa-f]{1,2}:)+[0-9A-Fa-f]{1,2}$'",
}


def _matches(g: Generator, order: int) -> Column:
    """The generator's matches in ``text`` as structs: what lies before each is all of the text since the last."""
    pattern = F.lit(f"(?s)\\G(.*?)({g.pattern})(?=(.{{0,{CONTEXT}}}))")
    part = lambda k: F.regexp_extract_all("text", pattern, F.lit(k))
    found = F.arrays_zip(part(1).alias("gap"), part(2).alias("value"), part(3).alias("after"))
    shaped = F.transform(found, lambda x, i: F.struct(F.lit(order).alias("generator"), i.alias("place"), F.char_length(x["gap"]).cast("long").alias("gap"), x["value"].alias("value"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), x["after"].alias("after")))
    return F.when(F.col("text").rlike(g.needs), shaped)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per candidate, and one (with null ``generator``) per document that has none."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    empty = "CAST(array() AS ARRAY<STRUCT<generator: INT, place: INT, gap: BIGINT, value: STRING, before: STRING, after: STRING>>)"
    # few texts have any: the rest is decided by one look for what all generators need
    some = F.col("text").rlike(r"[@0-9]|\(dot\)|\[dot\]| dot ")
    every = F.when(some, F.concat(*[F.coalesce(_matches(g, k), F.expr(empty)) for k, g in enumerate(GENERATORS)]))
    found = rows.select("row", "id", F.explode_outer(every).alias("c")).select("row", "id", "c.*")
    strict = F.coalesce(*[F.when(F.col("generator") == k, F.expr(g.strict)) for k, g in enumerate(GENERATORS)], F.lit(False))
    kind = F.coalesce(*[F.when(F.col("generator") == k, F.lit(KINDS.index(g.kind))) for k, g in enumerate(GENERATORS)])
    bits = sum((F.when(F.expr(sql), F.lit(1 << k)).otherwise(0) for k, sql in enumerate(FEATURES.values())), F.lit(0))
    return found.select("row", "id", "generator", "place", "gap", F.char_length("value").cast("long").alias("size"), kind.alias("kind"), strict.alias("strict"), bits.alias("bits"))


class Tree(NamedTuple):
    """Splits on one feature, then on another on either side."""

    first: int
    seconds: tuple[int, int]
    leaves: tuple[float, float, float, float]


def _gain(g: float, h: float) -> float:
    return g * g / (h + SHRINK)


def fit(counts: dict[tuple[int, int], tuple[int, int]], features: int, rounds: int = ROUNDS) -> tuple[float, list[Tree]]:
    """Gradient boosting on counts of (negative, positive) per (generator, feature bits); the generators are features too."""
    rows = [(bits | 1 << (features + generator), *n) for (generator, bits), n in sorted(counts.items())]
    width = features + len(GENERATORS)
    total, positive = sum(a + b for _, a, b in rows), sum(b for _, _, b in rows)
    if not rows:
        return 0.0, []
    prior = math.log((positive + 0.5) / (total - positive + 0.5))
    scores, trees = [prior] * len(rows), []
    for _ in range(rounds):
        slopes = []
        for (_, a, b), s in zip(rows, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            slopes.append((b - (a + b) * p, (a + b) * p * (1 - p)))

        def best(members: list[int]) -> tuple[float, int, float, float]:
            """The best feature to split ``members`` on, and the leaf values without and with it."""
            g, h = (sum(slopes[i][k] for i in members) for k in (0, 1))
            found = (0.0, 0, g / (h + SHRINK), g / (h + SHRINK))
            for f in range(width):
                g1, h1 = (sum(slopes[i][k] for i in members if rows[i][0] >> f & 1) for k in (0, 1))
                gain = _gain(g1, h1) + _gain(g - g1, h - h1) - _gain(g, h)
                if gain > found[0] + 1e-12:
                    found = (gain, f, (g - g1) / (h - h1 + SHRINK), g1 / (h1 + SHRINK))
            return found

        tried = []
        for f in range(width):
            sides = [[i for i in range(len(rows)) if rows[i][0] >> f & 1 == v] for v in (0, 1)]
            if all(sides):
                low, high = map(best, sides)
                g = [sum(slopes[i][0] for i in x) for x in sides]
                h = [sum(slopes[i][1] for i in x) for x in sides]
                tried.append((low[0] + high[0] + _gain(g[0], h[0]) + _gain(g[1], h[1]) - _gain(sum(g), sum(h)), -f, low, high))
        if not tried or max(tried)[0] <= 1e-9:
            break
        _, f, low, high = max(tried)
        tree = Tree(-f, (low[1], high[1]), tuple(RATE * x for x in (*low[2:], *high[2:])))
        trees.append(tree)
        scores = [s + leaf(tree, bits) for (bits, _, _), s in zip(rows, scores, strict=True)]
    return prior, trees


def leaf(tree: Tree, bits: int) -> float:
    side = bits >> tree.first & 1
    return tree.leaves[2 * side + (bits >> tree.seconds[side] & 1)]


def score_of(model: tuple[float, list[Tree]], generator: int, bits: int) -> float:
    own = bits | 1 << (len(FEATURES) + generator)
    total = model[0]
    for t in model[1]:  # plain sums in the order of ``score_column``, so that equal scores are equal
        total += leaf(t, own)
    return total


def thresholds(model: tuple[float, list[Tree]], counts: dict[tuple[int, int], tuple[int, int]], precision: float) -> dict[int, float]:
    """Per generator the least score at which held-out candidates have ``precision``."""
    out = {}
    for generator in sorted({g for g, _ in counts}):
        scored = sorted(((score_of(model, g, bits), *n) for (g, bits), n in counts.items() if g == generator), reverse=True)
        good = bad = 0
        for at, (score, negative, positive) in enumerate(scored):
            good, bad = good + positive, bad + negative
            tied = at + 1 < len(scored) and scored[at + 1][0] == score
            if not tied and good and good >= precision * (good + bad):
                out[generator] = score
    return out


def learned(spark: SparkSession, precision: float = PRECISION, count: int = EXAMPLES) -> tuple[tuple[float, list[Tree]], dict[int, float]]:
    """Trees and thresholds from the examples, which go through the generators like any text."""
    schema = "array<struct<generator: string, personal: boolean, held: boolean, text: string>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples(count))), schema)).alias("e"))
    # the id carries what is known of the example; of its candidates those of its generator count
    found = candidates(rows.select(F.struct("e.generator", "e.personal", "e.held").alias("id"), "e.text"), "id", "text")
    name = F.element_at(F.array(*[F.lit(g.name) for g in GENERATORS]), F.col("generator") + 1)
    counts: dict[bool, dict[tuple[int, int], tuple[int, int]]] = {True: {}, False: {}}
    seen = found.where(name == F.col("id.generator")).groupBy("generator", "bits", F.col("id.held").alias("held"))
    for r in seen.agg(F.count_if(~F.col("id.personal")).alias("no"), F.count_if("id.personal").alias("yes")).collect():  # one row per example at most
        counts[r["held"]][r["generator"], r["bits"]] = (r["no"], r["yes"])
    model = fit(counts[False], len(FEATURES))
    return model, thresholds(model, counts[True], precision)


def score_column(model: tuple[float, list[Tree]]) -> Column:
    """The sum of the trees' leaves; one small expression over a literal array, however many trees."""
    if not model[1]:
        return F.lit(model[0])
    trees = ", ".join(f"named_struct('f', {t.first}, 'a', {t.seconds[0]}, 'b', {t.seconds[1]}, 'l', array({', '.join(f'{x!r}D' for x in t.leaves)}))" for t in model[1])
    own = f"CAST(bits | shiftleft(1, {len(FEATURES)} + generator) AS BIGINT)"
    leaf_of = f"element_at(t.l, 1 + 2 * getbit({own}, t.f) + getbit({own}, CASE WHEN getbit({own}, t.f) = 1 THEN t.b ELSE t.a END))"
    return F.expr(f"aggregate(array({trees}), {model[0]!r}D, (s, t) -> s + {leaf_of})")


def find_personal(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """Per row of ``docs``: id and ``spans``: ``kind``, ``start``, ``end`` (code points, exclusive), ``base``."""
    model, least = learned(docs.sparkSession, precision)
    found = cut(candidates(docs, id_col, text_col), "candidates")
    run = Window.partitionBy("row", "generator").orderBy("place")
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run)).withColumn("start", F.col("end") - F.col("size"))
    base = F.col("generator") < len(BASE)
    needed = F.coalesce(*[F.when(F.col("generator") == k, F.lit(t)) for k, t in least.items()], F.lit(float("inf")))
    enough = score_column(model) >= needed
    chosen = F.col("strict") & (base | enough)
    placed = placed.select("row", "id", "generator", "kind", "start", "end", base.alias("base"), chosen.alias("chosen"))
    # what overlaps a base span: the furthest base end before it, and the next base start after it
    reported = F.col("base") & F.col("chosen")
    order = Window.partitionBy("row").orderBy("start", F.desc("base"), "end")
    earlier = F.max(F.when(reported, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # in reverse order: a frame that ends with the partition is added up anew for every row
    reverse = Window.partitionBy("row").orderBy(F.desc("start"), "base", F.desc("end"))
    later = F.min(F.when(reported, F.col("start"))).over(reverse.rowsBetween(Window.unboundedPreceding, -1))
    clear = (F.coalesce(earlier, F.lit(-1)) <= F.col("start")) & (F.coalesce(later, F.lit(1 << 62)) >= F.col("end"))
    placed = placed.withColumn("clear", F.col("base") | clear)
    span = F.when(F.col("chosen") & F.col("clear"), F.struct("kind", "start", "end", "base"))
    return placed.groupBy("row", "id").agg(F.array_sort(F.array_distinct(F.collect_list(span))).alias("spans")).select(F.col("id").alias(id_col), F.transform("spans", lambda s: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
