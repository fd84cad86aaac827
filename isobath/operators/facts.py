"""Facts of a report, and checks of texts against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in text with an optional sign, decimals and percent sign; fixed format.
NUMBER = r"(?<![A-Za-z0-9_])[-+]?[0-9]+(?:[.,][0-9]+)?(?: *%)?"
#: Numbers that name something rather than claim it: dates, spans of years, window lengths, ordinals and identifiers.
EXCUSED = (
    r"(?<![0-9A-Za-z_.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])",
    r"(?<![0-9A-Za-z_.])[0-9]{4} *[-\u2013/] *[0-9]{4}(?![0-9]|[.,][0-9])",
    r"(?<![0-9A-Za-z_.])[0-9]+(?: *(?:-|\u2013|to|a) *[0-9]+)?[- ](?:days?|weeks?|months?|years?|hours?|d[ií]as?|semanas?|mes(?:es)?|a[nñ]os?|horas?)(?![A-Za-z])",
    r"(?<![0-9A-Za-z_.])[0-9]+(?:st|nd|rd|th|º|ª)(?![A-Za-z])",
    r"(?:[Pp]ercentiles?|[Pp]ercentil(?:es)?) +[0-9]+(?![0-9]|[.,][0-9])",
    r"[A-Za-z]+[-_]?[0-9][A-Za-z0-9_-]*",
)
#: Claims that a report may not make, by category, over folded text: defaults, to be replaced by a report's own.
PROHIBITED = {
    "official_classification": "clasificacion oficial|official classification",
    "forecast": r"\bforecast|\bpredict|\bwill\b|expected to|\bpronostic|se espera que",
    "causal_attribution": "caused by|due to|driven by|causad[oa] por|debido a",
    "economic_social_impact": "economic impact|social impact|impacto economico|impacto social",
    "confidence_probability": "probability of|probabilidad de|confianza de",
    "external_reference": r"https?://|\bdoi\s*:|according to (?:a|the) study",
}
NEGATION = r"\b(?:no|not|never|without|sin|ningun[oa]?|does not|do not)\b"


def resolve_date(metrics: DataFrame, requested: str | None = None, value: str = "mean_sst_c") -> DataFrame:
    """The last date with a value, or the requested one if it has."""
    rows = metrics.where(F.col(value).isNotNull())
    if requested is not None:
        rows = rows.where(F.col("date") == F.lit(requested).cast("date"))
    return rows.agg(F.max("date").alias("analysis_date")).where("analysis_date IS NOT NULL")


def endpoint_changes(series: DataFrame, days: tuple[int, ...] = (1, 7, 15, 30), keys: list[str] = []) -> DataFrame:
    """Differences to the value exactly so many days before; no nearest date takes its place."""
    steps = F.explode(F.array(*[F.lit(d) for d in days]))
    before = series.select(*keys, F.col("date").alias("then"), F.col("value").alias("was"))
    rows = series.select(*keys, "date", "value", steps.alias("days")).withColumn("then", F.date_sub("date", F.col("days")))
    return rows.join(before, [*keys, "then"], "left").select(*keys, "date", "days", (F.col("value") - F.col("was")).alias("change"))


def registry(facts: DataFrame) -> DataFrame:
    """``fact_id, value, unit, precision, status`` in order; a missing value is unavailable, a repeated id an error."""
    once = F.count(F.lit(1)).over(Window.partitionBy("fact_id"))
    rows = facts.withColumn("fact_id", F.when(once > 1, F.raise_error(F.concat(F.lit("repeated fact id "), "fact_id"))).otherwise(F.col("fact_id")))
    return rows.withColumn("status", F.when(F.col("value").isNull(), "unavailable").otherwise("valid")).orderBy("fact_id")


def context_json(facts: DataFrame) -> DataFrame:
    """One JSON document of all facts in order of their ids, its size and SHA-256."""
    rows = facts.select(F.struct("fact_id", "value", "unit", "status").alias("f"))
    out = rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list("f")).alias("fact_registry"))).alias("payload"))  # a report's few hundred facts
    return out.select("payload", F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("sha256"))


def number_tokens(texts: DataFrame, ident: str = "text_id", text: str = "text") -> DataFrame:
    """Each number of each text: ``token``, ``number``, ``decimals``, ``percent``."""
    rows = texts.select(ident, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(NUMBER), F.lit(0))).alias("position", "token"))
    plain = F.regexp_replace(F.regexp_replace("token", "[ %+]", ""), ",", ".")
    return rows.select(ident, "position", "token", plain.cast("double").alias("number"), F.char_length(F.regexp_extract(plain, r"\.([0-9]+)", 1)).alias("decimals"), F.contains("token", F.lit("%")).alias("percent"))


def without_names(text: Column) -> Column:
    """The text without the numbers that only name a date, span, window, rank or identifier."""
    for pattern in EXCUSED:
        text = F.regexp_replace(text, pattern, " ")
    return text


def unsupported_numbers(texts: DataFrame, cited: DataFrame, facts: DataFrame, ident: str = "text_id") -> DataFrame:
    """Numbers that no cited valid fact of a fitting unit has at that precision; what ``without_names`` leaves out claims nothing.

    ``cited``: the ids of the facts that each text may use.
    """
    tokens = number_tokens(texts.withColumn("text", without_names(F.col("text"))), ident)
    able = cited.join(facts.where("status = 'valid'"), "fact_id")
    rows = tokens.join(able, ident)
    share = F.col("unit").isin("fraction", "fraction_change")
    shown = F.when(F.col("percent") & share, F.col("value") * 100).otherwise(F.col("value"))
    scale = F.pow(F.lit(10.0), F.col("decimals"))
    close = F.abs(F.col("number") - F.round(shown * scale) / scale) <= F.pow(F.lit(10.0), -(F.col("decimals") + 2))
    fits = (F.col("decimals") <= F.col("precision")) & (~F.col("percent") | share | (F.col("unit") == "percent")) & ~(share & ~F.col("percent") & (F.col("decimals") == 0) & (F.abs("value") < 1))
    good = rows.where(fits & close).select(ident, "position").distinct()
    return tokens.join(good, [ident, "position"], "left_anti")


def folded(text: Column) -> Column:
    """Lower case without the accents of the report's languages."""
    return F.translate(F.lower(text), "áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc")


def _claims(pattern: str) -> Callable[[Column], Column]:
    """Whether a sentence has a match that no negation excuses: negated ones are taken out first."""
    negated = f"{NEGATION}.{{0,35}}?(?:{pattern})"
    return lambda sentence: F.regexp_replace(sentence, negated, " ").rlike(pattern)


def prohibited_claims(texts: DataFrame, ident: str = "text_id", text: str = "text", patterns: dict[str, str] = PROHIBITED) -> DataFrame:
    """Texts that make a prohibited claim, one row per category of ``patterns``; a negation up to 35 characters before, in the same sentence, excuses it."""
    sentences = F.split(folded(F.col(text)), r"(?<=[.!?;])\s+|\n+")
    rows = texts.withColumn("__sentences", sentences).withColumn("__whole", folded(F.col(text)))
    found = []
    for name, pattern in patterns.items():
        if name == "external_reference":
            found.append(F.when(F.col("__whole").rlike(pattern), F.lit(name)))
            continue
        found.append(F.when(F.exists("__sentences", _claims(pattern)), F.lit(name)))
    return rows.select(ident, F.explode(F.array_compact(F.array(*found))).alias("category"))


def language_markers(texts: DataFrame, markers: dict[str, list[str]], ident: str = "text_id", text: str = "text") -> DataFrame:
    """Distinct marker words of each language in each text, and the language that has most (four at least)."""
    words = F.array_distinct(F.regexp_extract_all(folded(F.col(text)), F.lit("[a-z]+"), F.lit(0)))
    counts = [F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in m]))).alias(k) for k, m in markers.items()]
    rows = texts.select(ident, *counts)
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("k")) for k in markers]))
    return rows.withColumn("language", F.when(best["n"] >= 4, best["k"]))


def missing_mandatory(required: DataFrame, used: DataFrame, suppressed: DataFrame, facts: DataFrame) -> DataFrame:
    """Required facts that are available, not suppressed and not used."""
    able = required.join(facts.where("status = 'valid'").select("fact_id"), "fact_id", "left_semi")
    return able.join(suppressed, "fact_id", "left_anti").join(used, "fact_id", "left_anti")


def cross_language_issues(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sections whose facts differ between two languages' reports (``section``, ``fact_id``)."""
    one = lambda df, n: df.groupBy("section").agg(F.array_sort(F.collect_set("fact_id")).alias(n))
    both = one(a, "left_facts").join(one(b, "right_facts"), "section", "full")
    return both.where(~F.col("left_facts").eqNullSafe(F.col("right_facts")))


def context_issues(facts: DataFrame, payload: DataFrame, *, maximum_kb: int = 150) -> DataFrame:
    """Violations of the registry's rules, one row each."""
    bad = lambda condition, rule: facts.where(condition).select(F.lit(rule).alias("rule"), "fact_id")
    share = F.col("unit") == "fraction"
    rules = bad(share & ~F.col("value").between(0, 1), "fraction_out_of_range").unionByName(bad(F.col("unit").isin("km", "km2", "day") & (F.col("value") < 0), "negative_measure")).unionByName(bad(F.col("precision") < 0, "negative_precision"))
    large = payload.where(F.col("bytes") > maximum_kb * 1024).select(F.lit("payload_too_large").alias("rule"), F.lit(None).cast("string").alias("fact_id"))
    return rules.unionByName(large)


def rendered(sections: DataFrame, order: list[str]) -> DataFrame:
    """One Markdown text of the sections (``section``, ``position``, ``text``) in their fixed order."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("section"))
    known = sections.where(place > 0).groupBy("section").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])).alias("body"))
    parts = known.select(F.struct(place.alias("place"), F.concat(F.lit("## "), "section", F.lit("\n\n"), "body").alias("text")).alias("p"))
    return parts.agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"])).alias("markdown"))
