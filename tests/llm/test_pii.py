import hashlib
import math
import random
import re
import time

import pytest

from isobath.llm import pii as P
from isobath.llm.common import table

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    """Counts per base kind, and the digest of the base spans, by the plain patterns."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    found = [[(k, m.start(), m.end()) for m in re.finditer(p, text) if ok(m)] for k, p, ok in rules]
    joined = ",".join(f"{k}:{a}:{b}" for spans in found for k, a, b in spans)
    return [len(x) for x in found] + [hashlib.sha256(joined.encode()).hexdigest()]


def card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def texts(seed):
    rng = random.Random(seed)
    bits = ["a@b.c", "x.y@z-1.example.com", "a@b@c.d", "a@b.c_d@e.f", "@", "1.2.3.4", "255.255.255.256", "001.2.3.4.5.6.7.8", "1.2.3", "300.1.1.1", "é", "\U0001f600", " ", "  ", "-", ".", "+", "+1 (555) 123-4567", "+12", "+1 2", "+123456789012345678", "+1) )", "5", "12 34", "\n", "--", card(rng), card(rng, 19), card(rng)[:15], " ".join(re.findall("....", card(rng))), "-".join(re.findall("....", card(rng))), "1234567812345678", "name"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)]


def digests(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return P.digest_columns(P.find_personal(df)).collect()


@pytest.mark.parametrize("seed", range(2))
def test_base_spans_against_plain_patterns(spark, seed):
    rows = [(i, t) for i, t in enumerate([None, "", *texts(seed)])]
    got = {r["doc_id"]: [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]] for r in digests(spark, rows)}
    for i, t in rows:
        assert got[i] == brute(t or ""), t


def test_query_against_brute_force(spark):
    from isobath.llm.queries import op9_personal_data

    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    got = op9_personal_data(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]] == brute(docs[r["doc_id"]])
        spans = [x.split(":") for x in r["spans"].split(",")] if r["spans"] else []
        assert len(spans) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]


def test_added_spans_need_check_threshold_and_room(spark):
    rng = random.Random(9)
    rows = [(i, f"word {rng.randint(2, 9)}{rng.randint(10, 99)}-{rng.randint(2, 9)}{rng.randint(10, 99)}-{rng.randint(1000, 9999)} tel word") for i in range(400)]
    rows += [(1000 + i, f"call +1 {rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)} now") for i in range(400)]
    rows += [(2000, "call 111-111-1111 now"), (2001, "nothing here")]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["base"]) for s in r["spans"]] for r in P.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == [("phone", 5, False)] for i in range(400))
    assert all(found[1000 + i] == [("phone", 5, True)] for i in range(400))
    assert found[2000] == found[2001] == []


def test_iban_and_luhn_checks(spark):
    good, bad = "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32"
    c = P.candidates(spark.createDataFrame([(1, f"pay {good} or {bad} now")], "doc_id long, text string"), "doc_id", "text")
    names = [g.name for g in P.GENERATORS]
    assert [(names[r["generator"]], r["strict"]) for r in c.where("generator is not null").orderBy("generator", "place").collect()] == [("iban", True), ("iban", False)]


def test_boosted_trees_learn_an_interaction():
    counts = {(0, a | b << 1 | c << 2): ((10, 90) if a != b else (90, 10)) for a in (0, 1) for b in (0, 1) for c in (0, 1)}
    prior, trees = P.fit(counts, len(P.FEATURES), rounds=20)
    for (k, bits), (no, yes) in counts.items():
        p = 1 / (1 + math.exp(-P.score_of((prior, trees), k, bits)))
        assert abs(p - yes / (no + yes)) < 0.1
    assert P.fit({}, len(P.FEATURES)) == (0.0, [])


def test_scores_are_alike_in_sql(spark):
    rng = random.Random(4)
    counts = {(rng.randrange(len(P.GENERATORS)), rng.getrandbits(len(P.FEATURES))): (rng.randint(0, 50), rng.randint(0, 50)) for _ in range(200)}
    model = P.fit(counts, len(P.FEATURES), rounds=8)
    df = spark.createDataFrame(list(counts), "generator int, bits int")
    for r in df.withColumn("s", P.score_column(model)).collect():
        assert abs(r["s"] - P.score_of(model, r["generator"], r["bits"])) < 1e-9


def test_thresholds_keep_precision():
    model = (0.0, [P.Tree(0, (1, 1), (0.0, 1.0, 2.0, 3.0))])
    counts = {(0, 0b11): (0, 100), (0, 0b01): (1, 99), (0, 0b10): (50, 50), (1, 0b11): (0, 5)}
    assert P.thresholds(model, counts, 0.98) == {0: 2.0, 1: 3.0}


LONG = ["1", "a", "1 ", "a@", "1.", "AB12 ", "+1", "1)"]


def test_runs_match_what_plain_patterns_match(spark):
    rows = [(i, "+" + t * 700 + "x") for i, t in enumerate(LONG)]
    for r in digests(spark, rows):
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]] == brute(rows[r["doc_id"]][1])


def test_long_runs_take_linear_time(spark):
    begin = time.time()
    assert len(digests(spark, [(i, t * (200_000 // len(t))) for i, t in enumerate(LONG)])) == len(LONG)
    assert time.time() - begin < 60


def test_no_frame_is_added_up_anew_for_every_row(spark):
    plan = P.find_personal(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string"))._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_edges(spark):
    df = spark.createDataFrame([(None, "a@b.cd", "x"), (3, "a@b.cd", "y"), (3, "a@b.cd", "y")], "doc_id long, text string, row string")
    assert [len(r["spans"]) for r in P.find_personal(df).collect()] == [1, 1, 1]
    assert P.find_personal(df.limit(0)).collect() == []


def spans_of(spark, texts, parts=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = df.repartition(parts) if parts else df
    return {r["doc_id"]: [(s["kind"], s["start"], s["base"]) for s in r["spans"]] for r in P.find_personal(df).collect()}


def test_spans_do_not_hang_on_the_layout_or_the_company(spark):
    texts = ["call (415) 555-2671 now", "we met at noon dot then left at home dot come", "mail jane (at) example (dot) org", "order 415-555-2671"]
    alone = spans_of(spark, texts)
    assert alone == {0: [("phone", 5, False)], 1: [], 2: [("email", 5, False)], 3: []}
    many = texts + ["call (415) 555-2671 now", "a@b.cd"] * 150
    for parts in (1, 7, 11, 16):
        assert {k: v for k, v in spans_of(spark, many, parts).items() if k < len(texts)} == alone


def test_trees_reject_what_passes_its_check(spark):
    rejected = ["order 415-555-2671 units", "serial 219-09-1234", "fingerprint 12:34:56:78:9a:bc:de:f0", "881 212-555-0199 221", "checksum 4111.1111.1111.1111"]
    df = spark.createDataFrame(list(enumerate(rejected)), "doc_id long, text string")
    assert P.candidates(df, "doc_id", "text").where("strict AND NOT generator < 4").count() >= len(rejected)
    assert all(not any(not base for *_, base in spans) for spans in spans_of(spark, rejected).values())


def test_precision_and_recall_on_inserted_values(spark):
    """Fresh examples, inserted into texts of the table."""
    from isobath.llm.pii_examples import examples

    around = [r["text"] for r in table(spark, SF, "documents").where("length(text) BETWEEN 200 AND 4000").orderBy("doc_id").limit(100).collect()]
    made = examples(200, seed=77)
    texts = [f"{around[i % 100]}\n{e['text']}\n{around[(i + 7) % 100]}" for i, e in enumerate(made)]
    plain = spans_of(spark, [f"{around[i % 100]}\n\n{around[(i + 7) % 100]}" for i in range(len(made))])
    found = spans_of(spark, texts)
    added = {i: sum(not base for *_, base in found[i]) > sum(not base for *_, base in plain[i]) for i in found}
    hit = sum(added[i] and e["personal"] for i, e in enumerate(made))
    wrong = sum(added[i] and not e["personal"] for i, e in enumerate(made))
    print("precision", hit / (hit + wrong), "recall", hit / sum(e["personal"] for e in made))
    assert hit >= 0.96 * (hit + wrong) and hit >= 0.85 * sum(e["personal"] for e in made)
