import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from isobath.llm import dialogue as M
from isobath.llm.queries import OP13_SQL, op13_dialogue_repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def harmed(rows):
    """Rows after damage, per conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if m == 1:
            text = ""
        elif m == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif m == 4:
            role = "user"
        out[conv] += [] if m == 0 else [(turn, role, text)] * (2 if m == 3 else 1)
    return out


def brute(rows):
    """Result of one conversation: ways are tried in order of (cost, edits) until one fits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        own = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    fits = lambda made, whole=False: _fits("".join(m[0] for m in made), whole)
    heap = [(0, "", 0, ())]
    while True:
        cost, edits, i, made = heapq.heappop(heap)
        if i == len(rows) and fits(made, True):
            sha = hashlib.sha256("\n".join(made).encode()).hexdigest()
            return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha)
        options = [("I", 5, i, (*made, f"{r}:")) for r in ("user", "assistant")] if not edits.endswith("II") else []
        if i < len(rows):
            _, role, text = rows[i]
            options.append(("D", 2, i + 1, made))
            if faults[i] in (None, "truncated"):
                more = 5 if faults[i] else 0
                options += [("R", 1 + more, i + 1, (*made, f"{r}:{text}")) for r in ("user", "assistant")]
                if role:
                    options.append(("K", more, i + 1, (*made, f"{role}:{text}")))
        for e, c, j, m in options:
            if fits(m):
                heapq.heappush(heap, (cost + c, edits + e, j, m))


def _fits(initials, whole):
    body = initials[1:] if initials[:1] == "s" else initials
    right = all(c == "ua"[k % 2] for k, c in enumerate(body))
    return right and (not whole or not initials or (len(body) % 2 == 0 and len(body) > 0))


def fields(r):
    return tuple(r[c] for c in (*M.NUMBERS, "audit", "repaired_sha256"))


def as_damaged(spark, rows):
    return spark.createDataFrame([(c, t, r, x, False) for c, t, r, x in rows], SCHEMA + ", dropped boolean")


def test_query_equals_brute_force_and_sql(spark):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op13_dialogue_repair(spark, SF)
    mine = {r.conv_id: fields(r) for r in found.collect()}
    after = harmed(rows)
    assert mine == {c: brute(after[c]) for c in {r[0] for r in rows}}
    with duckdb.connect() as duck:
        duck.sql(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
        sql = duck.sql(OP13_SQL)
        assert sorted(sql.columns) == sorted(found.columns)
        assert {r[0]: r[1:] for r in sql.select(*["conv_id", *M.NUMBERS, "audit", "repaired_sha256"]).fetchall()} == mine


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown"]
TEXTS = ["Yes.", "No!", "Why?", "so then", " \t\n", "", None, "Ends. \n", "same.", "same."]


def odd(seed, conversations, most):
    rng = random.Random(seed)
    return [(c, rng.choice([None, k, k, k, 2 * k, 1]), rng.choice(ROLES[: rng.choice([3, 9])]), rng.choice(TEXTS)) for c in [None, *range(conversations)] for k in range(rng.randint(1, most))]


def test_damage_and_repair_of_odd_rows_equal_sql_and_brute_force(spark):
    import duckdb

    rows = odd(1, 150, 5)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"harm": F.lit("x"), "copy": F.lit(1), "dropped": F.lit(True)}).repartition(5)
    found = M.repair(M.damage(docs))
    assert found.columns == ["conv_id", *M.NUMBERS, "audit", "repaired_sha256"]
    mine = {r.conv_id: fields(r) for r in found.collect()}
    after = harmed(rows)
    assert mine == {c: brute(after[c]) for c in {r[0] for r in rows}}
    with duckdb.connect() as duck:
        frame = docs.select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841
        duck.sql("CREATE VIEW conversations AS FROM frame")
        # an empty role is kept by nobody here, and in the SQL too
        sql = {r[0]: r[1:] for r in duck.sql(OP13_SQL).select(*["conv_id", *M.NUMBERS, "audit", "repaired_sha256"]).fetchall()}
        assert sql == mine


@pytest.mark.parametrize("block_rows", [1, 3])
def test_blocks_over_ranges_give_what_memory_gives(spark, block_rows):
    rng = random.Random(5)
    rows = [(c, k, rng.choice(ROLES), rng.choice([*TEXTS, f"text {rng.randint(0, 30)}."])) for c, n in enumerate([300, 7, 1, 40, 0, 150]) for k in range(n)]
    rows += [(9, 1, "user", "dropped.")]
    whole = M.repair(as_damaged(spark, rows).withColumn("dropped", F.col("conv_id") == 9).repartition(3), block_rows)
    expected = {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    groups = defaultdict(list)
    for c, t, r, x in rows:
        if c != 9:
            groups[c].append((t, " " if r is None else r, " " if x is None else x))
    for c, own in groups.items():
        own.sort(key=lambda r: r)
        seen, made = set(), []
        for _, r, x in own:
            made.append((r, x, M.fault(x, (r, x) in seen)))
            seen.add((r, x))
        expected[c] = tuple(M.solved([t for t, *_ in own], made))
    assert {r.conv_id: fields(r) for r in whole.collect()} == expected
    # a shorter one is what trying all ways gives
    assert expected[1] == brute(groups[1])


def test_kernel_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "c!", " ", "d.", "e"])) for k in range(rng.randint(0, 6))]
        seen, made = set(), []
        for _, r, x in rows:
            made.append((r, x, M.fault(x, (r, x) in seen)))
            seen.add((r, x))
        assert tuple(M.solved([t for t, *_ in rows], made)) == brute(rows)


def test_empty_table_and_long_texts(spark):
    assert M.repair(as_damaged(spark, [])).count() == 0
    long = "word " * 1_500_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long), (2, 0, "assistant", "ok.")]
    found = {r.conv_id: r for r in M.repair(as_damaged(spark, rows)).collect()}
    assert found[1].audit == "KKD" and found[1].duplicate == 1 and found[1].cost == 2
    assert found[1].repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert found[2].audit == "D"


def test_string_ids(spark):
    rows = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Hi."), ("b", 0, "system", "s."), ("b", 5, "user", "x")], "conv_id string, turn int, role string, text string")
    found = {r.conv_id: r for r in M.repair(rows.withColumn("dropped", F.lit(False))).collect()}
    assert found["a"].audit == "KK" and found["b"].audit == "DD" and found["b"].gaps == 4
