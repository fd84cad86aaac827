import random
import re

import xxhash

from isobath.llm import components as C
from isobath.llm import simhash as S
from isobath.llm.common import table


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    """prints: (id, fingerprint); the least id reachable of every row."""
    values = sorted({p for _, p in prints})
    top = {v: v for v in values}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                top[find(a)] = find(b)
    least = {}
    for d, p in prints:
        r = find(p)
        least[r] = min(least.get(r, d), d)
    return {(d, p): least[find(p)] for d, p in prints}


def test_prints_of_odd_texts(spark):
    texts = [None, "", " \t\n", "One", "one  TWO", "a b c", " a\x0bb\x0cc d ", "é É ß x   y z", "w " * 3000, "same same same same", "x\x1cy \x85 z"]
    got = {r["id"]: r["print"] & (2**64 - 1) for r in S.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


def test_query_against_brute_force(spark):
    from isobath.llm.queries import op8_simhash

    sf = "/root/testdata/sf0.001"
    prints = [(r["doc_id"], brute_print(r["text"])) for r in table(spark, sf, "documents").collect()]
    expected = brute_components(prints)
    got = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in op8_simhash(spark, sf).collect()}
    assert got == expected


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_links_connect_what_two_bits_connect(spark):
    rng = random.Random(3)
    values = {0, 1, 3, 7, 2**63, 2**63 | 1}
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(v)
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    prints = [(i, v) for i, v in enumerate(sorted(values))]
    links = S.linked(spark.createDataFrame([(signed(v),) for v in values], "print long"))
    label = {r["node"]: r["label"] for r in C.components(links).collect()}
    expected = brute_components(prints)
    groups, wanted = {}, {}
    for i, v in prints:
        groups.setdefault(label.get(signed(v), signed(v)), set()).add(v)
        wanted.setdefault(expected[i, v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 700)]
    got = {r["node"]: r["label"] for r in C.components(spark.createDataFrame(chain + star + [(7, 7), (161, 160)], "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 162)}, **{i: 500 for i in range(500, 700)}}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edges(spark):
    rows = [(5, "same words here again", 1), (3, "same words here again", 2), (3, "same words here again", 2), (None, "same words here again", 3), (None, "lonely text", 4), (8, None, 5), (9, "", 6)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, print long"))
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=repr) == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (None, None), (8, 8), (9, 8)], key=repr)
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
