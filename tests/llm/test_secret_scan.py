import base64
import hashlib
import json
import re

import pytest

from isobath.llm import secret_scan as S
from isobath.llm.common import table

SF = "/root/testdata/sf0.001"


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(x := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + x
    return bytes([tag]) + size + body


def rsa_key(n=24):
    return tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, bytes([1 + i]) * n) for i in range(8)))


def b64url(data):
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def brute(text):
    spans = []
    for m in re.finditer(r"""(?i:(?a:(password|passwd|secret|token|api_?key)))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    for k, (name, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        spans += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    spans.sort()
    joined = ",".join(f"{n}:{a}:{b}" for a, _, n, b in spans)
    return [sum(x[2] == k for x in spans) for k in ("assign", "access", "hex")] + [hashlib.sha256(joined.encode()).hexdigest()]


TEXTS = [
    None,
    "",
    "é password = 'hunter22' and Token: short, API_KEY=\"abc.def-123\" apikey:xyz",
    "AKIA" + "B" * 16 + " AKIA" + "C" * 15 + " AKIAAKIA" + "D" * 20,
    "x" + "a1" * 12 + " " + "0" * 23 + " " + "f" * 5000,
    "secret=secret=secret=abcdef " * 50,
    "ſecret=abcdefg toKen=abcdefg",
    "-----BEGIN RSA PRIVATE KEY-----" * 200,
]


def digests(spark, rows, schema="doc_id long, text string"):
    return {r["doc_id"]: r for r in S.digest_columns(S.find_secrets(spark.createDataFrame(rows, schema))).collect()}


def test_patterns_against_brute_force(spark):
    found = digests(spark, list(enumerate(TEXTS)))
    for i, text in enumerate(TEXTS):
        r = found[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == brute(text or ""), text


def test_query_against_brute_force(spark):
    from isobath.llm.queries import op10_secret_scan

    got = {r["doc_id"]: r for r in op10_secret_scan(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == brute(d["text"] or "")


def kinds(text):
    return [(k, text[a:b]) for k, a, b in S.confirmed_spans(text)]


def test_signed_token_needs_a_header_with_an_algorithm():
    good = ".".join((b64url(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), b64url(b'{"sub":1}'), b64url(b"0" * 32)))
    bad = ".".join((b64url(json.dumps({"typ": "JWT"}).encode()), b64url(b'{"sub":1}'), b64url(b"0" * 32)))
    assert kinds(f"see {good} and {bad} end") == [("token", good)]
    assert kinds("www.example.com/this-is-a-long.path_name.html") == []


def test_der_keys_are_confirmed_by_nested_lengths():
    key = rsa_key()
    text = base64.b64encode(key).decode()
    assert kinds(f"k {text} k") == [("der", text)]
    assert kinds(f"k {key.hex()} k") == [("der", key.hex())]
    broken = bytearray(key)
    broken[5] ^= 0x10
    assert kinds(f"k {base64.b64encode(bytes(broken)).decode()} k") == []
    assert kinds(f"k {base64.b64encode(b'M' * 90).decode()} k") == []
    pkcs8 = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(5, b"")) + tlv(4, key))
    assert S.key_kind(pkcs8) == "der"
    sec1 = tlv(0x30, tlv(2, b"\1") + tlv(4, b"7" * 32) + tlv(0xA0, tlv(6, b"\x2a\x86\x48")))
    assert S.key_kind(sec1) == "der"


def test_pem_and_openssh():
    body = base64.encodebytes(rsa_key()).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{body}-----END RSA PRIVATE KEY-----"
    assert ("pem", pem) in kinds(f"a {pem} b")
    assert not [k for k, _ in kinds("-----BEGIN RSA PRIVATE KEY-----\nabcd\n-----END RSA PRIVATE KEY-----") if k == "pem"]
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = S.OPENSSH + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 20) + field(b"q" * 30)
    assert S.key_kind(ssh) == "ssh" and S.key_kind(ssh + b"x") is None


def test_edges(spark):
    rows = [(1, None, "a"), (None, "token=abcdef", "b"), (2, "token=abcdef", None), (2, "token=abcdef", None)]
    got = S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in got) == [(0, 1), (1, 0), (2, 1), (2, 1)]
    assert S.find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("text", ["a" * 300_000, "eyJ." * 50_000, "token" + " " * 200_000, "30" * 100_000, "M" * 200_000])
def test_long_texts_take_linear_time(text):
    list(S.pattern_spans(text))
    list(S.confirmed_spans(text))


def pem_of(name, body):
    return f"-----BEGIN {name}-----\n{body}\n-----END {name}-----"


def encrypted_key(oid="2a864886f70d01050d"):
    return tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex(oid)) + tlv(0x30, tlv(4, b"salt4567"))) + tlv(4, b"\x5a" * 64))


def test_encrypted_forms_are_parsed():
    text = lambda data: base64.encodebytes(data).decode().strip()
    good = pem_of("ENCRYPTED PRIVATE KEY", text(encrypted_key()))
    assert ("pem", good) in kinds(f"a {good} b")
    assert kinds(pem_of("ENCRYPTED PRIVATE KEY", "hello this is no key at all")) == []
    assert kinds(pem_of("ENCRYPTED PRIVATE KEY", text(encrypted_key("2a864886f70d010101")))) == []
    alone = base64.b64encode(encrypted_key()).decode()
    assert kinds(f"k {alone} k") == [("der", alone)] and kinds(f"k {encrypted_key().hex()} k") == [("der", encrypted_key().hex())]


def test_older_encrypted_form_needs_headers_and_whole_blocks():
    def form(body, vector="00112233445566778899aabbccddeeff"):
        return pem_of("RSA PRIVATE KEY", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{vector}\n\n{base64.b64encode(body).decode()}")

    assert [k for k, _ in kinds(form(b"z" * 64))] == ["pem"]
    assert kinds(form(b"z" * 60)) == kinds(form(b"z" * 64, "00")) == []
    assert kinds(pem_of("RSA PRIVATE KEY", "this is ENCRYPTED they say and holds no key")) == []


def ssh_key():
    field = lambda x: len(x).to_bytes(4, "big") + x
    return S.OPENSSH + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 20) + field(b"q" * 31)


def test_openssh_in_hex_and_behind_a_border():
    key = ssh_key()
    assert kinds(f"k {key.hex()} k") == [("ssh", key.hex())] and kinds(f"k {key[:-1].hex()} k") == []
    text = base64.b64encode(key).decode()
    assert kinds(f"path/{text} k") == [("ssh", text)]
    der = base64.b64encode(rsa_key()).decode()
    assert kinds(f"old-path/{der} k") == [("der", der)]


def test_keys_over_lines_without_frame():
    lines = base64.encodebytes(rsa_key(60)).decode().strip()
    assert kinds(f"here:\n{lines}\nand more words\n") == [("der", lines)]
    assert kinds(f"here:\n{lines[:-8]}\n\nand more words\n") == []


def test_wrapped_keys_are_opened():
    wrap = lambda oid, key: tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, bytes.fromhex(oid)) + tlv(5, b"")) + tlv(4, key))
    assert S.key_kind(wrap("2a864886f70d010101", rsa_key())) == "der"
    assert S.key_kind(wrap("2a864886f70d010101", b"no key " * 20)) is None
    sec1 = tlv(0x30, tlv(2, b"\1") + tlv(4, b"7" * 32))
    assert S.key_kind(wrap("2a8648ce3d0201", sec1)) == "der" and S.key_kind(wrap("2a8648ce3d0201", sec1[:-1])) is None
    assert S.key_kind(wrap("2b6570", tlv(4, b"k" * 32))) == "der" and S.key_kind(wrap("2b6570", tlv(4, b"k" * 31))) is None


def test_tokens_need_payload_and_signature():
    part = lambda x: b64url(json.dumps(x).encode())
    head, body, sign = part({"alg": "ES256"}), part({"sub": "x"}), b64url(b"s" * 64)
    good = f"{head}.{body}.{sign}"
    assert kinds(f"connection.{good}") == [("token", good)] == kinds(f"a {good}.more")
    assert kinds(f"{head}.{b64url(b'plain words')}.{sign}") == []
    assert kinds(f"{head}.{body}.{sign}AAA") == []
    other = f"{part({'alg': 'ES256', 'typ': 'JOSE'})}.{b64url(b'plain words')}.{sign}"
    assert kinds(other) == [("token", other)]
