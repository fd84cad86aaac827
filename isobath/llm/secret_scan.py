"""Secret scanning with structural confirmation.

Pattern candidates (assignments, access keys, long hex runs) are reported as they are.  Runs of
base64 and hex are decoded, and reported only if the bytes parse as what they seem to be:

* ``token``: a signed token, whose header is a JSON object naming an algorithm, whose payload is JSON
  unless the header says it is something else, and whose signature decodes;
* ``der``: a PKCS#1, PKCS#8, SEC1 or encrypted PKCS#8 private key, whose nested lengths fit exactly down
  to the key inside the PKCS#8 wrapping; in one run or over lines;
* ``ssh``: an OpenSSH private key whose length-prefixed fields fit;
* ``pem``: a frame whose body is one of these, or, in the older encrypted form, whole cipher blocks
  behind their two headers.

Runs that begin inside another (behind a word and a slash) are tried at each such border: a DER
key's header says how long it is, so that takes no decoding.

Defined results: null text is empty; very long texts are scanned whole, in linear time; rows are
independent, so repeated rows give repeated results; an empty table gives no rows; other columns of
the input are not looked at, and the output has the id under its own name and ``spans``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import decoded, slices, text_rows

#: Kinds in their fixed order: the patterns', then what structure confirms.
KINDS = ("assign", "access", "hex", "token", "pem", "der", "ssh")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)++")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}+={0,2}")
BORDER = re.compile(r"(?:^|(?<=[+/_-]))(?=M|b3BlbnNzaC1rZXktdjEA)")
#: The first line of a key that goes on in the next, and what its lines may hold.
WRAPPED = re.compile(r"(?m)^[\x20\t]*+(?=M[A-Za-z0-9+/]{39,75}+\r?$)")
LINES = re.compile(r"[A-Za-z0-9+/=]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/=]++)*+")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)[0-9A-Fa-f]{62,}+")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
LEGACY = re.compile(r"\s*Proc-Type: *4,ENCRYPTED\s+DEK-Info: *(DES-CBC|DES-EDE3-CBC|AES-(?:128|192|256)-CBC), *([0-9A-Fa-f]+)\s+([A-Za-z0-9+/=\s]+)")
#: Bytes of the longest key that is looked for over lines.
LONGEST = 1 << 14

SEQUENCE, INTEGER, BITS, OCTETS, OID = 0x30, 0x02, 0x03, 0x04, 0x06
OPENSSH = b"openssh-key-v1\0"


def der_items(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill ``data[begin:end]``; None unless they do, exactly."""
    found = []
    while begin < end:
        if end - begin < 2:
            return None
        tag, size, at = data[begin], data[begin + 1], begin + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        begin = at + size
    return found


#: Object identifiers as DER holds them: key algorithms, and the families that encrypt keys.
RSA, EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
CURVES = {bytes([0x2B, 0x65, k]): n for k, n in ((110, 32), (111, 56), (112, 32), (113, 57))}
ENCRYPTION = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")


def der_body(data: bytes) -> list[tuple[int, int, int]] | None:
    """What is in the one sequence that fills ``data``."""
    outer = der_items(data, 0, len(data)) if data[:1] == b"\x30" else None
    return der_items(data, *outer[0][1:]) if outer and len(outer) == 1 else None


def is_rsa_key(data: bytes) -> bool:
    inner = der_body(data)
    return bool(inner) and [x[0] for x in inner[:9]] == [INTEGER] * 9 and len(inner) in (9, 10) and data[inner[0][1] : inner[0][2]] in (b"\0", b"\1")


def is_ec_key(data: bytes) -> bool:
    inner = der_body(data)
    if not inner or len(inner) < 2 or [x[0] for x in inner[:2]] != [INTEGER, OCTETS] or data[inner[0][1] : inner[0][2]] != b"\1":
        return False
    return {x[0] for x in inner[2:]} <= {0xA0, 0xA1} and all(der_items(data, a, b) for _, a, b in inner[2:])


def is_wrapped_key(data: bytes) -> bool:
    """PKCS#8: version, algorithm, and the key that the algorithm says, in an octet string."""
    inner = der_body(data)
    if not inner or [x[0] for x in inner[:3]] != [INTEGER, SEQUENCE, OCTETS] or data[inner[0][1] : inner[0][2]] not in (b"\0", b"\1"):
        return False
    algorithm = der_items(data, *inner[1][1:])
    if not algorithm or algorithm[0][0] != OID or {x[0] for x in inner[3:]} - {0xA0, 0x81, 0xA1}:
        return False
    name, key = data[algorithm[0][1] : algorithm[0][2]], data[inner[2][1] : inner[2][2]]
    if name == RSA:
        return is_rsa_key(key)
    if name == EC:
        return is_ec_key(key)
    if name in CURVES:
        return len(key) == CURVES[name] + 2 and key[:2] == bytes([OCTETS, CURVES[name]])
    return bool(der_items(key, 0, len(key)))


def is_encrypted_key(data: bytes) -> bool:
    """Encrypted PKCS#8: an algorithm that encrypts keys, and an octet string."""
    inner = der_body(data)
    if not inner or [x[0] for x in inner] != [SEQUENCE, OCTETS] or inner[1][1] == inner[1][2]:
        return False
    algorithm = der_items(data, *inner[0][1:])
    return bool(algorithm) and algorithm[0][0] == OID and data[algorithm[0][1] : algorithm[0][2]].startswith(ENCRYPTION)


def is_der_key(data: bytes) -> bool:
    """A private key in DER: the right fields, whose nested lengths fit exactly."""
    return len(data) >= 32 and (is_rsa_key(data) or is_wrapped_key(data) or is_ec_key(data) or is_encrypted_key(data))


def der_size(text: str) -> int | None:
    """Bytes of the DER sequence whose base64 begins with ``text``."""
    head = from_base64(text[:8])
    if not head or len(head) < 6 or head[0] != SEQUENCE:
        return None
    n = head[1] & 0x7F
    if not head[1] & 0x80:
        return 2 + n
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else None


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: magic, then length-prefixed fields that fill the rest."""
    if not data.startswith(OPENSSH):
        return False
    at, fields = len(OPENSSH), 0
    while fields < 3:  # cipher, key derivation and its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
    if at + 4 > len(data) or not 1 <= (keys := int.from_bytes(data[at : at + 4], "big")) <= 64:
        return False
    at += 4
    for _ in range(keys + 1):  # public keys, then the private part
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def from_base64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64, with or without padding."""
    body = text.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def json_object(part: str) -> dict[str, object] | None:
    data = from_base64(part)
    if not data or data.lstrip()[:1] != b"{":
        return None
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(header: str, payload: str, signature: str) -> bool:
    head = json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or len(payload) < 2:
        return False
    if from_base64(payload) is None or from_base64(signature) is None:
        return False
    return str(head.get("typ", "JWT")).upper() != "JWT" or json_object(payload) is not None


def token_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in DOTTED.finditer(text):
        parts, begin, skip = m[0].split("."), m.start(), 0
        for k, part in enumerate(parts[:-1]):
            if k >= skip and len(part) >= 8 and part[0] in "eI" and is_token(part, parts[k + 1], third := parts[k + 2] if k + 2 < len(parts) else ""):
                yield "token", begin, begin + len(part) + 1 + len(parts[k + 1]) + (1 + len(third) if k + 2 < len(parts) else 0)
                skip = k + 3
            begin += len(part) + 1


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def pattern_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def is_legacy(body: str) -> bool:
    """The older encrypted form: its two headers, a vector of the cipher's size, and whole blocks."""
    m = LEGACY.fullmatch(body)
    data = from_base64("".join(m[3].split())) if m else None
    block = 8 if m and m[1].startswith("DES") else 16
    return bool(data) and len(data) % block == 0 and len(m[2]) == 2 * block


def pem_spans(text: str) -> Iterator[tuple[str, int, int]]:
    begins = list(PEM.finditer(text)) if "PRIVATE KEY-----" in text else []
    closes: dict[str, int] = {}
    for m, after in zip(begins, [*(x.start() for x in begins), len(text)][1:], strict=True):
        if -1 < (close := closes.get(m[1], 0)) < m.end():  # looked for once per stretch: linear
            close = closes[m[1]] = text.find(f"-----END {m[1]}-----", m.end())
        if not -1 < close < after:
            continue
        body = text[m.end() : close]
        if key_kind(from_base64("".join(body.split()))) or "DEK-Info" in body and is_legacy(body):
            yield "pem", m.start(), close + len(m[1]) + 14


def run_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys in one run of base64, from its start or a border inside it to its end."""
    for m in BASE64.finditer(text):
        run = m[0].rstrip("=")
        borders = [x.start() for x in BORDER.finditer(run)]
        ssh = [at for at in borders if run[at] == "b"]
        for at in borders:
            # of OpenSSH keys, whose length isn't in front, the first and the last border are tried
            size = der_size(run[at : at + 8]) if run[at] == "M" else None
            if size and len(run) - at == -(-size * 4 // 3) or at in ssh[:1] + ssh[-1:]:
                kind = key_kind(from_base64(run[at:]))
                if kind:
                    yield kind, m.start() + at, m.end()
                    break


def wrapped_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """DER keys over several lines."""
    for m in WRAPPED.finditer(text):
        size = der_size(text[m.end() : m.end() + 8])
        if not size or not 32 <= size <= LONGEST:
            continue
        wanted = -(-size // 3) * 4
        lines = LINES.match(text, m.end(), min(len(text), m.end() + 3 * wanted))
        held = 0
        for line in re.finditer("[A-Za-z0-9+/=]+", lines[0]) if lines else ():
            held += len(line[0])
            if held >= wanted:
                if held == wanted and is_der_key(from_base64("".join(lines[0][: line.end()].split())) or b""):
                    yield "der", m.end(), m.end() + line.end()
                break


def confirmed_spans(text: str) -> Iterator[tuple[str, int, int]]:
    yield from token_spans(text)
    framed = list(pem_spans(text))
    yield from framed
    inside = iter([*framed, ("", len(text) + 1, len(text) + 1)])
    frame = next(inside)
    for kind, a, b in sorted({*run_spans(text), *wrapped_spans(text)}, key=lambda x: x[1]):
        while frame[2] <= a:
            frame = next(inside)
        if not frame[1] <= a < frame[2]:
            yield kind, a, b
    for m in HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            yield kind, m.start(), m.end()


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id and ``spans``, code point offsets with exclusive ends."""
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = []
                for text in decoded(part.column(1)):
                    spans = [*pattern_spans(text), *confirmed_spans(text)]
                    found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _ARROW_SPANS)], names=["id", "spans"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("spans", SPANS)])
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the pattern kinds, the digest of their spans, and all spans as text."""
    place = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), place(x).alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("o", lambda x: x["place"] <= 3)
    return found.withColumn("o", ordered).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("o")).alias("spans"))
