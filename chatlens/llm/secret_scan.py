"""Secrets in texts: pattern spans, and keys and signed tokens confirmed by their structure.

The plain kinds (assign, access, hex) are spans of patterns. The others are reported only
after the candidate has been decoded and parsed: a private key must be a complete ASN.1
value whose nested lengths fit exactly, or a complete OpenSSH container; a signed token
must have a JSON header that names a signing algorithm, a JSON body, and a signature of
the length which that algorithm makes.
"""

from __future__ import annotations

import base64
import binascii
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.texts import map_columns

# The kinds in the order in which spans with one start are listed.
KINDS = ["assign", "access", "hex", "pem", "key", "jwt"]
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a greedy run of 32 or more; shorter runs are dropped anyway
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s*[A-Za-z-]+:\x20[^\n]*\n)*)([A-Za-z0-9+/=\s]*)-----END \1-----")
# The same with line breaks written as escapes, as in JSON strings and settings files.
_ESCAPED_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----"
    r"((?:(?:\s|\\+[nr])*[A-Za-z-]+:\x20(?:[^\n\\]|\\(?![nr\\]))*(?:\n|\\+[nr]))*)"
    r"([A-Za-z0-9+/=\s]*(?:\\+[nr][A-Za-z0-9+/=\s]*)*)-----END \1-----")
_BASE64_KEY = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))(?:M|b3Blb)[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
# Tried at each word, so that a name before a token hides nothing. The least lengths are those of
# {"alg":"HS256"}, of {} and of 32 bytes.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{20,}+)\.([A-Za-z0-9_-]{3,}+)\.([A-Za-z0-9_-]{43,}+))")

# Signature bytes of signing algorithms; RSA signatures have the length of the key.
_SIGNATURE_BYTES = {
    "HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114},
}
_RSA_ALGORITHMS = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is not base64.

    Line breaks may be written as escapes.
    """
    body = re.sub(r"\s+|\\+[nr]", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the ASN.1 values that fill ``data`` exactly; None if the lengths do not fit."""
    at, items = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 8 or at + n > len(data):
                return None
            length = int.from_bytes(data[at:at + n], "big")
            at += n
        if at + length > len(data):
            return None
        items.append((tag, data[at:at + length]))
        at += length
    return items


_INTEGER, _BYTES, _OBJECT, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _starts(items: list[tuple[int, bytes]] | None, *tags: int) -> bool:
    return bool(items) and len(items) >= len(tags) and all(i[0] == t for i, t in zip(items, tags))


def is_der_key(data: bytes) -> bool:
    """A private key as PKCS#1, PKCS#8 (plain or encrypted) or SEC 1."""
    outer = der_items(data)
    if not _starts(outer, _SEQUENCE) or len(outer) != 1:
        return False
    inside = der_items(outer[0][1])
    if _starts(inside, _SEQUENCE, _BYTES) and len(inside) == 2:
        return _starts(der_items(inside[0][1]), _OBJECT)
    if not _starts(inside, _INTEGER, _INTEGER) or len(inside[0][1]) != 1:
        if _starts(inside, _INTEGER, _SEQUENCE, _BYTES) and inside[0][1] in (b"\0", b"\1"):
            return _starts(der_items(inside[1][1]), _OBJECT) and len(inside[2][1]) >= 16
        return _starts(inside, _INTEGER, _BYTES) and inside[0][1] == b"\1" and 16 <= len(inside[1][1]) <= 80
    # PKCS#1: version, modulus, public and private exponent, two primes, two exponents, coefficient.
    return len(inside) >= 9 and all(tag == _INTEGER and body for tag, body in inside[:9]) and len(inside[1][1]) >= 32


def is_openssh_key(data: bytes) -> bool:
    """The container of OpenSSH private keys: length-prefixed fields that fill it exactly."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size:at]

    cipher, kdf, options = field(), field(), field()
    if None in (cipher, kdf, options) or not cipher or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return False
    fields = [field() for _ in range(keys + 1)]
    return all(fields) and at == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def _json_object(part: str):
    data = decode_base64(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(header: str, body: str, signature: str) -> bool:
    head = _json_object(header)
    alg = head.get("alg") if head else None
    signed = decode_base64(signature)
    if not isinstance(alg, str) or signed is None or _json_object(body) is None:
        return False
    if alg in _RSA_ALGORITHMS:
        return len(signed) >= 128
    return len(signed) in _SIGNATURE_BYTES.get(alg, ())


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans in code points, by start and then by kind as listed."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    blocks = []
    if "-----BEGIN " in text:
        escaped = _ESCAPED_PEM.finditer(text) if "\\n" in text or "\\r" in text else ()
        for m in itertools.chain(_PEM.finditer(text), escaped):
            if m.span() in blocks:
                continue
            encrypted = "ENCRYPTED" in m[2]  # the body of an old encrypted block has no structure to read
            data = decode_base64(m[3])
            if is_key(data) or encrypted and data and len(data) >= 64 and len(data) % 8 == 0:
                blocks.append(m.span())
    found += [("pem", *b) for b in blocks]
    outside = lambda m: not any(a <= m.start() and m.end() <= b for a, b in blocks)
    found += [("key", *m.span()) for m in _BASE64_KEY.finditer(text) if outside(m) and is_key(decode_base64(m[0]))]
    found += [
        ("key", *m.span()) for m in _HEX_KEY.finditer(text)
        if len(m[0]) % 2 == 0 and outside(m) and is_key(bytes.fromhex(m[0]))
    ]
    found += [("jwt", m.start(1), m.end(3)) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, text: str = "text", keep=None) -> DataFrame:
    """Add ``spans``, an array of (kind, start, end).

    Null and empty texts have none. Rows are judged one by one, so repeated rows get the same
    spans; other columns pass through and a column named ``spans`` is replaced.
    """

    def run(texts: pa.Array):
        return [pa.array([
            [{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t)] if t else [] for t in texts.to_pylist()
        ], _SPANS)]

    return map_columns(docs, [text], "spans array<struct<kind:string,start:int,end:int>>", run, keep)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replace the spans of ``find_secrets`` in ``text``; spans that overlap or touch give one mark."""

    def run(texts: pa.Array, spans: pa.Array):
        out = []
        for t, found in zip(texts.to_pylist(), spans.to_pylist()):
            if not t or not found:
                out.append(t)
                continue
            pieces, end = [], -1
            for s in sorted(found, key=lambda s: (s["start"], s["end"])):
                if s["start"] > end:
                    pieces += [t[max(end, 0):s["start"]], mark]
                end = max(end, s["end"])
            out.append("".join(pieces) + t[end:])
        return [out]

    return map_columns(df, [text, "spans"], f"`{text}` string", run)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and span lists of ``documents``."""
    found = find_secrets(docs.select("doc_id", "text"), keep=["doc_id"])
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(BASE_KINDS))
    return found.select(
        "doc_id",
        *[_count(spans, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )
