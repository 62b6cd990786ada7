"""Secret scans with structural confirmation."""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame

from termloom.llm.common import map_texts

# fixed values: the base patterns
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "key", "jwt")

BASE64 = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}")
HEX_ANY = re.compile(r"[0-9a-fA-F]{64,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{9,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at `at`, if it fits before `end` and its length is written the shortest way."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(data[at : at + size]), at + size
        if n < 0x80 or n < 1 << 8 * (size - 1):
            return None
    return (tag, at, at + n) if at + n <= end else None


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill start to end exactly."""
    out = []
    while start < end:
        if not (e := element(data, start, end)):
            return None
        out.append(e)
        start = e[2]
    return out


def der_key(data: bytes) -> str | None:
    """The kind of private key that a DER encoding holds: its nested lengths must fill it exactly."""
    if len(data) < 32 or data[0] != 0x30 or not (top := element(data, 0, len(data))) or top[2] != len(data):
        return None
    if not (parts := children(data, top[1], top[2])) or parts[0][0] != 0x02:
        return None
    tags, version = [t for t, _, _ in parts], data[parts[0][1] : parts[0][2]]
    if len(parts) >= 9 and tags[:9] == [2] * 9 and version in (b"\0", b"\1"):
        return "rsa"
    if len(parts) == 6 and tags == [2] * 6 and version == b"\0":
        return "dsa"
    if len(parts) >= 3 and tags[:3] == [0x02, 0x30, 0x04] and version in (b"\0", b"\1"):
        inner = children(data, *parts[1][1:])
        return "pkcs8" if inner and inner[0][0] == 0x06 else None
    if len(parts) >= 2 and tags[:2] == [0x02, 0x04] and version == b"\1" and set(tags[2:]) <= {0xA0, 0xA1}:
        return "ec"
    return None


OPENSSH = b"openssh-key-v1\0"


def openssh_key(data: bytes) -> bool:
    """Whether the length-prefixed fields after the magic fill the data."""
    if not data.startswith(OPENSSH):
        return False
    at, fields = len(OPENSSH), 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4])
        if fields == 3:  # the number of keys stands after cipher, derivation and its options
            if not 1 <= n <= 64:
                return False
            at, fields = at + 4, fields + 1
            continue
        if at + 4 + n > len(data):
            return False
        at, fields = at + 4 + n, fields + 1
    return at == len(data) and fields >= 6


def decoded(text: str, alphabet: str = "+/") -> bytes | None:
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=alphabet.encode(), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key(data: bytes | None) -> bool:
    return data is not None and (der_key(data) is not None or openssh_key(data))


def is_signed(header: str, payload: str) -> bool:
    """Whether the header decodes to a JSON object that names an algorithm, and the payload to a JSON object where the algorithm leaves it readable."""
    try:
        head = json.loads(decoded(header, "-_") or b"")
        if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
            return False
        return isinstance(json.loads(decoded(payload, "-_") or b""), dict)
    except (ValueError, RecursionError):
        return False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns, unordered."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans that count only once their structure is confirmed: private keys (armoured, base64, hex) and signed tokens."""
    found = {(m.start(), m.end()) for m in PEM.finditer(text) if is_key(decoded(re.sub(r"\s+", "", m[2])))} if "PRIVATE KEY-----" in text else set()
    armoured = sorted(found)
    inside = lambda a: any(s <= a < e for s, e in armoured)
    for m in BASE64.finditer(text):
        # keys begin with a SEQUENCE (0x30) or with the magic of the length-prefixed form
        if m[0].startswith(("M", "b3BlbnNzaC1rZXk")) and not inside(m.start()) and is_key(decoded(m[0])):
            found.add((m.start(), m.end()))
    for m in HEX_ANY.finditer(text):
        if m[0].startswith(("30", "6f70656e737368", "6F70656E737368")) and len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
            found.add((m.start(), m.end()))
    out = [(a, 3, b) for a, b in found]
    if "." in text:
        out += [(m.start(), 4, m.end()) for m in SIGNED.finditer(text) if is_signed(m[1], m[2])]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(texts: list[str]) -> list[list]:
    rows = []
    for t in texts:
        base = sorted(base_spans(t))
        more = confirmed_spans(t)
        kinds = [k for _, k, _ in base + more]
        rows.append((*(kinds.count(k) for k in range(5)), joined(base), joined(sorted(base + more))))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(7)]


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets in whole texts.

    Base spans are the three patterns above. Added spans are reported only if decoding confirms
    them: `key`, a private key in base64, hex or armour whose DER lengths (or length-prefixed
    fields) nest exactly; `jwt`, a signed token whose header and payload decode to JSON.

    Returns the id, `n_assign`, `n_access`, `n_hex`, `n_key`, `n_jwt`, `base_spans` and `spans`
    (kind:start:end in code points, by start, then kind, comma-joined). Other columns of `docs`
    are not read, so their names cannot clash. A null or empty text has no spans; repeated rows
    give repeated rows; an empty table gives an empty table.
    """
    return map_texts(docs, id_col, text_col, scan, "n_assign long, n_access long, n_hex long, n_key long, n_jwt long, base_spans string, spans string")
