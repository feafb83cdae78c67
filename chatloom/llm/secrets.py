"""Secrets in texts: plain patterns, and candidates whose decoded bytes have the structure of a key or a signed token.

A long run of base64 or hex letters is not a secret by its looks. It is reported when it decodes and its bytes parse:
a DER sequence whose nested lengths fit and that begins like a private key, an OpenSSH key file with its length-prefixed
fields, or a token whose first part is JSON that names a signing algorithm. Rows are independent, so the work is one pass
of ``mapInArrow`` without a shuffle.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: the plain kinds, their patterns and least lengths; kinds found by structure follow them in order
ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # of a run that is too short no part is long enough
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "signed_token")

# what makes a candidate: a run that long, or a PEM frame
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
LONG_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{48,}={0,2}(?![A-Za-z0-9+/_=-])")
PEM_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----")
ESCAPED_BREAK = re.compile(r"\\+[nr]")  # as in JSON, however often escaped
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
OPENSSH_MAGIC = b"openssh-key-v1\x00"
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
EC_KEY_OCTETS = (20, 24, 28, 32, 48, 66)


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first content byte, end) of the DER element at ``at``, if its length is well formed and fits."""
    if at + 2 > end:
        return None
    tag, first = data[at], data[at + 1]
    begin, size = at + 2, first
    if first & 0x80:
        n = first & 0x7F
        if not 1 <= n <= 4 or begin + n > end:
            return None
        size = int.from_bytes(data[begin : begin + n], "big")
        if size < 0x80 or data[begin] == 0:  # DER has the shortest form only
            return None
        begin += n
    return (tag, begin, begin + size) if begin + size <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[at:end] exactly."""
    found = []
    while at < end:
        e = _element(data, at, end)
        if e is None:
            return None
        found.append(e)
        at = e[2]
    return found


def is_private_key(data: bytes) -> bool:
    """DER of a private key: the outer and all nested lengths fit, and the fields are those of a known form.

    RSA (version, then eight integers), DSA (version, five integers), EC (version 1, octets of a curve's size), PKCS#8
    (version, algorithm with an object identifier, octets) and its encrypted form (algorithm, octets).
    """
    top = _element(data, 0, len(data))
    if top is None or top[0] != SEQUENCE or top[2] != len(data):
        return False
    parts = _elements(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]

    def algorithm(part: tuple[int, int, int]) -> bool:
        inner = _elements(data, part[1], part[2]) if part[0] == SEQUENCE else None
        return bool(inner) and inner[0][0] == OID and inner[0][2] - inner[0][1] >= 3

    if tags[0] == INTEGER and parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] <= 1:
        if all(t == INTEGER for t in tags) and len(tags) in (6, 9):
            return max(p[2] - p[1] for p in parts) >= 16
        if len(tags) >= 2 and tags[1] == OCTETS:
            return data[parts[0][1]] == 1 and parts[1][2] - parts[1][1] in EC_KEY_OCTETS
        return len(tags) >= 3 and algorithm(parts[1]) and tags[2] == OCTETS and parts[2][2] > parts[2][1]
    return tags == [SEQUENCE, OCTETS] and algorithm(parts[0]) and parts[1][2] - parts[1][1] >= 16


def is_openssh_key(data: bytes) -> bool:
    """OpenSSH key file: magic, cipher, KDF, its options, the number of keys, then public and private blobs that fit."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at = len(OPENSSH_MAGIC)

    def field(at: int) -> tuple[bytes, int] | None:
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return (data[at + 4 : end], end) if end <= len(data) else None

    for _ in range(3):
        f = field(at)
        if f is None:
            return False
        at = f[1]
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return False
    for _ in range(keys + 1):
        f = field(at)
        if f is None or not f[0]:
            return False
        at = f[1]
    return not data[at:].strip(b"\x00")


def decode_base64(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padded or not; None if it can't be one."""
    run = run.rstrip("=")
    if len(run) % 4 == 1 or (("-" in run or "_" in run) and ("+" in run or "/" in run)):
        return None
    try:
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token_header(part: str) -> bool:
    """JSON object that names the algorithm ("alg"), and is not "none": an unsigned token protects nothing."""
    data = decode_base64(part)
    if data is None:
        return False
    try:
        header = json.loads(data)
    except (ValueError, RecursionError):
        return False
    alg = header.get("alg") if isinstance(header, dict) else None
    return isinstance(alg, str) and bool(alg) and alg.lower() != "none"


def _structure(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_private_key(data) else "openssh" if is_openssh_key(data) else None


def pem_bodies(inside: str) -> list[str]:
    """What may be the base64 body between a PEM frame's marks, without the header lines before it.

    Headers end at a blank line, and a header's further lines begin with a blank. Where line breaks are lost or the blank
    line is, the body follows the last word with a colon or a comma, which base64 has none of.
    """
    inside = ESCAPED_BREAK.sub("\n", inside.replace("\r\n", "\n").replace("\\r\\n", "\n")).replace("\\/", "/")
    if ":" not in inside:
        return ["".join(inside.split())]
    lines = [line.rstrip() for line in inside.strip().split("\n")]
    after = "".join("".join(lines[lines.index("") :]).split()) if "" in lines else ""
    words = inside.split()
    last = max(i for i, w in enumerate(words) if ":" in w or "," in w)
    return [after, "".join(words[last + 1 :])]


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans by pattern alone, leftmost and without overlap for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LENGTH]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def structured_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose decoded bytes were confirmed. A candidate inside a confirmed PEM block isn't reported again."""
    found = []
    blocks = []
    if "-----BEGIN " in text:
        begin = None
        for m in PEM_MARK.finditer(text):
            if m[1] == "BEGIN":
                begin = m  # a body holds no dashes, so only the last mark before an end can be its beginning
                continue
            if begin is not None and begin[2] == m[2]:
                inside = text[begin.end() : m.start()]
                bodies = [decode_base64(body) for body in pem_bodies(inside)]
                good = any(_structure(data) is not None for data in bodies)
                if not good and not m[2].startswith("ENCRYPTED") and ":" in inside:  # an encrypted body has no structure
                    good = any(data is not None and len(data) >= 32 for data in bodies)
                if good:
                    blocks.append((begin.start(), m.end()))
                    found.append((begin.start(), m.end(), "pem"))
            begin = None
    if "." in text:
        found += [(*m.span(), "signed_token") for m in DOTTED.finditer(text) if m[3] and is_token_header(m[1])]
    for pattern, decode in ((LONG_HEX, lambda run: bytes.fromhex(run) if len(run) % 2 == 0 else None), (LONG_BASE64, decode_base64)):
        for m in pattern.finditer(text):
            before = bisect.bisect_right(blocks, (m.start(), len(text))) - 1  # blocks are in order and apart
            if (before < 0 or m.end() > blocks[before][1]) and (kind := _structure(decode(m[0]))):
                found.append((*m.span(), kind))
    return found


_ORDER = {kind: i for i, kind in enumerate(KINDS)}


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then by kind as listed in ``KINDS``."""
    return sorted({*plain_spans(text), *structured_spans(text)}, key=lambda s: (s[0], _ORDER[s[2]], s[1]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("by_pattern", pa.bool_())])
PLAIN = frozenset(("assign", "access", "hex"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [
            [{"kind": k, "start": s, "end": e, "by_pattern": k in PLAIN} for s, e, k in find_secrets(t or "")]
            for t in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], names=["key", "spans"])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: ``key`` and ``spans``, an array of struct(kind, start, end, by_pattern).

    Spans are in code points of the whole text, end exclusive, by start and then kind; ``by_pattern`` tells those found
    by pattern alone from those confirmed by structure. A NULL or empty text has no spans. NULL keys and repeated rows
    pass like others, an empty table gives no rows, and other columns are not read.
    """
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_scan, f"key {kind}, spans array<struct<kind: string, start: bigint, end: bigint, by_pattern: boolean>>")
    return found.withColumnRenamed("key", key)
