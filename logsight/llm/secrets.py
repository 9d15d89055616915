"""Secret scan with structural confirmation.

Plain patterns give the base findings. Base64 (either alphabet) and hex runs,
joined over line breaks and separators, real or escaped, are candidates for
more: where one starts like a key its own lengths say how far it reaches; it is
decoded, and only what parses as a key encoding (DER nesting with exact
lengths, OpenSSH length-prefixed fields) or as a signed token with a readable
header is reported.
"""
from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "key")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{9,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{10,})(?![A-Za-z0-9_-])")
_ARMOUR = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]{0,40}PRIVATE KEY-----")
_BREAK = re.compile(r"\\{1,8}[rnt]|\\{1,8}(?=[/\r\n])|[\r\n]")
_GLUE = re.compile(r"""["']\s*[+.,&]?\s*["']""")
_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*):\s*(.*)")
_CIPHER = re.compile(r"([A-Za-z0-9-]+),(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_MAGIC = b"openssh-key-v1\0"
#: What stands between two pieces of one run: white space, quotes, commas, escaped breaks, an escaped slash.
_GAP64 = re.compile(r"""(?:[\s"',]|\\{1,8}[nrt]|\\{1,8}(?=[/\r\n]))+""")
_GAP16 = re.compile(r"""(?:[\s"',:;.-]|\\{1,8}[nrt])+|(?=\\x)""")
_PIECES64 = (re.compile(r"([A-Za-z0-9+/]+)"), re.compile(r"([A-Za-z0-9_-]+)"))
_PIECE16 = re.compile(r"(?:0[xX]|\\x)?([0-9A-Fa-f]+)")
_S16 = r"(?:[\s\"',:;.-]|0[xX]|\\x|\\{1,8}[nrt]){0,24}"
# a SEQUENCE, its length, then INTEGER or SEQUENCE; or the OpenSSH magic
_START64 = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))(?:M[A-I](?=[A-Za-z0-9+/_-]{10})|" + base64.b64encode(_MAGIC).decode() + ")")
_START16 = re.compile(rf"(?<![0-9A-Fa-f])(?:30(?={_S16}(?:[0-7][0-9A-Fa-f]|8[1-4](?:{_S16}[0-9A-Fa-f]{{2}}){{1,4}}?){_S16}(?:02|30))|(?i:{_S16.join(f'{c:02x}' for c in _MAGIC)}))")

def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of one DER element that fits before ``end``."""
    if end - at < 2:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or end - at < n:
            return None
        length = int.from_bytes(data[at:at + n], "big")
        at += n
        if length < 0x80:  # DER wants the shortest form
            return None
    return (tag, at, at + length) if at + length <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        if (one := _tlv(data, at, end)) is None or len(out) > 64:
            return None
        out.append(one)
        at = one[2]
    return out


#: Object identifiers of PKCS#5 and of PKCS#12's key encryption.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def is_der_key(data: bytes) -> bool:
    """A private key: one SEQUENCE that fills the data, its elements exact, in
    the shape of PKCS#1, PKCS#8 (plain or encrypted) or SEC1."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _elements(data, top[1], top[2])
    if parts and [p[0] for p in parts] == [0x30, 0x04]:  # EncryptedPrivateKeyInfo: a password-based scheme, then the ciphertext
        scheme = _elements(data, parts[0][1], parts[0][2])
        return bool(scheme) and [x[0] for x in scheme] == [0x06, 0x30] and data[scheme[0][1]:scheme[0][2]].startswith(_PASSWORD_BASED) and parts[1][2] - parts[1][1] >= 16
    if not parts or len(parts) < 3 or parts[0][0] != 0x02:
        return False
    version = int.from_bytes(data[parts[0][1]:parts[0][2]], "big")
    tags = [p[0] for p in parts]
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:  # PKCS#8: algorithm, then the key
        algorithm = _elements(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if version == 1 and tags[1] == 0x04:  # SEC1
        return parts[1][2] - parts[1][1] >= 16
    return len(tags) >= 6 and set(tags) == {0x02}  # PKCS#1, DSA: integers only


def _openssh_length(data: bytes) -> int | None:
    """Where the key that starts the data ends: the magic, then length-prefixed
    fields: cipher, kdf, options, a number of public keys, and the private block."""
    if not data.startswith(_MAGIC):
        return None

    def number(at: int) -> int:
        return int.from_bytes(data[at:at + 4], "big") if at + 4 <= len(data) else len(data)

    at = len(_MAGIC)
    for _ in range(3):
        at += 4 + number(at)
    keys = number(at)
    if not 1 <= keys <= 64:
        return None
    at += 4
    for _ in range(keys + 1):
        at += 4 + number(at)
    return at if at <= len(data) else None


def is_openssh_key(data: bytes) -> bool:
    """Fields that end with the data."""
    return _openssh_length(data) == len(data)


def _der_length(head: bytes) -> int | None:
    """Bytes of the SEQUENCE that starts here, if what it holds starts like a key."""
    if len(head) < 3 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80 or len(head) < 3 + n or head[2 + n] not in (0x02, 0x30):
        return None
    return 2 + n + (int.from_bytes(head[2:2 + n], "big") if n else head[1])


def _decode64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _decode16(text: str) -> bytes | None:
    return binascii.unhexlify(text) if len(text) % 2 == 0 else None


class _Run:
    """The pieces from a place on that only gaps part, as one string of digits."""

    def __init__(self, text: str, at: int, piece: re.Pattern, gap: re.Pattern):
        self.text, self.starts, self.ends, self.before = text, [], [], [0]
        m = piece.match(text, at)
        while m:
            self.starts.append(m.start(1))
            self.ends.append(m.end(1))
            self.before.append(self.before[-1] + m.end(1) - m.start(1))
            g = gap.match(text, m.end())
            m = g and piece.match(text, g.end())

    def digits(self, i: int, least: int) -> str:
        """At least so many digits from piece ``i`` on, if they are there."""
        j = min(bisect_left(self.before, self.before[i] + least), len(self.starts))
        return "".join(self.text[a:b] for a, b in zip(self.starts[i:j], self.ends[i:j]))

    def end(self, i: int, digits: int) -> int | None:
        """Where piece ``i`` and those after it end that hold exactly so many digits."""
        j = bisect_left(self.before, self.before[i] + digits)
        return self.ends[j - 1] if i < j < len(self.before) and self.before[j] == self.before[i] + digits else None


def _run_keys(text: str, start: re.Pattern, piece: re.Pattern, gap: re.Pattern, decode, per_byte: tuple[int, int], least: int) -> list[tuple[int, int]]:
    """Keys in runs of digits; ``per_byte`` digits stand for a byte, as a ratio."""
    up, down = per_byte
    found, run = [], None
    places = [m.span() for m in start.finditer(text)]
    magic = [a for a, b in places if b - a > 2]
    for a, b in places:
        if a and piece.fullmatch(text[a - 1]) and text[max(0, a - 2):a - 1] != "\\":
            continue
        i = bisect_left(run.starts, a) if run else 0
        if run is None or i == len(run.starts) or run.starts[i] != a:
            run, i = _Run(text, a, piece, gap), 0
            if not run.starts:
                run = None
                continue
        if b - a > 2:  # up to the next magic, so that no digit is decoded twice
            k = bisect_left(magic, a) + 1
            stop = bisect_left(run.starts, magic[k]) if k < len(magic) else len(run.starts)
            shown = "".join(text[p:q] for p, q in zip(run.starts[i:stop], run.ends[i:stop]))
            shown = shown[:len(shown) - (len(shown) % 4 == 1 if up == 4 else len(shown) % 2)]
            n = _openssh_length(decode(shown) or b"")
        else:
            shown = run.digits(i, 16)[:16]
            n = _der_length(decode(shown[:len(shown) // 4 * 4]) or b"")
        if n and (end := run.end(i, -(-n * up // down))) and (need := -(-n * up // down)) >= least and is_key(decode(run.digits(i, need))):
            if up == 4:
                end += len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))
            found.append((a, end))
    return found


def _armoured_key(body: str) -> bool:
    """What stands between the PEM lines: perhaps with escaped breaks, quoted
    pieces and headers. Under a legacy cipher (DEK-Info) only the lengths can be checked."""
    lines = _GLUE.sub("\n", _BREAK.sub(lambda m: "\n" if m[0][-1] in "rn\r\n" else " " if m[0][-1] == "t" else "", body)).split("\n")
    lines = [x.strip(" \t\f\v>#*\"',") for x in lines]
    headers = {m[1].lower(): m[2].strip() for x in lines if (m := _HEADER.fullmatch(x))}
    shown = "".join("".join(x.split()) for x in lines if ":" not in x)
    data = _decode64(shown) if _BASE64.fullmatch(shown) else None
    if "ENCRYPTED" in headers.get("proc-type", ""):
        cipher = _CIPHER.fullmatch(headers.get("dek-info", ""))
        return bool(cipher and data) and len(data) >= 16 and len(data) % (16 if "AES" in cipher[1].upper() else 8) == 0
    return is_key(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def is_signed_token(header: str, payload: str) -> bool:
    """Header and payload are base64url JSON objects; the header names its algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """What decodes and parses; the longest of spans that overlap each other."""
    found = [("token", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[1], m[2])] if "." in text else []
    keys = []
    if "PRIVATE KEY" in text:
        marks = list(_ARMOUR.finditer(text))
        keys += [(m.start(), n.end()) for m, n in zip(marks, marks[1:]) if m[1] == "BEGIN" and n[1] == "END" and _armoured_key(text[m.end():n.start()])]
    for piece in _PIECES64:
        keys += _run_keys(text, _START64, piece, _GAP64, _decode64, (4, 3), 40)
    keys += _run_keys(text, _START16, _PIECE16, _GAP16, _decode16, (2, 1), 48)
    end = -1
    for a, b in sorted(set(keys), key=lambda s: (s[0], -s[1])):
        if a >= end:
            found.append(("key", a, b))
            end = b
    return found


def scan(text: str) -> list[tuple[str, int, int]]:
    """All findings by start, then kind."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    for batch in batches:
        out = []
        for text in batch.column(1):
            spans = scan(text.as_py() or "")
            base = [s for s in spans if s[0] in BASE_KINDS]
            kinds = [s[0] for s in base]
            out.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*out))] if out else [batch.column(0), *[pa.array([], pa.int64())] * 3, *[pa.array([], pa.string())] * 2], names)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base findings, their digest,
    and all findings as ``kind:start:end`` (code points, end exclusive).

    Runs where the documents are, without a shuffle. Null and empty texts have
    no findings; repeated rows are scanned alike; other columns are not read.
    Every pattern takes time in proportion to the text.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return source.mapInArrow(_scan_batches, schema).withColumnRenamed("id", id_col)
