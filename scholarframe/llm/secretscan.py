"""Secrets in texts: fixed patterns, and encoded keys and tokens that are decoded and parsed before they are reported.

Runs of base64 or hex digits are common and mostly harmless.  A run is reported
only when its bytes have the structure of a secret: a private key whose nested
lengths add up to the last byte (PKCS#1, PKCS#8 plain or encrypted, SEC1, DSA,
PKCS#12, OpenSSH, OpenPGP), or a signed or encrypted token whose header names
an algorithm and whose last part has that algorithm's size.  Decoding is lazy:
of a run only the headers that the parser looks at are decoded, so work is
linear in the text whatever the runs hold.

Candidates are found by array operations over the bytes of many texts at once;
only they are looked at one by one.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.llm.columns import flat, runs, slices

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "key", "token")

# The rules of the base kinds.  Bytes do as well as characters, as all classes are ASCII.
KEYWORD = re.compile(rb"password|passwd|secret|token|api_?key")
ASSIGNED = re.compile(rb"[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]++")
LEAST = {"assign": 12, "access": 18, "hex": 16}

MARK = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----")
#: A header begins with a brace and a quote or white space, and is as long as the shortest one.
HEADER = re.compile(rb"e[wy](?=[A-Za-z0-9_-]{14})")
TOKEN = re.compile(rb"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,4}")
SEQUENCE = re.compile(rb"(?=M[A-P])|(?=b3BlbnNzaC1rZXktdjEA)|(?=LS0tLS1CRUdJTi)")
SEQUENCE_HEX = re.compile(rb"(?=30[0-9a-f]{2}(?:[0-9a-f]{2}){0,4}(?:02|30))|(?=6f70656e7373682d6b65792d7631)|(?=2d2d2d2d2d424547494e)")
#: The shortest runs that can hold a private key.
LEAST_RUN = {False: 40, True: 64}

# Object identifiers of key algorithms and of encryption schemes, as the bytes of their DER bodies.
ALGORITHMS = {
    "2a864886f70d010101": "rsa", "2a8648ce3d0201": "ec", "2a8648ce380401": "dsa", "2a864886f70d010301": "dh",
    "2b6570": "ed25519", "2b656e": "x25519", "2b6571": "ed448", "2b656f": "x448",
}
PASSWORD_SCHEMES = ("2a864886f70d01050", "2a864886f70d010c01")
PKCS7 = "2a864886f70d0107"
#: Bytes of a signature by algorithm, the least and the most.
SIGNATURES = {
    "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114), "none": (0, 0),
    "RS256": (128, 2048), "RS384": (128, 2048), "RS512": (128, 2048), "PS256": (128, 2048), "PS384": (128, 2048), "PS512": (128, 2048),
}

_STANDARD = bytes.maketrans(b"-_", b"+/")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


HEX = _class(b"0123456789abcdef")
ANY_HEX = _class(b"0123456789abcdefABCDEF")
BASE64 = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")


class Encoded:
    """The bytes behind base64 or hex digits from ``first`` on, decoded where they are looked at."""

    def __init__(self, digits: bytes, hexed: bool = False, first: int = 0):
        self.digits, self.hexed, self.first = digits, hexed, first
        left = len(digits) - first
        self.size = left // 2 if hexed else left * 3 // 4

    def take(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end."""
        n = max(0, min(n, self.size - at))
        if self.hexed:
            return bytes.fromhex(self.digits[self.first + 2 * at : self.first + 2 * (at + n)].decode())
        chunk = self.digits[self.first + at // 3 * 4 : self.first - (-(at + n) // 3) * 4]
        return binascii.a2b_base64(chunk + b"A" * (-len(chunk) % 4))[at % 3 : at % 3 + n]


class Plain(Encoded):
    """Bytes that are there already."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def take(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


@dataclass(frozen=True, slots=True)
class Element:
    """A DER element: its tag and where its body lies."""

    tag: int
    start: int
    end: int


def element(v: Encoded, at: int, end: int) -> Element | None:
    """The DER element at ``at`` that lies before ``end``, with its length in the shortest form."""
    head = v.take(at, min(6, end - at))
    if len(head) < 2 or head[0] & 31 == 31:
        return None
    body, size = at + 2, head[1]
    if size >= 128:
        more = size - 128
        if not 1 <= more <= 4 or len(head) < 2 + more or head[2] == 0:
            return None
        body, size = at + 2 + more, int.from_bytes(head[2 : 2 + more], "big")
        if size < 128:
            return None
    return Element(head[0], body, body + size) if body + size <= end else None


def children(v: Encoded, outer: Element, most: int = 12) -> list[Element]:
    """The elements that fill ``outer`` to its last byte; none where they do not."""
    out, at = [], outer.start
    while at < outer.end and len(out) < most:
        e = element(v, at, outer.end)
        if e is None:
            return []
        out.append(e)
        at = e.end
    return out if at == outer.end else []


def _small(v: Encoded, e: Element) -> int:
    """The value of a one-byte integer, -1 for others."""
    return v.take(e.start, 1)[0] if e.tag == 2 and e.end - e.start == 1 else -1


def _identifier(v: Encoded, e: Element) -> str:
    """The object identifier that begins a sequence, as hex."""
    own = element(v, e.start, e.end) if e.tag == 0x30 else None
    return v.take(own.start, own.end - own.start).hex() if own and own.tag == 6 and own.end - own.start <= 16 else ""


def _inner(v: Encoded, octets: Element, name: str) -> bool:
    """Whether the octets of a PKCS#8 key hold what its algorithm asks for."""
    own = element(v, octets.start, octets.end)
    if own is None or own.end != octets.end:
        return False
    if name in ("rsa", "ec"):
        return key_form(v, octets.start, octets.end)[0] == {"rsa": "pkcs1", "ec": "sec1"}[name]
    if name in ("dsa", "dh"):
        return own.tag == 2 and own.end - own.start >= 16
    return own.tag == 4 and own.end - own.start == {"ed448": 57, "x448": 56}.get(name, 32)


def key_form(v: Encoded, at: int = 0, end: int | None = None) -> tuple[str, int]:
    """``(form, bytes)`` of the private key in DER that begins at ``at``; form is empty where there is none."""
    outer = element(v, at, v.size if end is None else end)
    parts = children(v, outer) if outer and outer.tag == 0x30 else []
    size = outer.end - at if outer else 0
    tags, sizes = [e.tag for e in parts], [e.end - e.start for e in parts]
    version = _small(v, parts[0]) if parts else -1
    if tags == [2] * 9 and version == 0 and sizes[1] >= 32 and abs(sizes[4] + sizes[5] - sizes[1]) <= 2:
        return "pkcs1", size
    if tags == [2] * 6 and version == 0 and sizes[1] >= 64 and sizes[2] >= 16 and sizes[5] >= 8:
        return "dsa", size
    if tags[:2] == [2, 4] and version == 1 and 14 <= sizes[1] <= 66 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        return "sec1", size
    if tags[:3] == [2, 0x30, 4] and version in (0, 1) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        name = ALGORITHMS.get(_identifier(v, parts[1]), "")
        return ("pkcs8", size) if name and _inner(v, parts[2], name) else ("", 0)
    if tags == [0x30, 4] and sizes[1] >= 16 and _identifier(v, parts[0]).startswith(PASSWORD_SCHEMES):
        return "pkcs8-encrypted", size
    if tags in ([2, 0x30], [2, 0x30, 0x30]) and version == 3 and _identifier(v, parts[1]).startswith(PKCS7):
        return "pkcs12", size
    return "", 0


def openssh_form(v: Encoded) -> tuple[str, int]:
    """``(form, bytes)`` of an OpenSSH key at the start: names, public keys and the private part, each after its length."""
    at = 15
    if v.take(0, 15) != b"openssh-key-v1\0":
        return "", 0

    def number() -> int:
        nonlocal at
        head = v.take(at, 4)
        at += 4
        return int.from_bytes(head, "big") if len(head) == 4 else -1

    def skip() -> tuple[int, int]:
        nonlocal at
        n = number()
        start, at = at, at + max(n, 0)
        return (start, n) if n >= 0 and at <= v.size else (start, -1)

    start, n = skip()
    cipher = v.take(start, n) if 0 <= n <= 64 else b""
    if not cipher or skip()[1] < 0 or skip()[1] < 0 or not 1 <= (keys := number()) <= 16:
        return "", 0
    if any(skip()[1] < 0 for _ in range(keys)):
        return "", 0
    start, n = skip()
    checks = v.take(start, 8)
    if n < 16 or n % 8 or (cipher == b"none" and checks[:4] != checks[4:]):
        return "", 0
    return ("openssh" if cipher == b"none" else "openssh-encrypted"), at


def openpgp_form(data: bytes) -> str:
    """``openpgp`` where packets fill the data to its last byte and the first is a secret key."""
    at, first = 0, True
    while at < len(data):
        head = data[at]
        if not head & 128:
            return ""
        if head & 64:  # the newer format
            tag, n = head & 63, data[at + 1 : at + 6]
            if not n or 224 <= n[0] < 255:
                return ""
            size, used = (n[0], 1) if n[0] < 192 else ((n[0] - 192 << 8) + n[1] + 192, 2) if n[0] < 224 and len(n) > 1 else (int.from_bytes(n[1:5], "big"), 5)
        else:
            tag, used = head >> 2 & 15, (1, 2, 4, 0)[head & 3]
            if not used:
                return ""
            size = int.from_bytes(data[at + 1 : at + 1 + used], "big")
        if first and (tag != 5 or size < 12 or data[at + 1 + used : at + 2 + used] not in (b"\3", b"\4", b"\5", b"\6")):
            return ""
        first, at = False, at + 1 + used + size
    return "openpgp" if at == len(data) and not first else ""


_HEADER = re.compile(rb"(?m)^[ \t]*[A-Za-z][A-Za-z-]*: [^\r\n]*(?:\r?\n|\Z)")
_PAD = re.compile(rb"={0,2}")
_FILLER = re.compile(rb"\\[nr]|[\s\"',]+")


def pem_form(label: bytes, body: bytes) -> str:
    """What a block between PEM marks holds, empty where it does not parse."""
    spread = re.sub(rb"\\r|\\n", b"\n", body)
    digits = _FILLER.sub(b"", _HEADER.sub(b"", spread))
    if label.endswith(b"BLOCK"):
        digits = re.sub(rb"=[A-Za-z0-9+/]{4}\Z", b"", digits)  # the check sum of an armour
    if not digits or len(digits) % 4 or not re.fullmatch(rb"[A-Za-z0-9+/]*+={0,2}", digits):
        return ""
    data = binascii.a2b_base64(digits)
    if label.endswith(b"BLOCK"):
        return openpgp_form(data)
    if b"DEK-Info: " in spread and b"ENCRYPTED" in spread:
        return "pem-encrypted" if len(data) % 8 == 0 else ""
    for form, size in (openssh_form(Plain(data)), key_form(Plain(data))):
        if form and size == len(data):
            return form
    return ""


def _decoded(part: bytes) -> bytes | None:
    """The bytes of a part of a token; none where it is no base64."""
    if len(part) % 4 == 1:
        return None
    return base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))


def _object(data: bytes | None) -> dict:
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def token_form(parts: list[bytes]) -> tuple[str, int]:
    """``(form, characters)`` of a signed or encrypted token in compact form, from its parts between points."""
    header = _object(_decoded(parts[0]))
    name = header.get("alg")
    if not isinstance(name, str):
        return "", 0
    if "enc" in header:
        if len(parts) < 5:
            return "", 0
        own = [_decoded(p) for p in parts[1:5]]
        good = all(p is not None for p in own) and len(own[1]) in (12, 16) and len(own[3]) in (16, 24, 32) and own[2]
        return (f"jwe:{name}", sum(map(len, parts[:5])) + 4) if good else ("", 0)
    least, most = SIGNATURES.get(name, (-1, -1))
    signature = _decoded(parts[2])
    if signature is None or not least <= len(signature) <= most or not _object(_decoded(parts[1])):
        return "", 0
    return f"jwt:{name}", sum(map(len, parts[:3])) + 2


@dataclass(slots=True)
class Span:
    kind: str
    start: int
    end: int
    form: str | None = None


def _pems(data: bytes, start: int, end: int) -> Iterator[Span]:
    """Blocks between a pair of PEM marks with nothing but their body between, that parse."""
    begun = None
    for m in MARK.finditer(data, start, end):
        if m[1] == b"BEGIN":
            begun = m
        elif begun and begun[2] == m[2]:
            if form := pem_form(m[2], data[begun.end() : m.start()]):
                yield Span("pem", begun.start(), m.end(), form)
            begun = None


def _in_run(digits: bytes, hexed: bool) -> tuple[str, str, int] | None:
    """``(kind, form, first)``: the secret that fills a run of digits from its digit ``first`` to the last."""
    for m in (SEQUENCE_HEX if hexed else SEQUENCE).finditer(digits):
        v, sign = Encoded(digits, hexed, m.start()), digits[m.start() : m.start() + 1]
        if sign in (b"2", b"L"):  # a whole PEM file, encoded once more
            text = v.take(0, v.size)
            inner = next(_pems(text, 0, len(text)), None)
            return ("pem", f"encoded {inner.form}", m.start()) if inner else None
        form, size = openssh_form(v) if sign in (b"6", b"b") else key_form(v)
        if form and (2 * size if hexed else -(-size * 4 // 3)) == len(digits) - m.start():
            return "key", form, m.start()
    return None


def _long_runs(table: np.ndarray, buf: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """The maximal runs of ``least`` bytes or more of a class, which never cross a row's end."""
    starts, ends = runs(table[buf], offsets)
    long = ends - starts >= least
    return zip(starts[long].tolist(), ends[long].tolist(), strict=True)


def secrets_of(data: bytes, offsets: np.ndarray) -> list[tuple[int, Span]]:
    """``(row, span)`` of all secrets in rows that lie end to end, in places of bytes; spans never cross rows."""
    out: list[tuple[int, Span]] = []
    buf = np.frombuffer(data, np.uint8)

    def row_of(at: int) -> int:
        return int(np.searchsorted(offsets, at, "right")) - 1

    def stop_of(at: int) -> int:
        return int(offsets[row_of(at) + 1])

    def add(span: Span) -> None:
        out.append((row_of(span.start), span))

    lower, at = data.translate(_LOWER), 0
    while m := KEYWORD.search(lower, at):
        stop = stop_of(m.start())
        own = ASSIGNED.match(data, m.end(), stop) if m.end() <= stop else None
        if own and own.end() - own.start(1) >= LEAST["assign"]:
            add(Span("assign", m.start(), own.end()))
        at = own.end() if own else m.start() + 1
    at = data.find(b"AKIA")
    while at >= 0:
        stop = stop_of(at)
        m = ACCESS.match(data, at, stop)
        if m and len(m[0]) >= LEAST["access"]:
            known = len(m[0]) == 20 and re.fullmatch(rb"[A-Z2-7]{16}", m[0][4:])
            add(Span("access", at, m.end(), "access-id" if known else None))
        at = data.find(b"AKIA", m.end() if m else at + 1)
    for a, b in _long_runs(HEX, buf, offsets, LEAST["hex"]):
        add(Span("hex", a, b))
    found: list[tuple[int, Span]] = []
    for row in sorted({row_of(m.start()) for m in re.finditer(rb"-----BEGIN ", data)}):
        found += [(row, s) for s in _pems(data, int(offsets[row]), int(offsets[row + 1]))]
    blocks, ends = [s.start for _, s in found], [s.end for _, s in found]
    for hexed, table in ((False, BASE64), (True, ANY_HEX)):
        for a, b in _long_runs(table, buf, offsets, LEAST_RUN[hexed]):
            k = bisect_right(blocks, a) - 1
            if k >= 0 and a < ends[k]:
                continue  # a line of a block
            digits = data[a:b].lower() if hexed else data[a:b].translate(_STANDARD)
            if own := _in_run(digits, hexed):
                pad = 0 if hexed else len(_PAD.match(data, b, stop_of(a))[0])
                found.append((row_of(a), Span(own[0], a + own[2], b + pad, own[1])))
    last = 0
    for m in HEADER.finditer(data):
        row = row_of(m.start())
        before = m.start() > offsets[row] and BASE64[data[m.start() - 1]] and data[m.start() - 1] not in b"+/"
        whole = None if before or m.start() < last else TOKEN.match(data, m.start(), int(offsets[row + 1]))
        form, size = token_form(whole[0].split(b".")) if whole else ("", 0)
        if form:
            last = m.start() + size
            found.append((row, Span("token", m.start(), last, form)))
    found.sort(key=lambda x: x[1].start)
    begins = [s.start for _, s in found]
    for row, s in out:  # a base span is confirmed by the structure it holds or lies in
        k = bisect_left(begins, s.end) - 1
        if s.form is None and k >= 0 and found[k][0] == row and found[k][1].end > s.start:
            s.form = found[k][1].form
    return out + found


def _code_points(buf: np.ndarray, offsets: np.ndarray, places: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of bytes as code points from the start of their rows."""
    marks = np.unique(np.r_[0, places, offsets[rows]])
    inner = marks[marks < len(buf)]
    counts = np.add.reduceat(((buf & 0xC0) != 0x80).view(np.uint8), inner, dtype=np.int64)
    before = np.r_[0, np.cumsum(counts)][: len(marks)]
    return before[np.searchsorted(marks, places)] - before[np.searchsorted(marks, offsets[rows])]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("form", pa.string())]))


def _spans_of(texts: pa.Array) -> list[list[dict]]:
    buf, offsets = flat(texts)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    found = secrets_of(buf.tobytes(), offsets)
    if not found:
        return out
    rows = np.array([r for r, _ in found])
    starts = _code_points(buf, offsets, np.array([s.start for _, s in found]), rows).tolist()
    ends = _code_points(buf, offsets, np.array([s.end for _, s in found]), rows).tolist()
    for (row, s), a, b in zip(found, starts, ends, strict=True):
        out[row].append({"kind": s.kind, "start": a, "end": b, "base": s.kind in BASE_KINDS, "form": s.form})
    for own in out:
        own.sort(key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))
    return out


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with the secrets of every whole text, an array of ``(kind, start, end, base, form)``.

    Spans count code points, the end exclusive, and are ordered by start, then
    by kind.  Base kinds are the matches of fixed patterns: ``assign`` (a key
    word and a value of 12 or more characters), ``access`` (an access key's
    name) and ``hex`` (16 or more lower-case digits); they are always there.
    ``pem``, ``key`` and ``token`` are there only where they decode and parse;
    ``form`` says as what, and stands at base spans too that hold or lie in
    such a secret or, for ``access``, are 20 characters with a base32 name.
    Null and empty texts have no spans.  A map over the rows, so repeated rows
    and any number of them are alike; an existing column named ``into`` is
    replaced, others stay.
    """

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,base:boolean,form:string>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            own: list[list[dict]] = []
            for a, b in slices(texts):
                own += _spans_of(texts.slice(a, b - a))
            yield pa.array(own, _SPANS)

    return docs.withColumn(into, found(F.col(text_col).cast("string")))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
