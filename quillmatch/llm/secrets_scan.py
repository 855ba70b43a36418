"""Operator 9: secret scans with structural confirmation.

Three base patterns report by their form alone. Beyond them, every maximal run of base64 (MIN_BASE64 digits or more) or hex (MIN_HEX) is
decoded whole and reported only if what it holds parses: DER private keys whose nested lengths all close (plain, or encrypted by a password),
the binary OpenSSH form, PEM blocks around either (with headers, or with line ends written out as in JSON), and signed tokens whose header and claims decode to JSON with an algorithm. Decoded text is looked through
in the same way, so a PEM block or a token in base64 is found too; its kind is then key or token. A run that isn't a key as a whole may hold one: where a
key's first bytes stand in it, its outer length says how far to read on, over line breaks too (its parts' heads are read first, so this takes linear time), so a key behind a letter or path, or wrapped over lines
without markers, is found if it is at most MAX_INNER bytes long. So is DER in hex with a colon between bytes. Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.workers import sparing

#: The kinds in the order in which they are listed.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "pem", "token")

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HINT = re.compile(r"(?ai:passw|secre|token|api)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_HEX, MIN_BASE64 = 48, 32
HEX_KEY = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{{MIN_HEX},}}")
BASE64_KEY = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_BASE64},}}={{0,2}}")
PEM_LINE = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY)-----")
#: Line ends that are written out, as in JSON and shell variables.
ESCAPED_ENDS = re.compile(r"\\+[rn]")
PEM_HEADER = re.compile(r"([A-Za-z0-9-]{1,40}):[ \t]*(.*)")
CIPHER = re.compile(r"[A-Za-z0-9-]{3,40},[0-9A-Fa-f]{16,64}\Z")
#: Object ids, in DER, under which keys are encrypted by a password.
PASSWORD_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: What a token's header can begin with: a brace, or white space before it, in base64.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?:e[w-z0-9_-]|I[A-P]|C[Q-Za-v]|D[Q-Za-f])[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*")
#: The digits of the alphabet for URLs to those of the standard one.
STANDARD = {0x2D: 0x2B, 0x5F: 0x2F}
PADDING = re.compile(r"={0,2}")
#: The longest key that is looked for inside a run, in bytes: what two bytes of length can say.
MAX_INNER = 4 + 0xFFFF
#: A sequence of a length in one, two or three bytes and the head of a version or of another sequence, or the OpenSSH form's magic.
KEY_START = re.compile(r"M(?=[A-H][AEIMQUYcgkosw048][Cw]|I[GH].[AM]|I[I-L]...(?:IB|[A-D]))|b(?=3BlbnNzaC1rZXktdjEA)")
PIECE = re.compile(r"([A-Za-z0-9+/_-]+)|\\+[rn]|[ \t]*[\r\n][ \t]*")
COLON_HEX = re.compile(r"(?<![0-9A-Fa-f:])30(?::\s*[0-9A-Fa-f]{2}){15,}")

OPENSSH = b"openssh-key-v1\0"
INTEGER, BIT_STRING, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
#: What a private key's sequence is made of, and of how many parts at most.
PARTS, MAX_PARTS = (INTEGER, OCTETS, SEQUENCE, 0xA0, 0xA1, 0x81), 12


def elements(data: bytes) -> list[tuple[int, bytes]]:
    """The DER elements that fill data exactly. ValueError otherwise."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            raise ValueError("no element")
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 0 < width <= 4 or at + width > len(data):
                raise ValueError("no length")
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
            if n < 128 or n >> 8 * (width - 1) == 0:
                raise ValueError("a length longer than it need be")
        if at + n > len(data):
            raise ValueError("an element ends behind its parent")
        out.append((tag, data[at : at + n]))
        at += n
    return out


def private_key(data: bytes) -> bool:
    """Whether data is one private key: PKCS 1, PKCS 8 (plain or encrypted), SEC 1 or DSA in DER, or the OpenSSH form."""
    if data.startswith(OPENSSH):
        return _openssh(data) == len(data)
    try:
        outer = elements(data)
        if len(outer) != 1 or outer[0][0] != SEQUENCE:
            return False
        inner = elements(outer[0][1])
        tags = [t for t, _ in inner]
        if tags == [SEQUENCE, OCTETS]:
            algorithm = elements(inner[0][1])
            return len(algorithm) == 2 and algorithm[0][0] == OID and algorithm[0][1].startswith(PASSWORD_OIDS) and algorithm[1][0] == SEQUENCE and len(inner[1][1]) >= 16
        if len(inner) < 3 or tags[0] != INTEGER or len(inner[0][1]) != 1:
            return False
        version = inner[0][1][0]
        if version <= 1 and tags[1:3] == [SEQUENCE, OCTETS]:
            algorithm = elements(inner[1][1])
            return bool(algorithm) and algorithm[0][0] == OID and _held(inner[2][1])
        if version <= 1 and tags[1:9] == [INTEGER] * 8 or version == 0 and tags == [INTEGER] * 6:
            return all(len(v) > 0 for _, v in inner[1:])
        return version == 1 and tags[1] == OCTETS and 16 <= len(inner[1][1]) <= 72 and all(t in (0xA0, 0xA1) and elements(v) for t, v in inner[2:])
    except ValueError:
        return False


def _held(data: bytes) -> bool:
    """The octets of a PKCS 8 key: elements again, or elements with a short tail missing nowhere."""
    return len(elements(data)) == 1


def _openssh(data: bytes) -> int:
    """Where the OpenSSH form ends: cipher, derivation, its options, the number of keys, public keys, private part, each behind its length. 0 if it isn't one."""

    def field(at: int) -> tuple[bytes, int]:
        if at + 4 > len(data):
            raise ValueError("no length")
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if end > len(data):
            raise ValueError("a field ends behind the data")
        return data[at + 4 : end], end

    try:
        cipher, at = field(len(OPENSSH))
        derivation, at = field(at)
        _, at = field(at)
        count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        for _ in range(min(count, 1000) + 1):
            _, at = field(at)
        return at if 0 < count < 1000 and cipher.isascii() and len(cipher) > 0 and len(derivation) > 0 else 0
    except ValueError:
        return 0


def _bytes(digits: str, start: int, at: int, n: int) -> bytes:
    """The n bytes (fewer at the end) behind the first `at` of those that digits hold from start on."""
    first = start + at // 3 * 4
    some = digits[first : first + (at % 3 + n + 2) // 3 * 4]
    some = some[: len(some) - (len(some) % 4 == 1)]
    return binascii.a2b_base64(some + "=" * (-len(some) % 4))[at % 3 :][:n]


def _head(data: bytes) -> tuple[int, int, int]:
    """Tag, length of the head and of the contents of an element that begins with data; ValueError for lengths of more than two bytes."""
    if len(data) < 2 or data[1] in (0x80, *range(0x83, 0x100)) or len(data) < 2 + (data[1] & 0x7F if data[1] & 0x80 else 0):
        raise ValueError("no head")
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    return data[0], 2 + width, int.from_bytes(data[2 : 2 + width], "big") if width else data[1]


def _der_size(digits: str, start: int = 0) -> int:
    """The bytes of the key that may begin at start: a sequence that its parts, by their heads alone, fill exactly. 0 for anything else."""
    try:
        tag, at, n = _head(_bytes(digits, start, 0, 4))
        end, parts = at + n, 0
        while tag == SEQUENCE and at < end:
            part, width, n = _head(_bytes(digits, start, at, 4))
            at, parts = at + width + n, parts + 1
            if part not in PARTS or parts > MAX_PARTS:
                return 0
        return end if tag == SEQUENCE and at == end else 0
    except ValueError:
        return 0


def _openssh_size(digits: str, start: int) -> int:
    n = int.from_bytes(_bytes(digits, start, len(OPENSSH), 4), "big")  # of the cipher's name
    return _openssh(_bytes(digits, start, 0, MAX_INNER)) if 0 < n <= 64 else 0


def inner_keys(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Keys in the base64 that begins at start and goes on over line breaks, and where it ends. What belongs to one key isn't looked through again."""
    pieces, begun, total, end = [], [], 0, start
    while m := PIECE.match(text, end):
        end = m.end()
        if m[1]:
            pieces.append(m[1])
            begun.append((total, m.start()))
            total += len(m[1])
    digits, found, at = "".join(pieces).translate(STANDARD), [], 0
    for m in KEY_START.finditer(digits):
        if m.start() < at:
            continue
        size = (_der_size if m[0] == "M" else _openssh_size)(digits, m.start())
        stop = m.start() + (4 * size + 2) // 3
        if size and stop <= total and private_key(unbase64(digits[m.start() : stop]) or b""):
            at = stop
            first, last = (begun[bisect_right(begun, (i, len(text))) - 1] for i in (m.start(), stop - 1))
            close = last[1] + stop - last[0]
            found.append((first[1] + m.start() - first[0], close + len(PADDING.match(text, close)[0])))
    return found, end


def pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Where a private key's PEM block begins and ends: a BEGIN line whose next marker is its END line, with a key between."""
    begin = None
    for m in PEM_LINE.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None:
            if begin[2] == m[2] and pem_key(text[begin.end() : m.start()]):
                yield begin.start(), m.end()
            begin = None


def pem_key(body: str) -> bool:
    """Whether the lines between the markers hold a key: base64 that parses, or behind headers that name a cipher, what it may have made."""
    lines = [x.strip() for x in ESCAPED_ENDS.sub("\n", body).split("\n")]
    headers: dict[str, str] = {}
    for i, line in enumerate(lines):
        header = PEM_HEADER.match(line)
        if header:
            headers[header[1].lower()] = header[2].strip()
        elif line and not headers or not line and headers:
            lines = lines[i:]
            break
    data = unbase64("".join("".join(lines).split()))
    if not data:
        return False
    if "encrypted" in headers.get("proc-type", "").lower():
        return CIPHER.match(headers.get("dek-info", "")) is not None and len(data) >= 16 and len(data) % 8 == 0
    return private_key(data)


def unbase64(text: str) -> bytes | None:
    plain = text.rstrip("=").translate(STANDARD)
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def signed_token(text: str) -> bool:
    header, claims, signature = text.split(".")
    try:
        head, body = (json.loads(unbase64(x) or b"") for x in (header, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str) or not isinstance(body, dict):
        return False
    return unbase64(signature) is not None and (bool(signature) or head["alg"].lower() == "none")


def held(data: bytes | None) -> str | None:
    """key or token: what decoded data is, or holds as text."""
    if not data:
        return None
    if private_key(data):
        return "key"
    if data.isascii() or b"-----BEGIN " in data or b"eyJ" in data:
        kinds = {k for k, _, _ in structures(data.decode("latin-1"))}  # shorter at each level
        return "key" if kinds & {"key", "pem"} else "token" if kinds else None
    return None


def structures(text: str) -> list[tuple[str, int, int]]:
    """What parses in text."""
    found = []
    for m in HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := held(bytes.fromhex(m[0]))):
            found.append((kind, m.start(), m.end()))
    if "30:" in text:
        for m in COLON_HEX.finditer(text):
            data = bytes.fromhex("".join(m[0].replace(":", " ").split()))
            if private_key(data[: sum(_head(data)[1:])] if data[1] < 0x83 and data[1] != 0x80 else data):
                found.append(("key", m.start(), m.end()))
    blocks = list(pem_blocks(text)) if "-----BEGIN " in text else []
    found += [("pem", a, b) for a, b in blocks]
    at, block = 0, 0
    for m in BASE64_KEY.finditer(text):
        if kind := held(unbase64(m[0])):
            found.append((kind, m.start(), m.end()))
            continue
        while block < len(blocks) and blocks[block][1] <= m.start():
            block += 1
        if m.start() < at or block < len(blocks) and blocks[block][0] <= m.start():  # looked through with what stands before it
            continue
        inner, at = inner_keys(text, m.start())
        found += [("key", a, b) for a, b in inner]
    found += [("token", m.start(), m.end()) for m in TOKEN.finditer(text) if signed_token(m[0])]
    return found


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    found = []
    if HINT.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found += structures(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """text with each stretch of overlapping spans replaced by mark."""
    out, at, end = [], 0, -1
    for _, a, b in spans:
        if a >= end:
            if end >= 0:
                at = end
            out += [text[at:a], mark]
            end = b
        else:
            end = max(end, b)
    return "".join(out) + text[max(end, 0) :] if spans else text


def find_secrets(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, spans array<struct<kind, start, end>> (code points, end exclusive), redacted (text with marks).

    Null text: no spans, redacted null. Repeated rows: a row each. Null doc_id: kept. A long text is read whole, in one pass for each
    pattern. Empty table: no rows. Other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [scan(t) if t else [] for t in pdf["text"]]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found]
            redacted = [t if not s else redact(t, s, mark) for t, s in zip(pdf["text"], found, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "spans": spans, "redacted": redacted})

    rows = docs.select(F.col("doc_id").cast("string"), "text")
    out = rows.mapInPandas(sparing(run), "doc_id string, spans array<struct<kind:string,start:long,end:long>>, redacted string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def redact_secrets(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with the secrets in text replaced by mark; n_chars, if there, follows. All rows and columns stay."""

    @F.pandas_udf("string")
    @sparing
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series([redact(t, scan(t), mark) if t else t for t in text], dtype=object)

    out = docs.withColumn("text", run("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_secret_scan": op9_secret_scan}
