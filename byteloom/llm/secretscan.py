"""Secret scan with structural confirmation: a candidate is reported only if what it encodes has the structure of a secret.

Base64 and hex are decoded; private keys must parse as nested lengths that fit exactly, signed tokens must have a header that names an algorithm and a signature of
that algorithm's length, and what is assigned to a name such as ``password`` must decode to bytes that look drawn at random."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom._ship import by_value

by_value(__name__)

NAMES = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credential)s?"
FRAME = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]++)")
KEY_ID = re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)([A-Z2-7]{16}))(?![A-Za-z0-9])")
BASIC = re.compile(r"(?i:\bbasic)\s++([A-Za-z0-9+/]{8,}+={0,2}+)(?![A-Za-z0-9+/=])", re.A)
ASSIGNED = re.compile(rf"(?i:(?<![A-Za-z0-9]){NAMES})[\"']?\s*+(?:=>|:=|=|:)\s*+[\"']?([A-Za-z0-9+/_-]{{16,}}+={{0,2}}+)(?![A-Za-z0-9+/_=-])", re.A)
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{40,}+={0,2}+)(?![A-Za-z0-9+/_=-])")
#: What any of the patterns needs; texts without it are dropped from the Arrow batch by one pass of an automaton, before they become Python strings.
ANY = rf"-----BEGIN |[A-Za-z0-9+/_-]{{40}}|eyJ[A-Za-z0-9_-]{{8}}|(?:AKIA|ASIA)[A-Z2-7]{{16}}|(?i:basic)[\s\x0b]+[A-Za-z0-9+/]{{8}}|(?i:{NAMES})[\"']?[\s\x0b]*[:=]"

SIGNATURE_BYTES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EDDSA": (64, 114)} | {a + n: (128, 1024) for a in ("RS", "PS") for n in ("256", "384", "512")}


def unbase64(s: str) -> bytes | None:
    """Of either alphabet, with or without padding; None unless the text is what the bytes encode to."""
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1 or (s.endswith("=") and len(s) % 4):
        return None
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return raw if base64.b64encode(raw).decode().rstrip("=") == body else None


def unhex(s: str) -> bytes | None:
    if len(s) % 2 or not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return None
    return bytes.fromhex(s)


def der(raw: bytes) -> list | None:
    """Nested (tag, value) of a run of encoded elements, value a list for constructed ones; None unless all lengths nest exactly, however deep."""
    top: list = []
    at, open_ = 0, [(len(raw), top)]
    while open_:
        end, out = open_[-1]
        if at == end:
            open_.pop()
            continue
        if end - at < 2:
            return None
        tag, n, at = raw[at], raw[at + 1], at + 2
        if tag & 0x1F == 0x1F:
            return None
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or end - at < k or raw[at] == 0:
                return None
            n, at = int.from_bytes(raw[at : at + k], "big"), at + k
            if n < 0x80:
                return None
        if n > end - at:
            return None
        if tag & 0x20:
            inner: list = []
            out.append((tag, inner))
            open_.append((at + n, inner))
        else:
            out.append((tag, raw[at : at + n]))
            at += n
    return top


def private_key(raw: bytes) -> str | None:
    """The kind of the private key that the bytes are, else None; public keys and certificates are no secrets."""
    if raw.startswith(b"openssh-key-v1\0"):
        at, parts = 15, []
        for k in range(6):
            if len(raw) - at < 4:
                return None
            n, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
            if k == 3:  # the number of keys
                if n != 1:
                    return None
                continue
            if n > len(raw) - at:
                return None
            parts.append(raw[at : at + n])
            at += n
        return "openssh_private_key" if at == len(raw) and parts[4] else None
    if len(raw) < 24 or raw[0] != 0x30:
        return None
    top = der(raw)
    if top is None or len(top) != 1 or not isinstance(top[0][1], list):
        return None
    tags = [t for t, _ in top[0][1]]
    values = [v for _, v in top[0][1]]
    if len(tags) == 9 and set(tags) == {0x02} and values[0] == b"\0":
        return "rsa_private_key"
    if len(tags) == 6 and set(tags) == {0x02} and values[0] == b"\0":
        return "dsa_private_key"
    oid = lambda v: isinstance(v, list) and v and v[0][0] == 0x06
    if tags[:3] == [0x02, 0x30, 0x04] and values[0] in (b"\0", b"\1") and oid(values[1]):
        return "pkcs8_private_key"
    if tags[:2] == [0x02, 0x04] and values[0] == b"\1" and len(values[1]) in (28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec_private_key"
    if tags == [0x30, 0x04] and oid(values[0]) and len(values[1]) >= 16:
        return "encrypted_private_key"
    return None


def signed_token(header: str, payload: str, signature: str) -> str | None:
    raw = [unbase64(x) for x in (header, payload, signature)]
    if None in raw:
        return None
    try:
        head, body = json.loads(raw[0]), json.loads(raw[1])
    except (ValueError, RecursionError):
        return None
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return None
    lo, hi = SIGNATURE_BYTES.get(head["alg"].upper(), (1, 0))
    return "signed_token" if lo <= len(raw[2]) <= hi else None


def random_bytes(raw: bytes) -> bool:
    """At least 8 bytes that look drawn at random: few repeats, no runs, and not text."""
    if len(raw) < 8 or len(set(raw)) < min(len(raw), 64) * 0.6:
        return False
    steps = {(b - a) % 256 for a, b in zip(raw, raw[1:])}
    return len(steps) > 2 and not all(32 <= x < 127 for x in raw)


def _decoded(s: str) -> tuple[str, bytes] | None:
    raw = unhex(s)
    if raw is not None:
        return "hex", raw
    raw = unbase64(s)
    return None if raw is None else ("base64", raw)


def frames(text: str):
    """(start, end, label, body) of each framed block: an END with the last BEGIN of its label before it. Each mark is looked at once."""
    begins: dict[str, re.Match] = {}
    for m in FRAME.finditer(text):
        if m.group(1) == "BEGIN":
            begins[m.group(2)] = m
        elif (b := begins.pop(m.group(2), None)) is not None:
            yield b.start(), m.end(), m.group(2), text[b.end() : m.start()]


def framed_key(body: str) -> tuple[str | None, int]:
    """The kind and size of the private key that a frame's body encodes; its line ends may be escaped, as in string literals."""
    body = body.replace("\\r", "").replace("\\n", "\n").replace("\r", "")
    raw = unbase64("".join(x for x in body.split("\n\n")[-1].split() if ":" not in x))
    if raw is None:
        return None, 0
    sealed = "Proc-Type:" in body and len(raw) >= 16 and len(raw) % 8 == 0
    return "encrypted_private_key" if sealed else private_key(raw), len(raw)


def mixed(s: str) -> bool:
    """Small and capital letters and something else alternate as often as in what is drawn at random; in names made of words they don't."""
    kind = [1 if c.islower() else 2 if c.isupper() else 3 for c in s]
    return len(set(kind)) == 3 and sum(a != b for a, b in zip(kind, kind[1:])) >= 0.42 * (len(s) - 1)


def scan(text: str | None) -> list[tuple[str, str, int, int, int, str]]:
    """(kind, form, start, end, bytes, digest) of each secret, in order; places count characters, ``digest`` is the start of the SHA-256 of the secret's text.

    What is encoded is scanned as well, as deep as it nests. Of findings that overlap the first of this order stays: key blocks, signed tokens, key ids, basic credentials,
    assigned values, keys without a frame. Time grows with the text's length, whatever is in it."""
    found: list[tuple[str, str, int, int, int, str]] = []
    starts: list[int] = []  # of what was found, sorted; findings don't overlap
    if not text:
        return found

    def add(kind: str | None, form: str, a: int, b: int, n: int) -> None:
        if not kind:
            return
        k = bisect.bisect_left(starts, b)
        if k and found[k - 1][3] > a:
            return
        starts.insert(k, a)
        found.insert(k, (kind, form, a, b, n, hashlib.sha256(text[a:b].encode("utf-8", "replace")).hexdigest()[:16]))

    for a, b, label, body in frames(text):
        if "PRIVATE KEY" in label:
            kind, n = framed_key(body)
            add(kind, "pem", a, b, n)
    for m in TOKEN.finditer(text):
        add(signed_token(*m.groups()), "token", *m.span(), len(m.group(0)))
    for m in KEY_ID.finditer(text):
        add("access_key_id" if len(set(base64.b32decode(m.group(2)))) > 3 else None, "base32", *m.span(1), 10)
    for m in BASIC.finditer(text):
        raw = unbase64(m.group(1))
        if raw and 0 < raw.find(b":") < len(raw) - 1 and all(32 <= x < 127 for x in raw):
            add("basic_credentials", "base64", *m.span(1), len(raw))
    for pattern, assigned in ((ASSIGNED, True), (BLOB, False)):
        for m in pattern.finditer(text):
            value = m.group(1)
            if (d := _decoded(value)) is None:
                # random letters and digits needn't be the whole code of any bytes; what their first part decodes to is judged
                raw = unbase64(value[: len(value) // 4 * 4]) if assigned and "=" not in value and mixed(value) else None
                add("assigned_secret" if raw and random_bytes(raw) else None, "base64", *m.span(1), len(raw or b""))
                continue
            form, raw = d
            kind = private_key(raw)
            if not kind and raw.isascii() and (inner := scan(raw.decode())):
                kind = inner[0][0]
            # a word is valid base64 too, but base64 of random bytes has letters of both cases and something else
            drawn = random_bytes(raw) and (form == "hex" or all(re.search(c, value) for c in ("[a-z]", "[A-Z]", "[0-9+/_-]")))
            add(kind or ("assigned_secret" if assigned and drawn else None), form, *m.span(1), len(raw))
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, form, start, end, n_bytes, digest) of each secret in each row; places are in characters from 0.

    Null and empty texts have none. Repeated rows each have their findings; a null id stays null. Long texts are scanned whole, in time that grows with their length only.
    Of findings that overlap one stays, by the order of ``scan``. Other columns are ignored; an empty table has no rows."""

    def run(batches):
        for whole in batches:
            b = whole.filter(pa.compute.match_substring_regex(whole.column(1), ANY))
            hits = [(i, *f) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in scan(text)]
            cols = list(zip(*hits)) or [()] * 7
            types = (b.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "kind", "form", "start", "end", "n_bytes", "digest"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("t <> ''")
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, kind string, form string, start bigint, end bigint, n_bytes bigint, digest string")
