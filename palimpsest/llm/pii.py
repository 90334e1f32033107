"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes, plus signs, digits and
identifier cues in one pass.  From each anchor a deterministic local parser
expands to the boundaries of an address or account and validates it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

BASE_KINDS = ("email", "ip", "card", "phone")
#: Added by the method: bank accounts (check digits valid), secrets after a cue, and log-ins inside URLs.
EXTRA_KINDS = ("account", "login", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS

# Words that announce an identifier.
ACCOUNT_CUES = ("iban", "account")
SECRET_CUES = ("api_key", "apikey", "passwd", "password", "pwd", "secret", "token")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[\s:=#]{0,3}(?:number|no\.?|nr\.?)?[\s:=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_SECRET = re.compile(r"[\"']?\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_+/=-]{16,})")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def iban_valid(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue, kind in [("@", "@"), ("+", "+"), ("://", "/"), *((str(d), "d") for d in range(10)), *((c, "a") for c in ACCOUNT_CUES), *((c, "s") for c in SECRET_CUES)]:
        a.add_word(cue, kind)
    a.make_automaton()
    return a


_ASCII_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find_spans(text: str | None, auto: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each in order, code point offsets, end exclusive.  Empty for null and empty texts."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    email_end = ip_end = card_end = phone_end = login_end = 0
    run_end = -1  # where the last digit anchor ended
    secret_end = account_end = 0
    for at, kind in auto.iter(text.translate(_ASCII_FOLD)):
        if kind == "d":
            if at != run_end:  # the first digit of a run; a match that fails here fails at its other digits
                if at >= ip_end and (m := _IP.match(text, at)):
                    ip_end = m.end()
                    if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                if at >= card_end and (m := _CARD.match(text, at)):
                    card_end = m.end()
                    if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                        out["card"].append(m.span())
            run_end = at + 1
        elif kind == "@":
            lo = at
            while lo > email_end and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out["email"].append((lo, email_end))
        elif kind == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 8 <= len(_digits(m[0])) <= 15:
                    out["phone"].append(m.span())
        elif kind == "/":
            if at + 1 >= login_end and (m := _LOGIN.match(text, at + 1)):
                login_end = m.end()
                out["login"].append(m.span())
        elif kind == "a":
            if (m := _IBAN.match(text, at + 1)) and m.start(1) >= account_end:
                for end in range(m.end(1), m.start(1) + 14, -1):  # the longest valid prefix; the pattern bounds the work
                    if text[end - 1] != " " and iban_valid(text[m.start(1) : end]):
                        out["account"].append((m.start(1), end))
                        account_end = end
                        break
        elif at + 2 >= secret_end and (m := _SECRET.match(text, at + 1)) and m.start(1) >= secret_end:  # a cue inside a secret isn't followed
            secret_end = m.end(1)
            out["secret"].append(m.span(1))
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(text: str | None, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    """Replaces each span, overlapping ones together, by the kind of the first in capitals."""
    marks = sorted((a, -b, k) for k, v in spans.items() for a, b in v)
    if not marks:
        return text
    out, at = [], 0
    i = 0
    while i < len(marks):
        a, b, k = marks[i][0], -marks[i][1], marks[i][2]
        i += 1
        while i < len(marks) and marks[i][0] < b:
            b, i = max(b, -marks[i][1]), i + 1
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def detect_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, digest of the base spans, all spans.

    A null text counts as empty, repeated rows are treated alike, an empty
    table stays empty, and other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in pieces(batches):
            found = [find_spans(t, auto) for t in b.column(1).to_pylist()]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE_KINDS]
            digests = pa.array([hashlib.sha256(joined(f, BASE_KINDS).encode()).hexdigest() for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, pa.array([joined(f, KINDS) for f in found], pa.string())], names=[id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets.

    The other columns, their order and null and empty texts stay; repeated rows
    are masked alike; an empty table stays empty.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in pieces(batches):
            texts = pa.array([redact(t, find_spans(t, auto)) for t in b.column(place).to_pylist()], b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([texts if i == place else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def redact_documents(docs: DataFrame, *, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """redact_pii, with the size column, where there is one, set to the new length; a null text's size becomes null."""
    out = redact_pii(docs, text_col)
    return out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType)) if size_col in docs.columns else out
