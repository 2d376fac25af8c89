"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, address schemes and identifier
cues. Deterministic local parsers expand each anchor to its boundaries and validate it: e-mail
addresses around an at-sign, hosts and user names after a scheme, account numbers (IBAN by its
check digits, national and account numbers by their shape) after a cue. Phone numbers expand
from plus signs; dotted addresses and card numbers, whose only anchors are digits, are read by
possessive patterns behind a linear-time gate.

Defined cases: null and empty texts have no spans; very long texts are read whole, in linear time;
spans are code points with exclusive ends; spans of equal start (a tie) come in the order of KINDS;
repeated rows and null ids give one row each; an empty table gives an empty result; other columns,
also of the names put out, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone", "account", "login")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])")
USER = re.compile(r"[^\s:@/]+:[^\s:@/]+@")
GATES = {"ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}

# Address schemes, and words that announce an identifier.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://")
CUES = ("iban", "account", "acct", "ssn", "passport", "tax id", "routing", "konto", "cuenta", "compte")
#: Characters after a cue within which its number must begin.
REACH = 16


@cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for word in SCHEMES:
        found.add_word(word, ("scheme", len(word)))
    for word in CUES:
        for form in {word, word.upper(), word.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign; ``floor`` is where the last one ended."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def _account(text: str, end: int) -> tuple[int, int] | None:
    """The number that a cue announces."""
    for i in range(end, min(len(text), end + REACH)):
        c = text[i]
        if "A" <= c <= "Z" and (m := IBAN.match(text, i)):
            s = m[0]
            while len(s.replace(" ", "")) >= 15:
                if iban_valid(s):
                    return i, i + len(s)
                s = s[:-1].rstrip(" ")
        if c.isascii() and c.isdigit():
            m = NUMBER.match(text, i)
            return m.span() if m else None
    return None


def base_spans(text: str, gates: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of IP addresses, cards and phone numbers."""
    out = []
    if gates[0]:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
    if gates[1]:
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if gates[2]:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def spans_of(text: str, gates: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """All spans by start, then kind."""
    base, floor, added = base_spans(text, gates), 0, []
    for end, (kind, size) in anchors().iter(text):
        if kind == "at":
            if end >= floor and (got := _email(text, end, floor)):
                base.append((got[0], 0, got[1]))
                floor = got[1]
        elif kind == "scheme":
            if m := USER.match(text, end + 1):
                added.append((m.start(), 5, m.end() - 1))
        elif (got := _account(text, end + 1)) and not text[end - size : end - size + 1].isalnum():
            added.append((got[0], 4, got[1]))
    return sorted(set(base + added))


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    texts = [t or "" for t in texts]
    column = pa.array(texts, pa.large_string())
    gate = [pc.match_substring_regex(column, g).to_pylist() for g in GATES.values()]
    return [spans_of(t, g) for t, *g in zip(texts, *gate, strict=True)]


def _rows(blocks):
    for block in blocks:
        found = scan(block["text"])
        count = lambda k: [sum(x[1] == k for x in s) for s in found]
        yield {"doc_id": block["id"], "n_email": count(0), "n_ip": count(1), "n_card": count(2), "n_phone": count(3), "base_sha256": [hashlib.sha256(_join([x for x in s if x[1] < 4]).encode()).hexdigest() for s in found], "spans": [_join(s) for s in found], "n_account": count(4), "n_login": count(5)}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_account, n_login) for every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(docs, ["id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_account long, n_login long", _rows)
