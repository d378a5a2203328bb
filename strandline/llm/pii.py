"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Kinds. The base kinds (email, ip, card, phone) are always reported if their pattern matches and their check holds; their
score only tells how sure the finder is. The further kinds are reported from a score of MIN_SCORE on: iban (mod-97 must
hold), ssn (needs a context word), key (credentials with a fixed prefix or behind a name like `password=`).

Per kind, matches are leftmost and don't overlap; a match that fails its check is dropped and the search goes on behind
it, behind its first four characters for an iban, which has the length of its country or, of a country that isn't listed, ends
where mod-97 holds at the border of a group. Secrets have no upper length. Offsets are code points, ends are exclusive.
Every pattern runs in linear time, also on very long runs of digits or letters, and texts of any length are searched whole.

Nulls and empty texts have no spans; repeated rows give repeated results; an empty table gives no rows; of the input only the
id and the text are read, so that further columns can't clash with the results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import text_column

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "key")
MIN_SCORE = 0.6
#: Code points before and behind a span in which context words count, and what one adds.
NEAR = 60
BOOST = 0.35

# A score without context, and the words that speak for each kind.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "key": 0.7}
# English, German, French and Spanish
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "kontakt", "schreiben", "courriel", "contacter", "correo", "escribir"),
    "ip": ("ip", "address", "host", "server", "adresse", "rechner", "serveur", "direcci\u00f3n", "servidor"),
    "card": ("card", "visa", "credit", "payment", "karte", "kreditkarte", "zahlung", "carte", "paiement", "tarjeta", "pago"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "anruf", "handy", "t\u00e9l\u00e9phone", "appeler", "tel\u00e9fono", "llamar"),
    "iban": ("iban", "bank", "account", "konto", "compte", "banque", "cuenta", "banco"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "key": ("key", "secret", "token", "password", "schl\u00fcssel", "passwort", "cl\u00e9", "clave", "contrase\u00f1a"),
}
# Characters of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "XK": 20,
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a match can only begin where a run of digits begins, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"\b(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)\b|\b(?:password|passwd|secret|api_key|token)=[^\s&;,]{6,}+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The first four characters go to the end, letters count from 10; the number leaves 1."""
    rest = 0
    for ch in iban[4:] + iban[:4]:
        value = int(ch, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= ch <= "9" for ch in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The pattern runs on over following words, so that the end is where the country's length says, or, for a country without one,
    the last border of a group at which mod-97 holds."""
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = start + 4  # without a valid end, one may begin inside
        size = IBAN_LENGTH.get(m[0][:2])
        while len(code := text[start:end].replace(" ", "")) >= (size or 15):
            if len(code) == (size or len(code)) and text[end - 1] != " " and text[end : end + 1] not in _ALNUM and mod97(code):
                yield start, end
                at = end
                break
            end -= 1


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    return min(1.0, PRIOR[kind] + BOOST * bool(set(CONTEXT[kind]) & set(_WORD.findall(near.lower()))))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in _ips(text)]
        found += [("card", *s) for s in _cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in _phones(text)]
        found += [("iban", *s) for s in _ibans(text)]
        if "-" in text:
            found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    if "=" in text or "AKIA" in text or "gh" in text or "sk-" in text:
        found += [("key", *m.span()) for m in _KEY.finditer(text)]
    scored = [(*f, _score(text, *f)) for f in found]
    return sorted((f for f in scored if f[0] in BASE or f[3] >= MIN_SCORE), key=lambda f: (f[1], KINDS.index(f[0])))


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not spans:
        return text
    out, at, name = [], 0, ""
    merged: list[list] = []
    for kind, start, end, _ in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for name, start, end in merged:
        out += [text[at:start], f"[{name.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def pii_column(text: Column) -> Column:
    """Struct column: n_<kind> of each base kind, base_sha256, spans (joined) and found (array of kind, start, end, score)."""

    def work(texts):
        found = [find(t) for t in texts]
        base = [[x for x in f if x[0] in BASE] for f in found]
        return [
            *([sum(x[0] == k for x in b) for b in base] for k in BASE),
            [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base],
            [_joined(f) for f in found],
            [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in f] for f in found],
        ]

    ddl = ",".join(f"n_{k}:bigint" for k in BASE) + ",base_sha256:string,spans:string"
    return text_column(text, ddl + ",found:array<struct<kind:string,start:bigint,end:bigint,score:double>>", lambda: work)


def redacted_column(text: Column) -> Column:
    """Struct column: text with the spans replaced, n_spans. Null stays null."""

    def work(texts):
        found = [find(t) for t in texts]
        return [[redact(t, f) for t, f in zip(texts, found, strict=True)], [len(f) for f in found]]

    return text_column(text, "text:string,n_spans:bigint", lambda: work)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and the columns of pii_column; other columns are left out."""
    return docs.select(F.col(id_col), pii_column(F.col(text_col)).alias("pii")).select(id_col, "pii.*")
