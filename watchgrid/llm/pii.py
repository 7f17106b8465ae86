"""Personal data: patterns propose spans, checksums confirm them, context moves their score.

The contract's kinds (email, ip, card, phone) are reported whenever their own
rule holds.  Account numbers (iban, mod-97) and social security numbers (ssn) are
added when checksum and context give them a score of ``threshold`` or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid.llm.text import join_spans, sha256

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts within a run of digits: the run's first digit would have matched.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_GLUED = re.compile(r"[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NEAR = 48
# The length of an account number by its country.
_LENGTHS = dict(x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 "
    "EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 "
    "IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 "
    "NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 "
    "SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30").split())

# Words that speak for a kind when they stand near a span, and words that speak against any.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "login", "client"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "cvv", "expires"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer", "tin"),
}
AGAINST = ("version", "order", "invoice", "isbn", "serial", "model", "example", "sku")
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.5, "phone": 0.6, "iban": 0.5, "ssn": 0.4}


def luhn(digits: str) -> bool:
    """Check digit of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Check digits of account numbers: moved to the end, letters as 10 to 35."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from their @ so that long runs cost linear time."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, cut from what follows them.

    Capitals and digits after a number belong to it as far as anyone can see: it ends at a
    place where no letter or digit follows, after the length of its country if that is valid;
    else it is the longest beginning that is valid, for known countries only the whole run.
    """
    found = _IBAN.search(text)
    while found:
        at, run = found.start(), found.group()
        ends = [i for i in range(len(run), 14, -1) if run[i - 1] != " " and not _GLUED.match(text, at + i)]
        sized = [(len(run[:i].replace(" ", "")), i) for i in ends]
        length = int(_LENGTHS.get(run[:2], 0))
        tries = [i for n, i in sized if n == length] + [i for n, i in sized if n >= 15][:1 if length else None]
        end = next((i for i in tries if mod97(run[:i].replace(" ", ""))), 0)
        if end:
            yield at, at + end
        found = _IBAN.search(text, at + (end or 1))


def score(text: str, kind: str, start: int, end: int, valid: bool) -> float:
    """Prior of the kind, raised by a passed checksum and by words nearby, lowered by others."""
    near = re.findall(r"[a-z-]+", (text[max(0, start - _NEAR):start] + " " + text[end:end + _NEAR]).lower())
    value = PRIOR[kind] + 0.25 * valid
    value += 0.2 * any(w in CONTEXT[kind] for w in near)
    value -= 0.2 * any(w in AGAINST for w in near)
    return min(1.0, max(0.0, value))


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, int, float]]:
    """(start, order of kind, kind, end, score) of every span, base kinds at any score."""
    if not text:
        return []
    out = []

    def add(kind: str, start: int, end: int, valid: bool) -> None:
        value = score(text, kind, start, end, valid)
        if kind in BASE or value >= threshold:
            out.append((start, KINDS.index(kind), kind, end, round(value, 3)))

    for start, end in emails(text):
        add("email", start, end, True)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            add("ip", *m.span(), True)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                add("card", *m.span(), True)
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            add("phone", *m.span(), False)
    for start, end in accounts(text):
        add("iban", start, end, True)
    for m in _SSN.finditer(text):
        add("ssn", *m.span(), False)
    return sorted(out)


def mask(text: str | None, spans: list[tuple[int, int, str, int, float]]) -> str | None:
    """The text with each span, overlapping ones joined, replaced by its kind in brackets."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, _, kind, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][3])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


_REPORT = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_extra long")


def report(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            found = find(text)
            base = [x[:4] for x in found if x[2] in BASE]
            count = [sum(x[2] == kind for x in base) for kind in BASE]
            rows.append((*count, sha256(join_spans(base)), join_spans([x[:4] for x in found]),
                         ",".join(f"{x[4]:.2f}" for x in found), len(found) - len(base)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REPORT.split(", ")])


def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([mask(text, find(text)) for text in batch], dtype=object)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: counts, digest and spans of its personal data.

    A null text counts as empty; null and repeated keys pass through; other
    columns are ignored.  Only the text travels to Python.
    """
    found = docs.select(F.col(key).alias("doc_id"), F.pandas_udf(report, _REPORT)(F.col(text)).alias("__found"))
    return found.select("doc_id", "__found.*")


def masked_text(text: Column | str) -> Column:
    """The text with its personal data replaced; null stays null."""
    return F.pandas_udf(masked, "string")(F.col(text) if isinstance(text, str) else text)
