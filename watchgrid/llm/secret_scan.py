"""Secrets: fixed patterns, and values in credential context that are costly to guess.

The guess cost of a value is the cheapest way to write it as a row of dictionary
words, dates, repeats, keyboard walks and brute-force stretches, found by dynamic
programming over its characters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.llm.text import join_spans, sha256

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "guess")
#: log10 of the guesses from which a value counts as a secret.
THRESHOLD = 10.0
#: An unquoted word of letters only is no secret below this length.
PROSE = 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # [0-9a-f]+ of 16 characters or more
_CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?)["']?"""
    r"""(?:\x20*[:=]\x20*|\x20+is:?\x20+)(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"'<>]{6,}))""", re.I | re.A)
_HINTS = ("pass", "pwd", "secret", "token", "api", "key", "credential")

# Common words of passwords, most frequent first, and the rows of a keyboard.
WORDS = (
    "password love admin welcome monkey dragon login master hello sunshine princess football shadow summer winter spring "
    "autumn baseball secret letmein trust hunter ranger charlie michael jordan thomas jessica daniel ashley super batman "
    "computer internet server office company system network default test guest user root access account change public "
    "private token key the of and for with that this you have from are not all your one new day home house time year "
    "green blue black white red silver golden orange happy lucky angel star moon flower money tiger eagle horse summer "
    "coffee cookie cheese pepper ginger banana cherry apple google london paris berlin madrid").split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")

_RANK = {}
for _i, _w in enumerate(WORDS, 1):
    _RANK.setdefault(_w, _i)
_LONGEST = max(map(len, WORDS))
_NEXT = {a + b for row in KEY_ROWS for a, b in zip(row, row[1:])} | {b + a for row in KEY_ROWS for a, b in zip(row, row[1:])}
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12][0-9]|3[01])"
                   r"|(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)[0-9]{2})")
_YEAR = re.compile(r"(?:19|20)[0-9]{2}")


def alphabet(value: str) -> float:
    """log10 of the number of characters a brute-force search has to try at each place."""
    size = 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value)
    return math.log10(max(2, size + 33 * any(not c.isalnum() for c in value)))


def stretches(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the parts that follow a pattern."""
    low = value.lower()
    n = len(low)
    for i in range(n):
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(low[i:j])
            if rank:
                capitals = sum(c.isupper() for c in value[i:j])
                case = 0.0 if capitals == 0 else 0.3 if capitals in (1, j - i) else math.log10(2) * (j - i)
                yield i, j, math.log10(rank + 1) + case
        found = _DATE.match(value, i)
        if found:
            yield i, found.end(), math.log10(366 * 130)
        found = _YEAR.match(value, i)
        if found:
            yield i, found.end(), math.log10(200)
    for i in range(n - 2):  # walks along neighbouring keys, and every part of them
        for j in range(i + 2, n + 1):
            if low[j - 2:j] not in _NEXT:
                break
            if j - i >= 3:
                yield i, j, math.log10(94 * (j - i) * 2)
    for size in range(1, min(8, n // 2) + 1):  # repeats of a unit, and every whole number of times
        same = 0
        for i in range(n - size - 1, -1, -1):
            same = same + 1 if value[i] == value[i + size] else 0
            for times in range(2, same // size + 2):
                if size * times >= 3:
                    unit = value[i:i + size]
                    yield i, i + size * times, size * alphabet(unit) + math.log10(times)


def prose(value: str, quoted: bool) -> bool:
    """Is it a word of a sentence rather than a secret: letters only in one case, or with a capital first?"""
    bare = value.rstrip(".,;:!?)")
    return not quoted and len(bare) < PROSE and bare.isalpha() and (bare.islower() or bare.isupper() or bare[1:].islower())


def guess_cost(value: str) -> float:
    """log10 of the guesses needed for a value: the cheapest segmentation."""
    step = alphabet(value)
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in stretches(value):
        ends.setdefault(end, []).append((start, cost))
    best = [0.0]
    for end in range(1, len(value) + 1):
        low = best[end - 1] + step
        for start, cost in ends.get(end, ()):
            low = min(low, best[start] + cost)
        best.append(low)
    return best[-1]


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, int]]:
    """(start, order of kind, kind, end) of every span."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        for m in _ASSIGN.finditer(text):
            if len(m.group(2)) >= 12:
                out.append((m.start(), 0, "assign", m.end()))
        for m in _CONTEXT.finditer(text):
            at = next(i for i in (1, 2, 3) if m.group(i) is not None)
            start, end = m.span(at)
            if not prose(text[start:end], at < 3) and guess_cost(text[start:end]) >= threshold:
                out.append((start, 3, "guess", end))
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 18:
            out.append((m.start(), 1, "access", m.end()))
    for m in _HEX.finditer(text):
        out.append((m.start(), 2, "hex", m.end()))
    return sorted(out)


_REPORT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def report(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            found = find(text)
            base = [x for x in found if x[2] in BASE]
            rows.append((*(sum(x[2] == kind for x in base) for kind in BASE), sha256(join_spans(base)), join_spans(found),
                         len(found) - len(base)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REPORT.split(", ")])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: counts, digest and spans of its secrets.

    A null text counts as empty; null and repeated keys pass through; other
    columns are ignored.  The guess cost is linear in the value's length, save for long walks and
    repeats.  Unquoted single words of letters below ``PROSE`` characters are prose, not passwords.  An
    empty table gives an empty result.
    """
    found = docs.select(F.col(key).alias("doc_id"), F.pandas_udf(report, _REPORT)(F.col(text)).alias("__found"))
    return found.select("doc_id", "__found.*")
