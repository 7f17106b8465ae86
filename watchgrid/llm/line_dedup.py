"""Repeated lines and passages: digests grouped globally, the earliest occurrence stays.

Lines are compared in lower case with white space as one space.  Passages are runs
of ``PASSAGE`` words anywhere in a text: of every such run one shorter run is
chosen by its hash alone, so equal runs choose alike, and only where a chosen run
repeats are whole passages compared.  What is removed is reported with the offsets
it had in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.llm.text import WordHashes, mix
from watchgrid.session import materialize

#: Words of a passage that may stand in a corpus once.
PASSAGE = 50
#: Words of the run that stands for a passage while candidates are looked for.
SAMPLE = 25
#: Repeated lines next to each other go if they have so many words together.
LEAST = 5
_OTHER = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_LINE = re.compile(r"[^\n]+")
# A word takes the marks after it along.
_WORD = re.compile(r"(\w+)[^\w\s]*")


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def units(text: str | None) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of every line that holds more than white space; code points."""
    out = []
    for m in _LINE.finditer(text or ""):
        line = normal(m.group())
        if line:
            out.append((m.start(), m.end(), hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()))
    return out


_UNITS = "array<struct<start:int,end:int,digest:binary>>"


def line_units(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"start": a, "end": b, "digest": d} for a, b, d in units(text)] for text in batch], dtype=object)


def without(text: str | None, spans) -> str | None:
    """The text less the given lines, each with the line feed after it."""
    if not text or spans is None or not len(spans):
        return text
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        out.append(text[at:start])
        at = end + (text[end:end + 1] == "\n")
    return ("".join(out) + text[at:])


def cut_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([without(t, s) for t, s in zip(texts, spans)], dtype=object)


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, mark (of the text), start, end of every line that an earlier place already holds.

    The earliest place is the smallest (doc_id, start), of several texts with one id the smallest
    mark.  Repeated rows share their fate.  Rows with a null doc_id rank after all others.
    """
    found = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("mark"), F.explode(F.pandas_udf(line_units, _UNITS)(F.col(text))).alias("__u"))
    found = found.select("doc_id", "mark", "__u.start", "__u.end", "__u.digest")
    found = materialize(found, "line-digests")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("start"), F.col("mark"))
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Written first, so that a line held by a large part of all rows can be split among tasks in the join.
    first = materialize(first, "first-lines")
    return found.join(first, "digest").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "mark", "start", "end")


def with_lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, __text, __mark and the repeated lines (__spans) of every row."""
    gone = (repeated_lines(docs, text, key).groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__m"))
            .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans")))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__mark"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m")), "left").drop("__id", "__m")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, text without repeated lines, n_removed, removed.

    ``removed`` lists start:end of each removed line in the original text.  Null
    texts stay null, empty ones empty; repeated rows lose the same.
    """
    out = with_lines(docs, text, key)
    removed = F.array_join(F.transform("__spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", F.pandas_udf(cut_spans, "string")("__text", "__spans").alias("text"),
                      F.coalesce(F.size("__spans"), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(removed, F.lit("")).alias("removed"))


def runs_of(text: str | None, spans) -> list[tuple[int, int]]:
    """Of the given lines those that reach ``LEAST`` words with the given lines next to them."""
    if not text or spans is None or not len(spans):
        return []
    gone = {(s["start"], s["end"]) for s in spans}
    out, run, size = [], [], 0
    for start, end, _ in [*units(text), (-1, -1, b"")]:
        if (start, end) in gone:
            run.append((start, end))
            size += len(text[start:end].split())
        else:
            out += run if size >= LEAST else []
            run, size = [], 0
    return out


def long_runs(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in runs_of(t, s)] for t, s in zip(texts, spans)], dtype=object)


def rest(text: str | None, spans) -> str:
    """What is left without the given lines, for its words only."""
    if not text or spans is None or not len(spans):
        return text or ""
    out, at = [], 0
    for s in spans:
        out.append(text[at:s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def tokens(text: str | None, spans, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word outside the given lines."""
    found = list(_WORD.finditer(text or ""))
    start = np.array([m.start() for m in found], dtype=np.int64)
    end = np.array([m.end() for m in found], dtype=np.int64)
    hashed = hashes.of([m.group(1).lower() for m in found])
    if spans is not None and len(spans):
        lo, hi = (np.array([s[k] for s in spans], dtype=np.int64) for k in ("start", "end"))
        at = np.searchsorted(lo, start, side="right") - 1
        left = (at < 0) | (start >= hi[np.maximum(at, 0)])
        start, end, hashed = start[left], end[left], hashed[left]
    return start, end, hashed


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolled(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, from differences of one running sum modulo 2^64."""
    n = len(hashed) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashed) + 1, dtype=np.uint64)
    np.cumsum(hashed * powers(_BASE, len(hashed)), out=total[1:])
    return mix((total[size:] - total[:n]) * powers(_BACK, n))


def chosen(every: np.ndarray) -> np.ndarray:
    """For every run of ``PASSAGE`` words the smallest hash of the runs of ``SAMPLE`` words in it; it stands for the passage."""
    width = PASSAGE - SAMPLE + 1
    if len(every) < width:
        return np.zeros(0, dtype=np.uint64)
    low, have = every, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    return np.minimum(low[:len(low) - (width - have)], low[width - have:])


def samples(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The chosen runs of each text, once, or twice if they stand for separate or overlapping passages with the same words."""
    hashes = WordHashes()
    for texts, spans in batches:
        rows = []
        for text, gone in zip(texts, spans):
            found = map(str.lower, _WORD.findall(rest(text, gone)))
            every = rolled(hashes.of(list(found)), SAMPLE)
            picked = np.unique(chosen(every))
            if len(picked):
                every.sort()
                picked = np.concatenate([picked, picked[np.isin(picked, every[1:][every[1:] == every[:-1]])]])
            rows.append(picked.astype(np.int64))
        yield pd.Series(rows, dtype=object)


_PASSAGES = "array<struct<start:int,end:int,one:long,two:long>>"


def passages(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Every passage whose chosen run is among the known ones, with its digest in two parts."""
    hashes = WordHashes()
    for texts, spans, known in batches:
        rows = []
        for text, gone, repeated in zip(texts, spans, known):
            start, end, hashed = tokens(text, gone, hashes)
            at = np.flatnonzero(np.isin(chosen(rolled(hashed, SAMPLE)), np.asarray(repeated, dtype=np.int64).astype(np.uint64)))
            found = []
            if len(at):
                one, two = (rolled(h, PASSAGE)[at].astype(np.int64).tolist() for h in (hashed, mix(hashed ^ _OTHER)))
                found = [{"start": a, "end": b, "one": x, "two": y}
                         for a, b, x, y in zip(start[at].tolist(), end[at + PASSAGE - 1].tolist(), one, two)]
            rows.append(found)
        yield pd.Series(rows, dtype=object)


def joined(*spans) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for some in spans if some is not None for s in some):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def less(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the spans: each takes the space after it along, a line feed only from the beginning of a line."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        after = text[end:end + 1]
        at = end + (after == " " or after == "\n" and (start == 0 or text[start - 1] == "\n"))
    return "".join(out) + text[at:]


_LEFT = "text string, n_removed long, removed string"


def cut_all(texts: pd.Series, lines: pd.Series, repeats: pd.Series) -> pd.DataFrame:
    rows = []
    for text, some, more in zip(texts, lines, repeats):
        spans = joined(some, more) if text else []
        rows.append((less(text, spans) if spans else text, len(spans), ",".join(f"{a}:{b}" for a, b in spans)))
    return pd.DataFrame(rows, columns=["text", "n_removed", "removed"])


def dedup_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, text without repeated lines and passages, n_removed, removed.

    A line that an earlier place holds goes if it has ``LEAST`` words, alone or with repeated
    lines next to it.  In what is left, every run of ``PASSAGE`` words that an earlier place
    holds goes, wherever it begins; the earliest place is the smallest (doc_id, start), of several texts with
    one id the smallest mark, null ids last.  ``removed`` lists start:end in the original text.  Null
    texts stay null; repeated rows lose the same; texts of any length are read whole.
    """
    rows = with_lines(docs, text, key)
    rows = rows.select("doc_id", "__text", "__mark",
                       F.pandas_udf(long_runs, "array<struct<start:int,end:int>>")("__text", "__spans").alias("__lines"))
    rows = materialize(rows, "repeated-lines")

    seen = rows.select("doc_id", "__mark", F.explode(F.pandas_udf(samples, "array<long>")("__text", "__lines")).alias("hash"))
    seen = materialize(seen, "samples")
    often = materialize(seen.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated-samples")
    known = seen.join(often, "hash").groupBy(F.col("doc_id").alias("__id"), F.col("__mark").alias("__m")).agg(F.collect_set("hash").alias("known"))
    own = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m"))
    found = rows.join(known, own).select(
        "doc_id", "__mark", F.explode(F.pandas_udf(passages, _PASSAGES)("__text", "__lines", "known")).alias("p"))
    found = materialize(found.select("doc_id", "__mark", "p.*"), "passages")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("start"), F.col("__mark"))
    first = found.groupBy("one", "two").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = materialize(first, "first-passages")
    again = found.join(first, ["one", "two"]).where(~place.eqNullSafe(F.col("first")))
    again = again.groupBy(F.col("doc_id").alias("__id"), F.col("__mark").alias("__m")).agg(F.collect_set(F.struct("start", "end")).alias("__again"))
    out = rows.join(again, own, "left")
    cut = F.pandas_udf(cut_all, _LEFT)("__text", "__lines", "__again")
    return out.select("doc_id", cut.alias("__cut")).select("doc_id", "__cut.*")
