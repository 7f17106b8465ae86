"""Substring deduplication by sorted suffixes.

Every byte goes that a string of ``WINDOW`` bytes covers if this string also starts elsewhere.

Of each window one shorter gram is chosen by its hash alone, so equal windows choose alike.  Consecutive
windows with the same chosen place form a run; the text under a run is its span.  Runs whose gram occurs
once hold nothing repeated.  Where all spans around a gram are equal, all their windows are repeated.  Only
distinct spans around one gram are left.  They are sorted twice in a mergesort: by the text from the
gram on and by the reversed text before it.  Two suffixes are compared by the longest common extension,
found by binary search over prefix hashes, and every neighbouring pair of the result is verified byte by
byte.  A window ``d`` bytes before the gram is repeated if another span shares ``d`` bytes before the
gram and the rest after it, which both orders tell.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.llm.text import mix
from watchgrid.session import materialize

#: Bytes of a string that may start at one place only.
WINDOW = 200
#: Bytes of the gram that stands for a window.
GRAM = 64
#: Windows of a text that are looked at together.
PIECE = 1 << 20
#: Different spans around one gram that a task sorts; beyond that their windows are counted one by one.
SORT = 20_000

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_HIGH = np.uint64(0xFFFFFFFF00000000)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64; remembered."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=np.uint64)
    return _powers[base][:n]


class Prefixes:
    """Polynomial hashes of all prefixes of some bytes; any part's hash is a difference of two."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.back = powers(_BACK, len(data) + 1)

    def part(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]

    def every(self, size: int) -> np.ndarray:
        """Of all parts of this size, each bit spread."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n])


_RUNS = "id long, mark long, gram long, digest long, lo long, off int, size int"


def packed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else zlib.compress(t, 1))


def extensions(hashes: Prefixes, start: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Longest common extension of suffixes ``one`` and ``two``, by binary search over prefix hashes."""
    a, b = start[one], start[two]
    low, high = np.zeros(len(one), dtype=np.int64), np.minimum(size[one], size[two])
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.part(a, middle) == hashes.part(b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def mergesort(first: np.ndarray, count: np.ndarray, compare: Callable) -> np.ndarray:
    """The members of every group in order; all merges of one width go side by side.

    ``first`` and ``count`` tell of each member where its group begins and its size.  ``compare(x, y)``
    is below, at or above 0.
    """
    order, slots, width = np.arange(len(first)), np.arange(len(first)), 1
    while len(active := slots[count > width]):
        begin, end = first[active], first[active] + count[active]
        block = begin + (active - begin) // (2 * width) * (2 * width)
        middle = np.minimum(block + width, end)
        left = active < middle
        low, high = np.where(left, middle, block), np.where(left, np.minimum(block + 2 * width, end), middle)
        mine = order[active]
        while len(open_ := np.flatnonzero(low < high)):
            half = (low[open_] + high[open_]) // 2
            sign = compare(order[half], mine[open_])
            before = (sign < 0) | (sign == 0) & ~left[open_]
            low[open_] = np.where(before, half + 1, low[open_])
            high[open_] = np.where(before, high[open_], half)
        order[active + low - middle] = mine
        width *= 2
    return order


def true_extensions(data: np.ndarray, start: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The same as ``extensions``, byte by byte."""
    out, most = np.minimum(size[one], size[two]), int(size.max(initial=0))
    steps = np.arange(most)
    for at in range(0, len(one), 4096):
        a, b = one[at:at + 4096], two[at:at + 4096]
        part = out[at:at + 4096]
        inside = steps < part[:, None]
        differ = inside & (data[np.where(inside, start[a][:, None] + steps, 0)] != data[np.where(inside, start[b][:, None] + steps, 0)])
        any_ = differ.any(axis=1)
        part[any_] = differ[any_].argmax(axis=1)
    return out


def sorted_suffixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within their groups, and each one's common bytes with its predecessor (-1 for a group's first)."""
    hashes = Prefixes(data)
    padded = np.append(data, 0).astype(np.int64)

    def compare(x, y):
        common = extensions(hashes, start, size, x, y)
        ended = (common == size[x]) | (common == size[y])
        return np.where(ended, size[x] - size[y], padded[start[x] + common] - padded[start[y] + common])

    order = mergesort(first, count, compare)
    inner = np.flatnonzero(np.arange(len(first)) != first)
    x, y = order[inner - 1], order[inner]
    common = true_extensions(data, start, size, x, y)
    ended = (common == size[x]) | (common == size[y])
    rising = np.where(ended, size[x] <= size[y], padded[start[x] + common] < padded[start[y] + common])
    if not (rising.all() and (common == extensions(hashes, start, size, x, y)).all()):  # a collision of hashes
        raw = data.tobytes()
        order = np.array(sorted(range(len(first)), key=lambda i: (first[i], raw[start[i]:start[i] + size[i]])), dtype=np.int64)
        common = true_extensions(data, start, size, order[inner - 1], order[inner])
    shared = np.full(len(first), -1, dtype=np.int64)
    shared[inner] = common
    return order, shared


_SPANS = "gram long, digest long, often long, off int, size int, span binary"
_CUTS = "gram long, digest long, cuts array<struct<`from`:long,`to`:long>>"
_CUT_TYPE = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


class Repeats:
    """What the tasks do, with the sizes they work by."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE, sort: int = SORT):
        self.window, self.gram, self.piece, self.sort = window, gram, piece, sort

    def chosen(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with the same chosen gram: hash and place of the gram, first and last window."""
        every = Prefixes(np.frombuffer(text, dtype=np.uint8)).every(self.gram)
        low, have, width = (every & _HIGH) | np.arange(len(every), dtype=np.uint64), 1, self.window - self.gram + 1
        while 2 * have <= width:
            low, have = np.minimum(low[:-have], low[have:]), 2 * have
        rest = width - have
        place = (np.minimum(low[:len(low) - rest], low[rest:]) & ~_HIGH).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        return every[place[first]], place[first], first, np.append(first[1:], len(place)) - 1

    def runs(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``chosen`` of a text of any length, in pieces; a run that reaches the end of a piece opens the next."""
        at, last = 0, len(text) - self.window
        while at <= last:
            gram, place, lo, hi = self.chosen(text[at:at + self.piece + self.window - 1])
            if at + self.piece <= last:
                yield gram[:-1], place[:-1] + at, lo[:-1] + at, hi[:-1] + at
                at += int(lo[-1])
            else:
                yield gram, place + at, lo + at, hi + at
                return

    def run_rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts (id, mark, bytes) to their runs, each with a digest of its span and of the gram's place in it."""
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                if not text or len(text) < self.window:
                    continue
                for gram, place, lo, hi in self.runs(text):
                    n, off = len(gram), place - lo
                    digest = np.frombuffer(b"".join(
                        hashlib.blake2b(text[a:b], digest_size=8, salt=bytes((c,))).digest()
                        for a, b, c in zip(lo.tolist(), (hi + self.window).tolist(), off.tolist())), dtype=np.int64)
                    same = [pa.array([batch.column(c)[i].as_py()] * n, pa.int64()) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [*same, pa.array(gram.astype(np.int64)), pa.array(digest), pa.array(lo, pa.int64()),
                         pa.array(off, pa.int32()), pa.array(hi - lo, pa.int32())],
                        names=["id", "mark", "gram", "digest", "lo", "off", "size"])

    def repeated_windows(self, group: np.ndarray, spans: list[bytes], off: np.ndarray, size: np.ndarray, often: np.ndarray) -> np.ndarray:
        """For every span and distance before its gram: is the window there repeated?  Members of a group stand together."""
        n = len(spans)
        data = np.frombuffer(b"".join(spans), dtype=np.uint8)
        sizes = np.array([len(s) for s in spans], dtype=np.int64)
        base = np.cumsum(sizes) - sizes
        new = np.concatenate([[True], group[1:] != group[:-1]])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, n))
        first, count = np.repeat(begin, count), np.repeat(count, count)
        after, with_last = sorted_suffixes(data, base + off, sizes - off, first, count)
        before, with_first = sorted_suffixes(data[::-1].copy(), len(data) - base - off, off, first, count)
        out = np.zeros((n, self.window - self.gram + 1), dtype=bool)
        right, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for d in range(self.window - self.gram + 1):
            there = np.flatnonzero((off - size <= d) & (d <= off))
            if not len(there):
                continue
            right[after] = np.cumsum(with_last < self.window - d)
            left[before] = np.cumsum(with_first < d)
            _, which, many = np.unique(left[there] * (n + 1) + right[there], return_inverse=True, return_counts=True)
            out[there, d] = (many[which] > 1) | (often[there] > 1)
        return out

    def cuts_of(self, repeated: np.ndarray, off: int) -> list[dict]:
        """The bytes of a span that its repeated windows cover."""
        out: list[dict] = []
        for s in sorted(off - d for d in np.flatnonzero(repeated).tolist()):
            if out and s <= out[-1]["to"]:
                out[-1]["to"] = s + self.window
            else:
                out.append({"from": s, "to": s + self.window})
        return out

    def span_rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, mark, packed text, wanted spans) to the spans, once where a text comes again."""
        seen: set = set()
        for batch in batches:
            rows = []
            for doc_id, mark, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc_id, mark) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add((doc_id, mark))
                text = zlib.decompress(text)
                rows += [(w["gram"], w["digest"], w["often"], w["off"], w["size"], text[w["lo"]:w["lo"] + w["size"] + self.window]) for w in wanted]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["gram", "digest", "often", "off", "size", "span"])

    def sort_spans(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans, sorted by gram, to the bytes that repeated windows cover; some groups at a time."""

        def told(rows):
            gram, digest, often, off, size, spans = zip(*rows)
            group = np.array(gram, dtype=np.int64)
            off, size, often = (np.array(x, dtype=np.int64) for x in (off, size, often))
            found = self.repeated_windows(group, list(spans), off, size, often)
            some = np.flatnonzero(found.any(axis=1)).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([gram[i] for i in some], pa.int64()), pa.array([digest[i] for i in some], pa.int64()),
                 pa.array([self.cuts_of(found[i], int(off[i])) for i in some], _CUT_TYPE)], names=["gram", "digest", "cuts"])

        held: list = []
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, members in groupby(rows, key=itemgetter(0)):
            held += members
            if len(held) >= self.sort:
                yield told(held)
                held = []
        if held:
            yield told(held)

    def window_rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window of the spans, by its digest in two parts."""
        for batch in batches:
            rows = []
            for gram, digest, often, off, size, span in zip(*(c.to_pylist() for c in batch.columns)):
                for s in range(size + 1):
                    h = hashlib.blake2b(span[s:s + self.window], digest_size=16).digest()
                    rows.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), gram, digest, often, s))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (*(pa.int64(),) * 5, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["one", "two", "gram", "digest", "often", "s"])


def span_cuts(spans: DataFrame, full: DataFrame, work: Repeats) -> DataFrame:
    """gram, digest, cuts of every span with a repeated window; grams in ``full`` have too many spans for a task."""
    few = spans.join(full, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram").mapInArrow(work.sort_spans, _CUTS)
    many = spans.join(full, "gram", "left_semi").select("gram", "digest", "often", "off", "size", "span")
    many = materialize(many.mapInArrow(work.window_rows, "one long, two long, gram long, digest long, often long, s int"), "windows")
    again = many.groupBy("one", "two").agg(F.sum("often").alias("n")).where("n > 1").drop("n")
    many = many.join(again, ["one", "two"], "left_semi").groupBy("gram", "digest").agg(F.collect_set(
        F.struct(F.col("s").cast("long").alias("from"), (F.col("s") + work.window).cast("long").alias("to"))).alias("cuts"))
    return few.unionByName(many)


def joined(spans) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["from"], s["to"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_KEPT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, removed string"


def keep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, cuts in zip(*(c.to_pylist() for c in batch.columns)):
            text = zlib.decompress(text) if text else b""
            spans, parts, at = joined(cuts or ()), [], 0
            for start, end in spans:
                parts.append(text[at:start])
                at = end
            parts.append(text[at:])
            rows.append((doc_id, b"".join(parts), len(text), sum(b - a for a, b in spans), len(spans), ",".join(f"{a}:{b}" for a, b in spans)))
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.binary(), *(pa.int64(),) * 3, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                         names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "removed"])


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", work: Repeats = Repeats()) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept bytes, n_bytes, n_removed, n_spans, removed.

    A byte goes if a string of ``work.window`` bytes over it also starts at another place, in this text or
    another; all such places lose it, none keeps it.  ``removed`` lists start:end of the runs removed, in
    bytes of the UTF-8 text; ``kept`` may be cut within a character.  Null and empty texts and those shorter
    than this keep all they have.  Rows with one id are documents of their own; repeated rows
    lose the same.  Texts of any length are read in pieces.  Without documents the result is empty.
    Other columns are ignored.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    found = materialize(docs.mapInArrow(work.run_rows, _RUNS), "window-runs")
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("digest") != F.max("digest")).alias("mixed"))
    grams = materialize(grams.where("n > 1").select("gram", "mixed"), "repeated-grams")
    found = materialize(found.join(grams, "gram"), "repeated-runs")

    mixed = found.where("mixed")
    place = F.min(F.struct("id", "mark", "lo", "off", "size"))
    spans = mixed.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("often"), place.alias("p")).select("gram", "digest", "often", "p.*")
    spans = materialize(spans, "different-spans")
    full = materialize(spans.groupBy("gram").count().where(F.col("count") > work.sort).select("gram"), "full-grams")
    wanted = spans.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__m")).agg(
        F.collect_list(F.struct("gram", "digest", "often", "lo", "off", "size")).alias("wanted"))
    texts = docs.select("id", "mark", F.pandas_udf(packed, "binary")("text").alias("text"))
    own = F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__m"))
    spans = materialize(texts.join(wanted, own).select("id", "mark", "text", "wanted").mapInArrow(work.span_rows, _SPANS), "span-texts")
    cuts = materialize(span_cuts(spans, full, work), "span-cuts")

    whole = found.where("NOT mixed").select("id", "mark", F.col("lo").alias("from"), (F.col("lo") + F.col("size") + work.window).alias("to"))
    part = mixed.join(cuts, ["gram", "digest"]).select("id", "mark", "lo", F.explode("cuts").alias("c"))
    part = part.select("id", "mark", (F.col("lo") + F.col("c.from")).alias("from"), (F.col("lo") + F.col("c.to")).alias("to"))
    gone = whole.unionByName(part).groupBy(F.col("id").alias("__id"), F.col("mark").alias("__m")).agg(
        F.collect_set(F.struct("from", "to")).alias("cuts"))
    return texts.join(gone, own, "left").select("id", "text", "cuts").mapInArrow(keep_rest, _KEPT)
