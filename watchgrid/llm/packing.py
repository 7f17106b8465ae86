"""Packing into sequences of fixed length by cutting-stock column generation.

Each document becomes its token ids and an end id, cut into full sequences and one
rest.  The rests' lengths form a histogram with at most ``capacity`` entries, however
many documents there are.  A linear program over patterns of lengths is solved on the
histogram by pricing new patterns with a knapsack; the rounded patterns are filled
with the documents in the order of their rank among those of equal length.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.session import materialize

CAPACITY = 1024
END_ID = 0
#: The linear program stops when its value is within this part of its own lower bound.
GAP = 0.002
#: It also stops after so many patterns in a row that did not make it better; what it has is always a packing.
STALLED = 200
#: Documents of one length are ranked in groups of about this size.
RANK_GROUP = 4096

# The splitting rule of the vocabulary, spelled out for the characters up to U+00FF.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_LATIN = re.compile(rf" ?[{_L}]++| ?[{_N}]++|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]++|[{_S}]+(?![^{_S}])|[{_S}]+")


# Byte-level vocabularies write each byte as a printable character: printable ones as themselves, the others from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class Encoder(dict):
    """Token ids of texts as little-endian 32-bit numbers; the ids of a piece are remembered up to a bound.

    The vocabulary file belongs to ``tokenizers``.  Its merges are in the order of the ids, so that a
    piece can be merged by rank, which is several times faster than one call of the tokenizer per piece.
    """

    def __init__(self, path: str, most: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        letters = {v: k for k, v in _BYTES.items()}
        ranks = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if all(ord(c) in letters for c in token):
                ranks[bytes(letters[ord(c)] for c in token)] = i
        self.merge = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.most = most

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        ids = self.merge(piece)
        self[piece] = out = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> bytes:
        """A text is split as the tokenizer splits it; pieces do not affect each other.

        Added tokens are single ids wherever they stand, so a text that holds one is left to the tokenizer.
        """
        if self.added.search(text):
            return self.whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        return b"".join(map(self.__getitem__, _LATIN.findall(text)))


def pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full sequences and the rest of every document."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0), batch.column(1)):
                ids = encoder.encode(body.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start:4 * (start + capacity)]
                    rows.append((doc_id.as_py(), start, len(part) // 4, zlib.crc32(part), n))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text")).mapInArrow(run, schema)


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of lengths within the capacity: dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = usable[c]
        best[c] = best[c - 1]
        if k:
            value = best[c - lengths[:k]] + worth[:k]
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], take[c] = value[i], i
    pattern = np.zeros(len(lengths))
    c = capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= lengths[take[c]]
    return float(best[capacity]), pattern


def longest_first(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern that takes the longest of what is left, again and again."""
    pattern, room = np.zeros(len(lengths)), capacity
    i = int(np.searchsorted(lengths, room, side="right")) - 1
    while i >= 0:
        take = int(min(np.ceil(left[i]), room // lengths[i]))
        pattern[i] = take
        room -= take * int(lengths[i])
        i = min(i - 1, int(np.searchsorted(lengths, room, side="right")) - 1)
    return pattern


def first_basis(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, uses): each pattern in turn uses up one more length, so the columns are independent."""
    left = counts.astype(float).copy()
    columns, uses = [], []
    while left.any():
        pattern = longest_first(lengths, left, capacity)
        some = np.flatnonzero(pattern)
        times = left[some] / pattern[some]
        step = times.min()
        left[some] -= step * pattern[some]
        gone = some[times <= step * (1 + 1e-12) + 1e-12]
        left[gone] = 0.0
        columns.append(pattern)
        uses.append(step)
        for i in gone[1:]:  # lengths that run out at the same time
            columns.append(np.eye(len(lengths))[i])
            uses.append(0.0)
    return np.array(columns).T, np.array(uses)


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, uses): the linear program's basis by column generation, uses fractional."""
    # Demands a little apart from each other: no two lengths run out at the same time, so steps are never empty.
    counts = counts * (1 + 1e-6 * np.random.default_rng(len(lengths)).random(len(lengths)))
    columns, uses = first_basis(lengths, counts, capacity)
    inverse = np.linalg.inv(columns)
    stalled, last = 0, np.inf
    while True:
        stalled = 0 if uses.sum() < last * (1 - 1e-5) else stalled + 1
        last = min(last, uses.sum())
        price = inverse.sum(0)
        value, pattern = knapsack(lengths, price, capacity)
        least = max(price @ counts / value, lengths @ counts / capacity)
        if value <= 1 + 1e-9 or uses.sum() <= least * (1 + gap) or stalled > STALLED:
            return columns, uses
        change = inverse @ pattern
        ratio = np.where(change > 1e-9, uses / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        uses = np.maximum(0, uses - step * change)
        uses[out] = step
        columns[:, out] = pattern
        row = inverse[out] / change[out]
        rows = np.flatnonzero(np.abs(change) > 1e-13)
        inverse[rows] -= np.outer(change[rows], row)
        inverse[out] = row


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> pd.DataFrame:
    """Where the documents of each length go: length, lo, hi, sequence, each, offset.

    Ranks lo to hi (exclusive) of a length fill sequences from ``sequence`` on, ``each`` a sequence,
    one after the other from ``offset``.
    """
    rows = []
    sequence = 0
    full = histogram.get(capacity, 0)
    if full:
        rows.append((capacity, 0, full, 0, 1, 0))
        sequence = full
    lengths = np.array(sorted(k for k, n in histogram.items() if k < capacity and n > 0), dtype=np.int64)
    if len(lengths):
        left = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
        done = np.zeros(len(lengths), dtype=np.int64)

        def place(pattern: np.ndarray, times: int) -> None:
            nonlocal sequence
            offset = 0
            for i in np.flatnonzero(pattern)[::-1]:
                each = int(pattern[i])
                rows.append((int(lengths[i]), int(done[i]), int(done[i]) + each * times, sequence, each, offset))
                done[i] += each * times
                left[i] -= each * times
                offset += each * int(lengths[i])
            sequence += times

        columns, uses = patterns(lengths, left.astype(float), capacity, gap)
        for j in np.argsort(-uses):
            pattern = columns[:, j].astype(np.int64)
            some = pattern > 0
            times = min(int(np.floor(uses[j] + 1e-6)), int((left[some] // pattern[some]).min()))
            if times > 0:
                place(pattern, times)
        while left.any():  # what rounding leaves
            pattern = longest_first(lengths, left, capacity).astype(np.int64)
            some = pattern > 0
            place(pattern, int((left[some] // pattern[some]).min()))
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "sequence", "each", "offset"])


def planned(histogram: DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """The plan of a (length, count) table, made by one task: at most ``capacity`` rows for any number of documents."""
    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        yield plan(dict(zip(rows["length"].tolist(), rows["count"].tolist())), capacity)

    schema = "length long, lo long, hi long, sequence long, each long, offset long"
    slots = histogram.repartition(1).mapInPandas(solve, schema).collect()
    return pd.DataFrame(slots, columns=[c.split()[0] for c in schema.split(", ")])


def assign(found: DataFrame, slots: pd.DataFrame) -> DataFrame:
    """sequence_id and offset of every piece, by its rank among those of equal length."""
    n = found.count()
    groups = max(64, n // RANK_GROUP)
    found = found.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    sizes = found.groupBy("length", "__group").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col("length").alias("__l"), F.col("__group").alias("__g"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    inner = Window.partitionBy("length", "__group").orderBy("doc_id", "start", "ids_crc32")
    ranked = (found.withColumn("__in", F.row_number().over(inner) - 1)
              .join(first, (F.col("length") == F.col("__l")) & (F.col("__group") == F.col("__g")))
              .withColumn("__rank", F.col("__first") + F.col("__in")))
    slots = slots.sort_values(["length", "lo"])
    table = {c: slots[c].to_numpy(dtype=np.int64) for c in slots.columns}
    wide = 1 << 44  # ranks stay below, so one sorted key finds the slot of a length and rank

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys = table["length"] * wide + table["lo"]
        length, rank = length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        at = np.searchsorted(keys, length * wide + rank, side="right") - 1
        order = rank - table["lo"][at]
        each = table["each"][at]
        return pd.DataFrame({"sequence_id": table["sequence"][at] + order // each,
                             "offset": table["offset"][at] + order % each * length})

    return ranked.withColumn("__place", place("length", "__rank"))


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone.  Every row is a document of its own,
    whatever its id; a null id stays null.  An empty table gives an empty result.
    """
    found = materialize(pieces(docs, path, text, key, capacity), "pieces")
    placed = assign(found, planned(found.groupBy("length").count(), capacity))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "__place.sequence_id", "__place.offset")
