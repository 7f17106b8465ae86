"""Spelling variants of words by an index of variable-length grams.

A dictionary holds the grams of ``SHORT`` characters and, where such a gram is frequent, its longer
continuations.  A word is cut into the longest grams of the dictionary at each place, less those inside
others.  For every word the number of grams that one edit can change is bounded, from what the cutting
looked at around each place; the others must stand in a near word too: the first ``a`` grams before the
edit, the last ``b`` grams after it.  So words are merged where their first ``a`` and last ``b`` grams
agree, for each ``a + b`` equal to the bound, and compared there.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.session import materialize

#: Characters of the shortest and of the longest gram.
SHORT, LONG = 2, 3
#: A gram is continued if it occurs more often than this share of the number of words.
OFTEN = 0.005
#: Grams that two words must share at most; a larger bound is not used.
MOST = 4
#: Words that meet under one key in a task; beyond that they meet under the words with one character less.
MEET = 20_000
#: A form is so many times as frequent as its variant.
TIMES = 10
#: One in so many runs of a document loses a character.
LOSE = 31

_IN_RUN = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x61 <= i <= 0x7A or i >= 0xC0 else 32 for i in range(256))


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """Words of a text, each as often as it occurs; Latin-1.  Other characters end a run."""
    if not text:
        return Counter()
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(_IN_RUN).split()).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % LOSE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def count_words(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()),
                                              pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in words_of(doc_id, text).items():
                    if len(word) >= least:
                        counts[word] += n
            if len(counts) > 200_000:
                yield told()
        yield told()

    return run


def count_grams(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                counts.update(word[i:i + size] for i in range(len(word) - size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], names=["gram", "n"])

    return run


class Grams:
    """A gram dictionary: grams longer than ``short`` and what can be read of them from either end."""

    def __init__(self, longer: Iterable[str], short: int = SHORT, long: int = LONG):
        self.short, self.long, self.longer = short, long, frozenset(longer)
        self.heads = frozenset(g[:j] for g in self.longer for j in range(1, len(g) + 1))
        self.tails = frozenset(g[j:] for g in self.longer for j in range(1, len(g)))

    def cut(self, word: str) -> tuple[list[int], list[int], list[int]]:
        """Starts and ends of the word's grams; for each place the last place its gram depends on."""
        starts, ends, reach, top, n = [], [], [], 0, len(word)
        for p in range(n):
            size = read = 0
            while read < self.long and p + read < n and word[p:p + read + 1] in self.heads:
                read += 1
                if word[p:p + read] in self.longer:
                    size = read
            reach.append(p + max(self.short - 1, min(read, self.long - 1)))
            end = p + max(size, self.short)
            if end > top and end <= n:
                starts.append(p)
                ends.append(end)
                top = end
        return starts, ends, reach

    def bound(self, word: str, starts: list[int], ends: list[int], reach: list[int]) -> int:
        """Grams that every word at one edit shares, as first or last ones: all but the most that an edit can change."""
        n, most = len(word), 0
        for at in range(n + 1):
            low = next((p for p in range(max(0, at - self.long), at) if reach[p] >= at), at)
            first = bisect_left(starts, low)
            for after in (at, at + 1):  # the edit is before place at, or takes it
                far = after
                for end in range(min(n, after + self.long - 1), after, -1):
                    if word[after:end] in self.tails:
                        far = end
                        break
                most = max(most, max(bisect_left(starts, after), bisect_right(ends, far)) - first)
        return len(starts) - most


def keys(word: str, starts: list[int], ends: list[int], bound: int, most: int = MOST) -> list[tuple[int, str, str]]:
    """(level, head, tail) under which the word meets its near words; ``[]`` where it has too few grams.

    A pair meets at the larger of its two bounds, at most ``most``; there every word with that bound
    or a lower one is found.
    """
    out = []
    for level in range(max(1, min(bound, most)), min(most, len(starts)) + 1):
        for a in range(level + 1):
            b = level - a
            out.append((level, word[:ends[a - 1]] if a else "", word[starts[-b]:] if b else ""))
    return out


def entries(grams: Grams, most: int):
    """Words to their keys: as many rows as keys, and one with level 0 if a near word may share no gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts, ends, reach = grams.cut(word)
                bound = grams.bound(word, starts, ends, reach)
                if bound < 1:
                    rows.append((0, "", "", word, n))
                rows += [(*k, word, n) for k in keys(word, starts, ends, bound, most)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                names=["level", "head", "tail", "word", "n"])

    return run


def near(one: str, two: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced character?"""
    if abs(len(one) - len(two)) > 1 or one == two:
        return False
    if len(one) > len(two):
        one, two = two, one
    at = 0
    while at < len(one) and one[at] == two[at]:
        at += 1
    return one[at + (len(one) == len(two)):] == two[at + 1:]


def near_pairs(members: list[tuple[str, int]], head: int, tail: int) -> Iterator[tuple[str, int, str, int]]:
    """Near words among words that agree in their first ``head`` and last ``tail`` characters, each pair once."""
    if len(members) <= 8:
        for i, (one, n) in enumerate(members):
            for two, m in members[:i]:
                if near(one, two):
                    yield one, n, two, m
        return
    whole = dict(members)
    replaced: dict[tuple[int, str], list[str]] = {}
    for word, n in members:
        dropped = set()
        for at in range(head, max(len(word) - tail, head + 1)):
            left = word[:at] + word[at + 1:]
            others = replaced.setdefault((at, left), [])
            for other in others:
                yield word, n, other, whole[other]
            others.append(word)
            if left in whole and left not in dropped and left != word:
                dropped.add(left)
                yield word, n, left, whole[left]


_PAIRS = "word string, n long, other string, other_n long"


def told(pairs: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
    both = [(a, n, b, m) for a, n, b, m in pairs] + [(b, m, a, n) for a, n, b, m in pairs]
    columns = list(zip(*both)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))],
                                      names=["word", "n", "other", "other_n"])


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, both ways, among the rows (level, head, tail, word, n), which come sorted by key."""
    found: list = []
    for (_, head, tail), group in groupby(rows(batches), key=itemgetter(0, 1, 2)):
        members = [(r[3], r[4]) for r in group]
        if len(members) > 1:
            found += near_pairs(members, len(head), len(tail))
            if len(found) > 20_000:
                yield told(found)
                found = []
    yield told(found)


def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word under each word with one character less, and under itself."""
    for batch in batches:
        out = [(left, at, word, n) for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
               for left, at in [(word, -1), *((word[:i] + word[i + 1:], i) for i in range(len(word)))]]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                         names=["left", "at", "word", "n"])


def shortened_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, both ways, among the rows (left, at, word, n), which come sorted by left and at."""
    found: list = []
    for left, group in groupby(rows(batches), key=itemgetter(0)):
        itself = None
        for at, some in groupby(group, key=itemgetter(1)):
            members = [(r[2], r[3]) for r in some]
            if at < 0:
                itself = members[0]
                continue
            for i, one in enumerate(members):
                found += [(*one, *two) for two in members[:i]]
                if itself is not None and one[0] != itself[0]:
                    found.append((*one, *itself))
        if len(found) > 20_000:
            yield told(found)
            found = []
    yield told(found)


def vocabulary(docs: DataFrame, least: int = 7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n of all words of ``least`` characters that occur twice or more."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = docs.mapInArrow(count_words(least), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")


def dictionary(words: DataFrame, often: float = OFTEN) -> Grams:
    """Frequent grams continued until they are rare or ``LONG``; at most 1 / often of a word's length, times the alphabet."""
    limit = often * words.count()
    front, longer = None, []
    for size in range(SHORT, LONG + 1):
        grams = words.select("word").mapInArrow(count_grams(size), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        if front is None:
            front = [r.gram for r in grams.where(F.col("n") > limit).collect()]
            continue
        grams = grams.where(F.substring("gram", 1, size - 1).isin(front) if front else F.lit(False)).collect()
        longer += [r.gram for r in grams]
        front = [r.gram for r in grams if r.n > limit]
    return Grams(longer)


def neighbours(words: DataFrame, most: int = MOST, meet: int = MEET, often: float = OFTEN) -> DataFrame:
    """word, n, other, other_n: every near word of every word, once.  ``words`` holds distinct words with their n."""
    grams = dictionary(words, often)
    index = materialize(words.select("word", "n").mapInArrow(entries(grams, most), "level int, head string, tail string, word string, n long"), "gram-index")
    key = ["level", "head", "tail"]
    # Few keys are so frequent; their words, and those without a certain gram, meet under words with a character less.
    full = materialize(index.groupBy(*key).count().where(F.col("count") > meet).select(*key), "full-keys")
    rest = index.join(full, key, "left_semi").unionByName(index.where("level = 0")).select("word", "n").distinct()
    rare = index.where("level > 0").join(full, key, "left_anti")
    found = rare.repartition(*key).sortWithinPartitions(*key).mapInArrow(merged, _PAIRS)
    less = rest.mapInArrow(shortened, "left string, at int, word string, n long")
    more = less.repartition("left").sortWithinPartitions("left", "at").mapInArrow(shortened_pairs, _PAIRS)
    return found.unionByName(more).repartition("word").dropDuplicates(["word", "other"])


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", **sizes) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), only A-Z lower-cased, of 7 characters and 2
    occurrences or more; one in 31 runs of a document has lost a character by the hash of ``<doc_id>:<run>``.
    The form is the near word of largest n, the smallest of several, if that n is 10 times the word's
    or more; the root is the last form reached from a word.  Whole texts count; null and empty texts hold
    no word.  A null id is hashed as nothing before the colon.  Rows with one id count each.  Without
    words the result is empty.  Other columns are ignored.  ``sizes`` go to ``neighbours``.
    """
    words = materialize(vocabulary(docs, text=text, key=key), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    by_word = neighbours(words, **sizes).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = -F.col("best.less") >= TIMES * F.col("n")
    by_word = by_word.select("word", "n_near", F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    by_word = materialize(by_word, "near-words")
    roots = by_word.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # every round follows twice as many forms, and each form is ten times as frequent
        further = roots.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        roots = materialize(roots.join(further, F.col("root") == F.col("__word"), "left").select(
            "word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")), "roots")
        moved = not roots.where("moved").isEmpty()
        roots = roots.select("word", "root")
        if not moved:
            break
    out = words.join(by_word, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
