"""Benchmark passages in documents, verbatim or paraphrased, by latent semantic retrieval.

Documents are cut into passages of ``PASSAGE`` words.  Their TF-IDF rows over the
benchmark's vocabulary, with those of the benchmark itself, get a randomised
singular value decomposition in one pass, its sums over all passages made by the tasks.  Passages near a
benchmark passage in the latent space are candidates; the longest common subsequence
with it, and the words of its answer, decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.llm.text import free_name, words
from watchgrid.session import materialize

PASSAGE = 64
STRIDE = 32
#: Latent dimensions; a block of benchmark passages is no larger, so that each of them has its place.
DIMENSIONS = 256
BLOCK = 224
#: Least cosine of a candidate, common subsequence that decides alone, and with the answer's words.
COSINE = 0.3
VERBATIM = 0.8
PARAPHRASE = 0.6
ANSWER = 0.75
#: Words in more than this part of the benchmark's passages (and more than three) do not characterise any.
COMMON = 0.02
#: Documents with candidates that are sent to every task; ten places each on average.
SENT = 100_000
SEED = 20240501
_CELLS = 1 << 12  # rows of the basis at once: few enough to stay in a processor's cache
_SQUARE = 8192  # words up to which a task keeps A'A: half of it in single precision, 134 MB
_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)")


class Block:
    """Some benchmark passages: their words, answers and vocabulary."""

    def __init__(self, items: list[tuple[object, str]], common: frozenset[str]):
        self.ids, self.words, self.answers = [], [], []
        for item_id, text in items:
            found = words(text)
            closing = [words(s) for s in _SENTENCE.split(text) if words(s)]
            answer = closing[-1] if len(closing) > 1 and len(closing[-1]) <= len(found) // 2 else found[-max(1, len(found) // 5):]
            self.ids.append(item_id)
            self.words.append(found)
            self.answers.append(Counter(answer))
        self.counts = [(tuple(c), tuple(c.values())) for c in map(Counter, self.words)]
        self.reach = max(len(found) for found in self.words) // 2 + 4  # words beside a passage that may belong to an item
        # A passage of common words only keeps them: it could not be found otherwise.
        kept = {w for found in self.words for w in (set(found) - common or set(found))}
        self.vocabulary = {w: i for i, w in enumerate(sorted(kept))}

    def rows(self, idf: np.ndarray) -> np.ndarray:
        """TF-IDF rows of the passages."""
        out = np.zeros((len(self.words), len(self.vocabulary)), dtype=np.float32)
        for i, found in enumerate(self.words):
            for w, n in Counter(found).items():
                j = self.vocabulary.get(w)
                if j is not None:
                    out[i, j] = (1 + np.log(n)) * idf[j]
        return out


def cells(found: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(place, vocabulary index) of the words of a text that the vocabulary holds."""
    index = np.fromiter(map(vocabulary.get, found, repeat(-1)), dtype=np.int64, count=len(found))
    place = np.flatnonzero(index >= 0)
    return place, index[place]


def weighted(row: np.ndarray, index: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, TF-IDF weight) of the different cells, by row."""
    key, times = np.unique(row * len(idf) + index, return_counts=True)
    row, index = key // len(idf), key % len(idf)
    return row, index, ((1 + np.log(times)) * idf[index]).astype(np.float32)


def encoded(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, mark, n (words), stride and index of the vocabulary's words in every text that has words."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, n, strides, indexes = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = words(text)
                if found:
                    place, index = cells(found, vocabulary.value)
                    some.append(i)
                    n.append(len(found))
                    strides.append((place // STRIDE).astype(np.int32))
                    indexes.append(index.astype(np.int32))
            kept = batch.select([0, 1]).take(pa.array(some, pa.int64()))
            ends = pa.array(np.cumsum([0, *map(len, strides)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *x])) for x in (strides, indexes)]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n, pa.int64()), *lists], names=["doc_id", "mark", "n", "stride", "index"])

    return docs.select("doc_id", "mark", "__text").mapInArrow(run, "doc_id long, mark long, n long, stride array<int>, index array<int>")


def _cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Passages numbered through a batch of (n, stride, index), with their vocabulary indexes."""
    lists = batch.column(1)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    passages = -(-batch.column(0).to_numpy(zero_copy_only=False) // PASSAGE)
    before = np.concatenate([[0], np.cumsum(passages)[:-1]]) if len(passages) else passages
    row = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) // (PASSAGE // STRIDE) + np.repeat(before, sizes)
    return row, batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def frequencies(cells_of: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """(passages, passages that hold each word), over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(size + 1, dtype=np.int64), 0
        for batch in batches:
            if batch.num_rows:
                row, index = _cells_of(batch)
                count[:size] += np.bincount(np.unique(row * size + index) % size, minlength=size)
                total += int((-(-batch.column(0).to_numpy(zero_copy_only=False) // PASSAGE)).sum())
        count[size] = total
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some], pa.int64())], names=["i", "n"])

    out = np.zeros(size + 1, dtype=np.int64)
    sums = cells_of.select("n", "stride", "index").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    for i, n in sums.collect():  # one number per word of the benchmark
        out[i] = n
    return int(out[size]), out[:size]


def _multiply(row: np.ndarray, index: np.ndarray, weight: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """Add A'(A basis) of the rows of A given by (row, index, weight), by row, to ``out``."""
    for lo in range(0, len(row), _CELLS):
        hi = min(len(row), lo + _CELLS)
        # Whole rows: a row cut by the step is finished in it.
        lo += 0 if lo == 0 else int(np.searchsorted(row[lo:], row[lo - 1], side="right"))
        hi += 0 if hi == len(row) else int(np.searchsorted(row[hi:], row[hi - 1], side="right"))
        if lo >= hi:
            continue
        r, i, w = row[lo:hi], index[lo:hi], weight[lo:hi, None]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        cell = basis[i]
        cell *= w
        product = np.add.reduceat(cell, starts, axis=0)
        order = np.argsort(i, kind="stable")
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(r))))
        back = product[owner[order]]
        back *= w[order]
        firsts = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]]))
        out[i[order][firsts]] += np.add.reduceat(back, firsts, axis=0)


class Square:
    """A'A of rows given by (row, index, weight): the upper triangle, row after row of the words.

    A passage holds few of the words, so its pairs of words are far fewer numbers than its products with the basis.
    """

    def __init__(self, size: int):
        self.size = size
        self.begin = np.arange(size, dtype=np.int64) * (2 * size - 1 - np.arange(size, dtype=np.int64)) // 2
        self.sums = np.zeros(size * (size + 1) // 2, dtype=np.float32)

    def add(self, row: np.ndarray, index: np.ndarray, weight: np.ndarray) -> None:
        """More rows of A; cells by row, then index."""
        first, lag = np.arange(len(row)), 0
        while len(first):
            other = first + lag
            np.add.at(self.sums, self.begin[index[first]] + index[other], weight[first] * weight[other])
            lag += 1
            first = first[:np.searchsorted(first, len(row) - lag)]
            first = first[row[first] == row[first + lag]]

    def times(self, basis: np.ndarray) -> np.ndarray:
        """A'A basis, some rows of the triangle at a time."""
        out = np.zeros(basis.shape, dtype=np.float32)
        for lo in range(0, self.size, 256):
            hi = min(self.size, lo + 256)
            part = np.zeros((hi - lo, self.size - lo), dtype=np.float32)
            for i in range(lo, hi):
                part[i - lo, i - lo:] = self.sums[self.begin[i] + i:self.begin[i] + self.size]
            out[lo:hi] += part @ basis[lo:]
            part[np.arange(hi - lo), np.arange(hi - lo)] = 0
            out[lo:] += part.T @ basis[lo:hi]
        return out


def gathered(cells_of: DataFrame, idf: np.ndarray, basis: np.ndarray) -> DataFrame:
    """i, x: rows of A'(A basis), A holding the TF-IDF rows of all passages; tasks sum their rows, Spark sums the tasks."""
    shared = cells_of.sparkSession.sparkContext.broadcast((idf, basis.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start = shared.value
        out, square = np.zeros(start.shape, dtype=np.float32), None
        for batch in batches:
            if batch.num_rows and len(start) > _SQUARE:
                _multiply(*weighted(*_cells_of(batch), weights), start, out)
            elif batch.num_rows:
                square = square or Square(len(start))
                square.add(*weighted(*_cells_of(batch), weights))
        if square:
            out = square.times(start)
        some = np.flatnonzero(out.any(1))
        for lo in range(0, len(some), 512):
            part = some[lo:lo + 512]
            flat = pa.array(out[part].astype(np.float64).ravel())
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["i", "x"])

    parts = cells_of.select("n", "stride", "index").mapInArrow(run, "i long, x array<double>").select("i", array_to_vector("x").alias("x"))
    return parts.groupBy("i").agg(Summarizer.sum(F.col("x")).alias("x")).select("i", vector_to_array("x").alias("x"))


def decompose(cells_of: DataFrame, block: Block, idf: np.ndarray, passages: int) -> np.ndarray:
    """Right singular vectors (words by dimensions) of the passages' TF-IDF rows.

    Benchmark and corpus get equal total weight, whatever the corpus' size, so that
    each benchmark passage keeps its directions among the leading ones.
    """
    size = len(block.vocabulary)
    k = min(DIMENSIONS, size)

    start = np.random.default_rng(SEED).standard_normal((size, k)) / np.sqrt(size)

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One task: from the image of random directions to the leading directions of the rows (Nystrom's formula)."""
        image = np.zeros((size, k))
        for part in parts:
            for i, x in zip(part["i"], part["x"]):
                image[i] = x
        own = block.rows(idf).astype(np.float64)
        image += max(1, passages) / max(1, len(own)) * (own.T @ (own @ start))
        shift = 1e-9 * max(1e-9, np.linalg.norm(image))
        image += shift * start
        core = start.T @ image
        values, turn = np.linalg.eigh((core + core.T) / 2)
        some = values > shift * 1e-3
        left, _, _ = np.linalg.svd(image @ (turn[:, some] / np.sqrt(values[some])), full_matrices=False)
        yield pd.DataFrame({"i": np.arange(size), "x": list(left)})

    rows = gathered(cells_of, idf, start).repartition(1).mapInPandas(vectors, "i long, x array<double>").collect()
    if not rows:  # no document holds a word of the block, so the task got nothing: the block's own directions
        rows = list(next(vectors(iter(()))).itertuples(index=False, name=None))
    return np.array([r[1] for r in sorted(rows, key=lambda r: r[0])], dtype=np.float32)  # words of the benchmark by dimensions


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; the rows of ``a`` are the bits of a number."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for w in b:
        hit = state & masks.get(w, 0)
        if hit:
            state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def verified(item: list[str], answer: Counter, region: list[str]) -> tuple[float, float, bool]:
    """(common subsequence, answer) as parts of the passage, and whether the region holds the passage."""
    common = common_subsequence(item, region) / len(item)
    there = Counter(region)
    said = sum(min(n, there[w]) for w, n in answer.items()) / max(1, sum(answer.values()))
    return common, said, common >= VERBATIM or common >= PARAPHRASE and said >= ANSWER


_HITS = "doc_id long, mark long, window array<int>, item array<int>, cosine array<float>"


def candidates(cells_of: DataFrame, block: Block, idf: np.ndarray, latent: np.ndarray) -> DataFrame:
    """Places of every document whose latent vector is near a passage's and that hold enough of its words; the text is not read.

    No common subsequence is longer than the words in common: those of the vocabulary, in the strides
    around the place, and as many as the passage has beside the vocabulary.
    """
    own_words = []
    for found in block.words:
        counted = Counter(block.vocabulary.get(w, -1) for w in found)
        free = counted.pop(-1, 0)
        own_words.append((tuple(counted), tuple(counted.values()), PARAPHRASE * len(found) - free - 1e-9))
    shared = cells_of.sparkSession.sparkContext.broadcast((block.rows(idf), idf, latent, own_words, -(-block.reach // STRIDE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, idf, latent, own_words, beside = shared.value
        vectors = (latent * idf[:, None]).astype(np.float32)
        items = own @ latent
        items /= np.maximum(np.sqrt((items * items).sum(1, keepdims=True)), 1e-9)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                starts = np.cumsum([0, *(-(-batch.column(2).to_numpy(zero_copy_only=False) // STRIDE) + 1)])
                sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
                row = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(starts[:-1], sizes)
                index = batch.column(4).flatten().to_numpy(zero_copy_only=False)
                if not len(row):
                    continue
                # Latent sums of strides; a passage is a stride and the next.
                firsts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                sums = np.zeros((int(starts[-1]) + 1, vectors.shape[1]), dtype=np.float32)
                for a in range(0, len(firsts), 512):
                    f = firsts[a:a + 512]
                    end = firsts[a + 512] if a + 512 < len(firsts) else len(row)
                    sums[row[f]] = np.add.reduceat(vectors[index[f[0]:end]], f - f[0], axis=0)
                sums[:-1] += sums[1:]  # a text ends with an empty stride
                at, item, cosine = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
                for a in range(0, len(sums) - 1, 8192):
                    part = sums[a:a + 8192]
                    norm = np.sqrt((part * part).sum(1))
                    some = np.flatnonzero(norm > 1e-6)
                    near = (part[some] / norm[some, None]) @ items.T
                    w, j = np.nonzero(near >= COSINE)
                    at.append(a + some[w])
                    item.append(j)
                    cosine.append(near[w, j])
                at, item, cosine = map(np.concatenate, (at, item, cosine))
                doc = np.searchsorted(starts, at, side="right") - 1
                lo_cell = np.searchsorted(row, np.maximum(at - beside, starts[doc])).tolist()
                hi_cell = np.searchsorted(row, np.minimum(at + 2 + beside, starts[doc + 1])).tolist()
                keep, here, around = [], (0, 0), Counter()
                for i, (a, b, j) in enumerate(zip(lo_cell, hi_cell, item.tolist())):
                    if here != (a, b):
                        here, around = (a, b), Counter(index[a:b].tolist())
                    some, times, least = own_words[j]
                    if sum(map(min, times, map(around.get, some, repeat(0)))) >= least:
                        keep.append(i)
                at, item, cosine, doc = (x[keep] for x in (at, item, cosine, doc))
                held, ends = np.unique(doc, return_index=True)
                ends = pa.array(np.append(ends, len(doc)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in (
                    (at - starts[doc], pa.int32()), (item, pa.int32()), (cosine, pa.float32()))]
                kept = batch.select([0, 1]).take(pa.array(held, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, *lists], names=["doc_id", "mark", "window", "item", "cosine"])

    return cells_of.mapInArrow(run, _HITS).dropDuplicates(["doc_id", "mark"])


def search(docs: DataFrame, cells_of: DataFrame, block: Block, idf: np.ndarray, latent: np.ndarray) -> DataFrame:
    """doc_id, item, cosine, common, answer of every document that holds a passage of the block."""
    hits = materialize(candidates(cells_of, block, idf, latent), "candidates").withColumnsRenamed({"doc_id": "__id", "mark": "__m"})
    size = hits.agg(F.count(F.lit(1)), F.sum(F.size("window"))).first()
    if size[0] <= SENT and (size[1] or 0) <= 10 * SENT:  # checked: beyond, both sides are dealt out by their key
        hits = F.broadcast(hits)
    there = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__m")))
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc_id, body, windows, items, cosines in zip(*(batch[c] for c in ("doc_id", "__text", "window", "item", "cosine"))):
                text, best, at, around = words(body), {}, None, Counter()
                for window, j, cosine in zip(windows.tolist(), items.tolist(), cosines.tolist()):
                    item = block.words[j]
                    begin = window * STRIDE
                    if at != window:
                        at, around = window, Counter(text[max(0, begin - block.reach):begin + PASSAGE + block.reach])
                    # No common subsequence is longer than the words in common.
                    own, times = block.counts[j]
                    if sum(map(min, times, map(around.get, own, repeat(0)))) < PARAPHRASE * len(item):
                        continue
                    reach = len(item) // 2 + 4
                    common, said, good = verified(item, block.answers[j], text[max(0, begin - reach):begin + PASSAGE + reach])
                    if good and best.get(j, (0,))[0] < common:
                        best[j] = (common, said, cosine)
                out += [(doc_id, j, cosine, common, said) for j, (common, said, cosine) in best.items()]
            yield pd.DataFrame(out, columns=["doc_id", "item", "cosine", "common", "answer"])

    # The id travels as text: a null among numbers would turn them into doubles.
    out = there.select(F.col("doc_id").cast("string").alias("doc_id"), "__text", "window", "item", "cosine").mapInPandas(
        run, "doc_id string, item long, cosine double, common double, answer double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def passages_of(benchmark: DataFrame, text: str, key: str) -> Iterator[list[tuple[object, str]]]:
    """Benchmark texts in blocks, long ones cut into passages; texts without words have none."""
    rows = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct().orderBy("t", "k")
    part: list[tuple[object, str]] = []
    for r in rows.toLocalIterator():
        tokens = r["t"].split()
        for lo in range(0, len(tokens), PASSAGE):
            end = len(tokens) if len(tokens) - lo < PASSAGE + PASSAGE // 2 else lo + PASSAGE
            piece = " ".join(tokens[lo:end])
            if words(piece):
                part.append((r["k"], piece))
                if len(part) >= BLOCK:
                    yield part
                    part = []
            if end == len(tokens):
                break
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
          item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """doc_id, item_id, cosine, common, answer of every document that holds a benchmark passage.

    Benchmark passages are taken in blocks of bounded size, each searched in all
    documents, so what is sent to the tasks does not grow with the benchmark.  Null
    and empty texts on either side hold nothing; repeated rows and benchmark texts
    are each reported; rows with a null id are reported with it.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("__text"))
    out = None
    for items in passages_of(benchmark, item_text, item_key):
        seen = Counter(w for _, t in items for w in set(words(t)))
        common = frozenset(w for w, n in seen.items() if n > max(3, COMMON * len(items)))
        block = Block(items, common)
        cells_of = materialize(encoded(own, block), "passages")
        total, held = frequencies(cells_of, len(block.vocabulary))
        idf = np.log((1 + total) / (1 + held)) + 0.1
        latent = decompose(cells_of, block, idf, total)
        names = spark.createDataFrame([(i, str(k)) for i, k in enumerate(block.ids)], "item long, item_id string")
        found = search(own, cells_of, block, idf, latent).join(F.broadcast(names), "item").drop("item")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id string, cosine double, common double, answer double")
    kind = benchmark.schema[item_key].dataType
    out = out.withColumn("item_id", F.col("item_id").cast(kind)).groupBy("doc_id", "item_id")
    return out.agg(*[F.max(c).alias(c) for c in ("cosine", "common", "answer")])


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage; rows with a null id stay."""
    name = free_name(docs, "__dirty")
    dirty = leaks(docs, benchmark, text, key).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(materialize(dirty, "leaks"), F.col(key).cast("long") == F.col(name), "left_anti")
