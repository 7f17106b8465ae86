"""Ranked lexical search by best positions.

Every document is scored against every item.  The corpus is cut into shards; a shard holds one impact
list for each term, sorted by impact.  All lists of an item are read from the top at the same depth.  A
document met in one list is looked up in the others at once, which gives its whole score and its
positions there.  The best position of a list is the end of the part seen without a gap, whether by
reading or by lookup: no document that is still unseen can score more than the sum of the impacts at
the best positions.  Reading ends when this sum is strictly below the k-th best score, so that equal
scores are still found and ranked by id.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.session import materialize

#: Terms of items that are searched together; their terms and weights go to every task.
BLOCK = 500_000
#: Postings of a shard: what a task holds at a time.
SHARD = 2_000_000
#: Positions read from every list in the first round; doubled from round to round.
DEPTH = 32
#: Longer terms are known by their digest, so that a block of terms has a bounded size.
LONGEST = 64

_IN_TERM = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 32 for i in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The runs of letters, digits and characters beyond ASCII of a UTF-8 text, only A-Z lower-cased."""
    return text.translate(_IN_TERM).split() if text else []


def short(term: bytes) -> bytes:
    """The term, or a digest no term can equal if it is long."""
    return term if len(term) <= LONGEST else b" " + hashlib.sha256(term).digest()


class Shard:
    """Impact lists over some documents, with lookups from a document to its places in the lists."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, offsets: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.no_id, self.offsets, self.term, self.impact = ids, no_id, offsets, term, impact
        self.order = np.lexsort((-impact, term))
        self.place = np.empty(len(term), dtype=np.int64)
        self.place[self.order] = np.arange(len(term))
        self.doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
        self.listed_doc, self.listed_impact = self.doc[self.order], impact[self.order]
        ends = np.cumsum(np.bincount(term, minlength=n_terms))
        self.ends, self.starts = ends, ends - np.bincount(term, minlength=n_terms)
        self.seen = np.zeros(len(term), dtype=bool)
        self.known = np.zeros(len(ids), dtype=bool)
        self.wanted = np.zeros(n_terms, dtype=bool)

    def lookup(self, docs: np.ndarray) -> np.ndarray:
        """The postings of these documents for the wanted terms."""
        sizes = self.offsets[docs + 1] - self.offsets[docs]
        first = np.cumsum(sizes) - sizes
        rows = np.repeat(self.offsets[docs] - first, sizes) + np.arange(sizes.sum())
        return rows[self.wanted[self.term[rows]]]

    def search(self, wanted: np.ndarray, top: "Top", step: int = DEPTH) -> int:
        """Offer every document that can be among the best to ``top``; the depth reached."""
        lists = [(s, e) for s, e in zip(self.starts[wanted].tolist(), self.ends[wanted].tolist()) if s < e]
        if not lists:
            return 0
        self.wanted[wanted] = True
        best = [s for s, _ in lists]
        met, marked, depth = [], [], 0
        while True:
            read = [self.listed_doc[s + depth:min(s + depth + step, e)] for s, e in lists if s + depth < e]
            if not read:
                break
            depth, step = depth + step, 2 * step
            docs = np.unique(np.concatenate(read))
            docs = docs[~self.known[docs]]
            if len(docs):
                self.known[docs] = True
                met.append(docs)
                rows = self.lookup(docs)
                places = self.place[rows]
                self.seen[places] = True
                marked.append(places)
                where = np.searchsorted(docs, self.doc[rows])
                scores = np.zeros(len(docs), dtype=np.int64)
                np.add.at(scores, where, self.impact[rows])
                top.offer(scores, self.ids[docs], self.no_id[docs])
            threshold = 0
            for i, (_, e) in enumerate(lists):
                at = best[i]
                if at < e:
                    unseen = int(np.argmin(self.seen[at:e]))
                    best[i] = at = e if unseen == 0 and self.seen[at] else at + unseen
                if at < e:
                    threshold += int(self.listed_impact[at - 1])
            if threshold < top.least:
                break
        self.wanted[wanted] = False
        for docs in met:
            self.known[docs] = False
        for places in marked:
            self.seen[places] = False
        return depth


class Top:
    """The k best documents so far: by score, then id, missing ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        #: The k-th best score; 1 while there are fewer, as scores of 0 don't count.
        self.least = 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        parts = ((self.scores, scores[good]), (self.ids, ids[good]), (self.no_id, no_id[good]))
        scores, ids, no_id = (np.concatenate(p) for p in parts)
        order = np.lexsort((ids, no_id, -scores))[:self.k]
        self.scores, self.ids, self.no_id = scores[order], ids[order], no_id[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def posting_rows(vocabulary: dict[bytes, int]):
    """Documents to their number of terms and their counts of the given terms; documents without a term are left out."""
    has_long = any(t.startswith(b" ") for t in vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, offsets, which, often = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(text)
                if not found:
                    continue
                counts = Counter(found)
                if has_long:
                    counts = {short(t): n for t, n in counts.items()}
                for term in counts.keys() & vocabulary.keys():
                    which.append(vocabulary[term])
                    often.append(counts[term])
                ids.append(doc_id)
                lengths.append(len(found))
                offsets.append(len(which))
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(which, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(often, pa.int64()))], names=["doc_id", "n", "term", "tf"])

    return run


def best_rows(weights: np.ndarray, wanted: list[tuple[int, int | None, np.ndarray]], n_docs: int, n_all: int, k: int, size_of_shard: int):
    """The k best documents of a task for every item; ``wanted`` holds (number, item_id, terms)."""

    def lists_of(batch: pa.RecordBatch):
        n = batch.column(1).to_pylist()
        m = np.array([10 + 90 * x * n_docs // n_all for x in n], dtype=np.int64)
        term, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
        ids = batch.column(0)
        return (ids.fill_null(0).to_numpy(zero_copy_only=False), np.array(ids.is_null().to_pylist(), dtype=bool), sizes, term, impact)

    def search(held: list, tops: dict[int, Top]) -> None:
        ids, no_id, sizes, term, impact = (np.concatenate(x) for x in zip(*held))
        shard = Shard(ids, no_id, np.concatenate([[0], np.cumsum(sizes)]), term, impact, len(weights))
        for number, _, of in wanted:
            shard.search(of, tops[number])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {number: Top(k) for number, _, _ in wanted}
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(lists_of(batch))
                size += len(held[-1][3])
            if size >= size_of_shard:
                search(held, tops)
                held, size = [], 0
        if held:
            search(held, tops)
        for number, item_id, _ in wanted:
            top = tops[number]
            if len(top.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(top.ids), pa.int64()), pa.array([item_id] * len(top.ids), pa.int64()),
                     pa.array(top.ids, pa.int64(), mask=top.no_id), pa.array(top.scores, pa.int64())],
                    names=["number", "item_id", "doc_id", "score"])

    return run


def search_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for the items of one block, given as (item_id, text) rows."""
    asked = [(r[0], sorted({short(t) for t in terms(None if r[1] is None else bytes(r[1]))})) for r in rows]
    vocabulary: dict[bytes, int] = {}
    for _, some in asked:
        for term in some:
            vocabulary.setdefault(term, len(vocabulary))
    postings = materialize(docs.mapInArrow(posting_rows(vocabulary), "doc_id long, n long, term array<int>, tf array<long>"), "postings")
    n_docs, n_all = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    holding = np.zeros(len(vocabulary), dtype=np.int64)
    for term, df in postings.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        holding[term] = df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) if df else 0 for df in holding.tolist()], dtype=np.int64)
    wanted = []
    for number, (item_id, some) in enumerate(asked):
        of = np.array([vocabulary[t] for t in some], dtype=np.int64)
        of = of[weights[of] > 0]
        if len(of):
            wanted.append((number, item_id, of))
    found = postings.mapInArrow(best_rows(weights, wanted, n_docs, n_all or 1, k, SHARD), "number long, item_id long, doc_id long, score long")
    order = Window.partitionBy("number", "item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id",
           item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, those with a score above 0.

    Every row of ``docs`` is a document and every row of ``items`` an item, rows with the same id
    too.  Null and empty texts hold no term: such a document is never found and doesn't count, such
    an item finds nothing.  Equal scores go by ascending doc_id, null ids last.  Whole texts of any
    length count.  Without documents or items the result is empty.  Other columns are ignored.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    items = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    # Two bytes make a term at least.
    blocks = 1 + int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // (2 * BLOCK)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = [search_block(docs, items.where(block == b).collect(), k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


#: Weights in doubles, all else in integers.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM counts, corpus GROUP BY term),
scores AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
  GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
