"""Near copies by order-sensitive minimum hashing.

A text is its sequence of five-word shingles, each with the number of its earlier
occurrences.  Every one of ``TABLES`` sketches takes the ``KEPT`` smallest labelled
shingles under its own hash order and keeps them in the order of the text, so that
two texts agree on a sketch about as often as their edit similarity suggests.
Texts that agree on a sketch are candidates; an alignment within a band decides.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.llm.graph import components
from watchgrid.llm.text import WordHashes, free_name, mix, shingles, words
from watchgrid.session import materialize

SHINGLE = 5
TABLES = 24
KEPT = 3
SIMILARITY = 0.8
#: Members of one leader that are aligned in one group.
GROUP = 512
#: Leaders of a bucket in each round; the last round pairs texts by rare shingles.
LEADERS = (1, 8, None)
#: Texts in which shingles are counted to tell frequent ones, and shingles told.
COUNTED = 20_000
FREQUENT = 100_000
#: Ids of texts that share a sketch that are sent to every task.
SENT = 1_000_000
#: Cells into which a text's labelled shingles are counted.
CELLS = 128
_SEEDS = mix(np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WIDE = 60_000


def labelled(runs: np.ndarray) -> np.ndarray:
    """Hash of each shingle with its number of earlier occurrences."""
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    seen = np.arange(len(runs)) - np.repeat(starts, np.diff(np.append(starts, len(runs))))
    out = np.empty_like(runs)
    out[order] = mix(ranked + mix(seen.astype(np.uint64) + np.uint64(1)))
    return out


def sketch(runs: np.ndarray) -> np.ndarray:
    """One 64-bit digest per table of the smallest labelled shingles in text order."""
    marks = labelled(runs)
    kept = min(KEPT, len(marks))
    if len(marks) > _WIDE:  # a long text goes table by table
        places = np.array([np.argpartition(mix(marks ^ seed), kept - 1)[:kept] for seed in _SEEDS])
    elif kept == len(marks):
        places = np.tile(np.arange(kept), (TABLES, 1))
    else:
        places = np.argpartition(mix(marks[None, :] ^ _SEEDS[:, None]), kept - 1, axis=1)[:, :kept]
    places.sort(axis=1)
    out = _SEEDS.copy()
    for i in range(kept):
        out = mix(out * np.uint64(31) + runs[places[:, i]])
    return out


def cells(runs: np.ndarray) -> bytes:
    """Labelled shingles counted by hash; no two texts have more shingles in common than their cells."""
    counts = np.bincount((labelled(runs) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    return counts.astype("<u4").tobytes()


def in_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """The most shingles that texts with these cells can have in common."""
    if not len(a):
        return pd.Series([], dtype="int64")
    one, other = (np.frombuffer(b"".join(x), dtype="<u4").reshape(-1, CELLS) for x in (a, b))
    return pd.Series(np.minimum(one, other).sum(axis=1).astype(np.int64))


def rarest(runs: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The labelled shingles of which a text that aligns must hold at least one, first ones first.

    All texts order their shingles alike: by ``counts`` of the (sorted) ``frequent`` ones, 0 for others, then by
    hash.  Texts that align have all but ``band`` of the longer one's shingles in common, so the first of these
    stands among the first ``band + 1`` of both.
    """
    marks = labelled(runs)
    seen = np.zeros(len(marks), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, marks), len(frequent) - 1)
        seen = np.where(frequent[at] == marks, counts[at], 0)
    return marks[np.lexsort((marks, seen))[:int(len(marks) * (1 - similarity) + 1e-9) + 1]]


def aligned(a: list[int], b: list[int], similarity: float) -> float:
    """Edit similarity 1 - distance / longer length if it reaches ``similarity``, else 0.

    Furthest-reaching alignment: for each distance the furthest place on every
    diagonal, within the band that the threshold leaves.
    """
    n, m = len(a), len(b)
    longer = max(n, m)
    if not longer:
        return 1.0
    band = int(longer * (1 - similarity) + 1e-9)
    if abs(n - m) > band:
        return 0.0
    if longer - sum((Counter(a) & Counter(b)).values()) > band:  # the distance is at least this
        return 0.0
    reach = {0: 0}
    goal = n - m
    for distance in range(band + 1):
        new = {}
        for k in range(-distance, distance + 1):
            # Diagonals from which the goal lies out of the remaining band need no work.
            if abs(goal - k) > band - distance:
                continue
            if distance == 0:
                i = 0
            else:
                i = max(reach.get(k - 1, -2) + 1, reach.get(k, -2) + 1, reach.get(k + 1, -2))
                if i < 0:
                    continue
                i = min(i, n, m + k)
            j = i - k
            if j < 0:
                continue
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            new[k] = i
        if new.get(goal, -1) >= n:
            return 1 - distance / longer
        reach = new
    return 0.0


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, digest, n (shingles), sketch and cells of every document that has words and an id."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch["doc_id"], batch["__text"]):
                found = words(body)
                if found:
                    runs = shingles(hashes.of(found), SHINGLE)
                    same = hashlib.blake2b(" ".join(found).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append((doc_id, same, len(runs), sketch(runs).astype(np.int64).tolist(), cells(runs)))
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "n", "sketch", "cells"])

    seen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text")).where("doc_id IS NOT NULL")
    return seen.mapInPandas(run, "doc_id long, digest binary, n long, sketch array<long>, cells binary")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b of the pairs (a, b, salt) whose ``texts`` (__id, __text) align.

    The texts of both sides are joined by id.  A leader's pairs are dealt to groups
    of bounded size by ``salt``, and its text goes once to each group.
    """
    members = (pairs.join(texts, F.col("b") == F.col("__id"))
               .select("a", "salt", F.lit(1).alias("side"), "b", F.col("__text").alias("body")))
    leaders = (pairs.select("a", "salt").distinct().join(texts, F.col("a") == F.col("__id"))
               .select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("b"), F.col("__text").alias("body")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        leader, runs = None, []
        for batch in batches:
            good = []
            for a, salt, side, b, body in zip(*(batch[c] for c in ("a", "salt", "side", "b", "body"))):
                own = shingles(hashes.of(words(body)), SHINGLE).tolist()
                if side == 0:
                    if leader != (a, salt):
                        leader, runs = (a, salt), []
                    runs.append(own)
                elif leader == (a, salt) and any(aligned(own, r, similarity) > 0 for r in runs):
                    good.append((a, b))
            yield pd.DataFrame(good, columns=["a", "b"]).astype("int64")

    # Within its group the leader comes first.
    both = leaders.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return both.mapInPandas(run, "a long, b long").distinct()


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id of every row of ``docs``; class_id is the smallest id of the class.

    Two different texts are linked when the alignment of their shingle sequences
    reaches ``similarity``; classes are the connected components.  Texts of the same
    words are one text.  Rows that share a doc_id are one document.  Texts without
    words and null ids are a class of their own (class_id = doc_id).

    Every pair in a bucket of equal sketches ends in one class, aligned, or excluded by
    the lengths or the shingles that both can have in common.  Members of one class
    need no alignment, so a bucket's members are first aligned with few leaders, those
    that share the largest buckets.  The last round takes all texts of buckets that still hold several
    classes; pairs that do not share one of their rarest shingles cannot align and are never formed.
    """
    marks = materialize(sketches(docs, text, key), "sketches")
    same = marks.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("sketch").alias("sketch"),
                                       F.first("cells").alias("cells"))
    same = materialize(same, "texts")
    bucket = same.select("rep", "n", F.posexplode("sketch").alias("t", "h")).select("rep", "n", F.xxhash64("t", "h").alias("bucket"))
    crowd = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(bucket.join(crowd, "bucket"), "bucket-members")
    weight = materialize(members.groupBy("rep").agg(F.sum("size").alias("weight")), "member-weights")
    members = members.drop("size").join(weight, "rep").select("bucket", F.struct("weight", (-F.col("rep")).alias("less"), "rep", "n").alias("m"))
    members = materialize(members, "weighted-members")
    # Only texts that share a sketch are read again: they are written down once, and the joins of all rounds move no others.
    some = weight.select(F.col("rep").alias("__some"))
    if some.count() <= SENT:  # checked: beyond, both sides are dealt out by their key
        some = F.broadcast(some)
    texts = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
    texts = materialize(texts.join(some, F.col("__id") == F.col("__some"), "left_semi"), "member-texts")
    counted = materialize(same.select("rep", "cells").join(some, F.col("rep") == F.col("__some"), "left_semi"), "member-cells")

    tested = labels = None
    for leaders in LEADERS:
        own = _apart(members, labels)
        if own.limit(1).count() == 0:
            break
        todo = _candidates(own, leaders, similarity) if leaders else _sharing(own, texts, similarity)
        if tested is not None:
            todo = todo.join(tested, ["a", "b"], "left_anti")
        todo = _grouped(_possible(todo, counted, similarity))
        pairs = todo.select("a", "b")
        tested = pairs if tested is None else tested.unionByName(pairs)
        good = materialize(verified(todo, texts, similarity), "links")
        if labels is None or good.limit(1).count():
            labels = _merged(labels, good)
    if labels is None:
        labels = members.select(F.col("m.rep").alias("node"), F.col("m.rep").alias("label"))
    # The text of a document, its first holder, the holder's class.
    held = marks.join(same.select("digest", "rep"), "digest").select("doc_id", "rep")
    held = held.join(labels, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("label", "rep").alias("label"))
    held = held.groupBy("doc_id").agg(F.min("label").alias("__class")).withColumnRenamed("doc_id", "__id")
    ids = docs.select(F.col(key).cast("long").alias("doc_id"))
    out = ids.join(held, F.col("doc_id") == F.col("__id"), "left")
    return out.select("doc_id", F.coalesce("__class", "doc_id").alias("class_id"))


def _apart(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """bucket, m, label of the members of buckets that still hold more than one class."""
    if labels is None:
        return members.withColumn("label", F.col("m.rep"))
    own = members.join(labels, F.col("m.rep") == F.col("node"), "left").select("bucket", "m", F.coalesce("label", "m.rep").alias("label"))
    own = materialize(own, "labelled-members")
    mixed = own.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    return materialize(own.join(materialize(mixed, "mixed-buckets"), "bucket"), "members-apart")


def _candidates(own: DataFrame, leaders: int, similarity: float) -> DataFrame:
    """a, b, na, nb: members of a bucket in different classes, one of them a leader, of lengths that can align."""
    lead = own.select("bucket", F.col("m").alias("l"), F.col("label").alias("of"))
    # One of each part of the bucket: the heaviest.
    part = F.pmod(F.xxhash64("l.rep", F.lit(leaders)), F.lit(leaders))
    lead = lead.groupBy("bucket", part.alias("part")).agg(F.max(F.struct("l", "of")).alias("x")).select("bucket", "x.l", "x.of")
    pairs = own.join(materialize(lead, "leaders"), "bucket").where("label <> of")
    pairs = pairs.where(F.least("m.n", "l.n") >= F.floor(F.greatest("m.n", "l.n") * F.lit(similarity)))
    pairs = pairs.select(F.greatest("l", "m").alias("a"), F.least("l", "m").alias("b"))
    return pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).distinct()


def _sharing(own: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b, na, nb: all members in different classes that share one of their rarest shingles at places where texts that align can.

    The first shingle in common stands behind none in common, so at most ``n`` less what must be in common before it.
    """
    apart = own.select("m", "label").distinct().select(F.col("m.rep").alias("__id"), "m", "label")
    apart = materialize(apart, "texts-apart")
    step = F.lit(max(1, -(-apart.count() // COUNTED)))
    # Rows that share an id: the sketches of its first text of these words stand for it, any other text is another's.
    bodies = lambda some: texts.join(some, "__id").select("__id", "m.n", "__text")

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            found = [labelled(shingles(hashes.of(words(body)), SHINGLE)) for body in batch["__text"]]
            yield pd.DataFrame({"mark": np.concatenate([np.empty(0, dtype=np.uint64), *found]).astype(np.int64)})

    counted = bodies(apart.where(F.pmod(F.xxhash64("__id"), step) == 0)).mapInPandas(marks, "mark long")
    counted = counted.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "mark").limit(FREQUENT)
    top = counted.toPandas()
    frequent = top["mark"].to_numpy(dtype=np.int64).astype(np.uint64)
    order = np.argsort(frequent)
    frequent, counts = frequent[order], top["n"].to_numpy(dtype=np.int64)[order]

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for one, n, body in zip(batch["__id"], batch["n"], batch["__text"]):
                runs = shingles(hashes.of(words(body)), SHINGLE)
                rows.append((one, len(runs), rarest(runs, frequent, counts, similarity).astype(np.int64)))
            yield pd.DataFrame(rows, columns=["__id", "len", "marks"])

    held = bodies(apart).mapInPandas(rare, "__id long, len long, marks array<long>")
    held = held.select("__id", "len", F.posexplode("marks").alias("place", "mark"))
    held = materialize(held, "rare-shingles")
    often = held.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    held = held.join(often, "mark").join(apart, "__id").select("mark", "label", "place", "len", F.col("m.rep").alias("rep"), "m")
    held = materialize(held, "shared-shingles")
    l, r = held.alias("l"), held.alias("r")
    longer = F.greatest("l.len", "r.len")
    need = longer - F.floor(longer * F.lit(1 - similarity) + F.lit(1e-9))
    pairs = l.join(r, (F.col("l.mark") == F.col("r.mark")) & (F.col("l.m") > F.col("r.m")) & (F.col("l.label") != F.col("r.label"))
                   & (F.col("l.place") <= F.col("l.len") - need) & (F.col("r.place") <= F.col("r.len") - need))
    return pairs.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"), F.col("l.m.n").alias("na"), F.col("r.m.n").alias("nb")).distinct()


def _possible(pairs: DataFrame, counted: DataFrame, similarity: float) -> DataFrame:
    """a, b of the pairs whose cells allow an alignment: the distance is at least the longer length less what both have in common."""
    one = counted.select(F.col("rep").alias("__a"), F.col("cells").alias("__ca"))
    other = counted.select(F.col("rep").alias("__b"), F.col("cells").alias("__cb"))
    both = pairs.join(one, F.col("a") == F.col("__a")).join(other, F.col("b") == F.col("__b"))
    longer = F.greatest("na", "nb")
    band = F.floor(longer * F.lit(1 - similarity) + F.lit(1e-9))
    most = F.pandas_udf(in_common, "long")("__ca", "__cb")
    return both.where(longer - most <= band).select("a", "b")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label after more links: only the links between present classes are followed."""
    if labels is None:
        return components(links)
    for side in ("a", "b"):
        known = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        links = links.join(known, F.col(side) == F.col("__n"), "left").withColumn(side, F.coalesce("__l", side)).drop("__n", "__l")
    roots = components(links).select(F.col("node").alias("__n"), F.col("label").alias("__l"))
    moved = labels.join(roots, F.col("label") == F.col("__n"), "left").select("node", F.coalesce("__l", "label").alias("label"))
    alone = roots.join(labels, F.col("__n") == F.col("node"), "left_anti").select(F.col("__n").alias("node"), F.col("__l").alias("label"))
    return materialize(moved.unionByName(alone), "class-labels")


def _grouped(pairs: DataFrame) -> DataFrame:
    """Pairs with a salt that keeps every (a, salt) near ``GROUP`` pairs, written down."""
    pairs = materialize(pairs, "candidate-pairs")
    size = (pairs.groupBy("a").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > GROUP)
            .withColumnRenamed("a", "__a"))
    out = pairs.join(size, F.col("a") == F.col("__a"), "left")
    groups = F.ceil(F.coalesce("__n", F.lit(1)) / GROUP)
    return materialize(out.select("a", "b", F.pmod(F.xxhash64("b"), groups).alias("salt")), "candidate-groups")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less all but the smallest id of each class.

    Of rows that share an id one stays; rows with a null id all stay.  Columns are
    those of ``docs``.
    """
    found = materialize(classes(docs, text, key, similarity).where("doc_id IS NOT NULL"), "classes")
    name = free_name(docs, "__gone")
    gone = found.where("class_id <> doc_id").select(F.col("doc_id").alias(name))
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(name))
    twice = materialize(twice, "repeated-ids")
    cid = F.col(key).cast("long")
    out = docs.join(gone.unionByName(twice).distinct(), cid == F.col(name), "left_anti")
    if twice.limit(1).count():
        again = docs.join(twice.join(gone, name, "left_anti"), cid == F.col(name), "left_semi")
        out = out.unionByName(again.dropDuplicates([key]))
    return out
