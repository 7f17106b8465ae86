"""Language of each word in code-switched text by a linear-chain random field.

Words are observed through hashed prefixes, suffixes, character n-grams and their
own form; transitions between languages are learned.  Forward and backward sums
give each word's probabilities, their mean is the document's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid.llm.text import free_name, mix

#: The classifier is fitted on so many hashed passages of labelled rows per language, each of so many characters.
FIT_PASSAGES = 400
FIT_CHARS = 1200
#: More labels than this are an error of the input.
MOST_LABELS = 256
SLOTS = 1 << 16
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_CELLS = 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letter_words(text: str | None) -> list[str]:
    """Lower-case runs of letters; [] if there are none.  Digits of any script, fractions and the like are no letters."""
    found = _LETTERS.findall(text.lower()) if text else []
    if "".join(found).isalpha():
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def features(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of every feature of some words: prefixes to 3, suffixes to 4, n-grams of 2 and 3, the word itself."""
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = np.repeat(np.arange(len(found)), sizes)
    place = np.arange(len(codes)) - starts[word]
    left = sizes[word] - place  # characters from here to the end
    padded = np.concatenate([codes, np.zeros(4, dtype=np.uint64)])
    owner, hashes = [], []

    def add(kind: int, of: np.ndarray, at: np.ndarray, size: int) -> None:
        h = np.full(len(at), kind, dtype=np.uint64)
        for i in range(size):
            h = mix(h * _STEP + padded[at + i])
        owner.append(of)
        hashes.append(h)

    every = np.arange(len(found))
    for size in (1, 2, 3, 4):
        some = every[sizes >= size]
        if size < 4:
            add(10 + size, some, starts[some], size)
        add(20 + size, some, ends[some] - size, size)
    for size in (2, 3):
        at = np.flatnonzero(left >= size)
        add(30 + size, word[at], at, size)
    owner.append(every)
    hashes.append(mix(np.add.reduceat(mix(codes * _STEP + place.astype(np.uint64)), starts) if len(found) else codes))
    return np.concatenate(owner), (np.concatenate(hashes) % np.uint64(SLOTS)).astype(np.int64)


def scores_of(owner: np.ndarray, slot: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Score of each of ``n`` words per label: its features' weights, scaled by their number."""
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)))
    return np.stack([np.bincount(owner, weights[slot, y], n) * scale for y in range(weights.shape[1])], axis=1)


class Emissions(dict):
    """Row of each word in a table of its scores per label, remembered between texts up to a bound."""

    def __init__(self, weights: np.ndarray, most: int = 200_000):
        super().__init__()
        self.weights, self.most = weights, most
        self.rows = np.empty((0, weights.shape[1]), dtype=np.float32)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def start(self) -> None:
        """Forget what is remembered if it is too much; row numbers given before end here."""
        if len(self) > self.most:
            self.clear()
            self.rows = self.rows[:0]

    def places(self, found: list[str]) -> np.ndarray:
        """Row number of each word."""
        return np.fromiter(map(self.__getitem__, found), dtype=np.int32, count=len(found))

    def table(self) -> np.ndarray:
        """Scores by row number, the words met since the last call included."""
        for lo in range(0, len(self.new), 20_000):
            part = self.new[lo:lo + 20_000]
            more = scores_of(*features(part), len(part), self.weights).astype(np.float32)
            self.rows = np.concatenate([self.rows, more])
        self.new = []
        return self.rows


def marginals(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray, start: np.ndarray,
              pairs: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of every word by forward-backward; scores: texts x words x labels.

    ``pairs``, if given, gets the expected transitions added.
    """
    b, n, _ = scores.shape
    emit = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(transitions)
    ahead = np.empty_like(emit)
    at = emit[:, 0] * np.exp(start)
    ahead[:, 0] = at / at.sum(1, keepdims=True)
    for t in range(1, n):
        at = (ahead[:, t - 1] @ step) * emit[:, t]
        at /= at.sum(1, keepdims=True)
        ahead[:, t] = np.where(mask[:, t, None], at, ahead[:, t - 1])
    behind = np.ones((b, scores.shape[2]), dtype=emit.dtype)
    for t in range(n - 1, -1, -1):
        if t < n - 1:
            live = mask[:, t + 1, None]
            back = emit[:, t + 1] * behind
            if pairs is not None:
                both = ahead[:, t, :, None] * step[None] * back[:, None, :]
                both /= both.sum((1, 2), keepdims=True)
                pairs += (both * live[:, :, None]).sum(0)
            back = back @ step.T
            back /= back.sum(1, keepdims=True)
            behind = np.where(live, back, behind)
        ahead[:, t] *= behind  # from here on the probabilities
        ahead[:, t] /= ahead[:, t].sum(1, keepdims=True)
    return ahead


class Model:
    """Labels, weights of feature slots, transitions and first-word scores."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.transitions, self.start = labels, weights, transitions, start

    def predict(self, texts: list[str | None], emissions: Emissions) -> list[tuple[str, float, float]]:
        """(label, its mean probability, mean of each word's best probability) per text; texts of like length go together."""
        out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        found = []
        emissions.start()
        for i, text in enumerate(texts):
            places = emissions.places(letter_words(text))
            if len(places):
                found.append((i, places))
        table = emissions.table()
        found.sort(key=lambda x: len(x[1]))
        lo = 0
        while lo < len(found):
            hi = lo + 1
            while hi < len(found) and (hi - lo + 1) * len(found[hi][1]) * len(self.labels) <= 4 * _CELLS and hi - lo < 1024:
                hi += 1
            part = found[lo:hi]
            longest = len(part[-1][1])
            scores = np.zeros((len(part), longest, len(self.labels)), dtype=np.float32)
            mask = np.zeros((len(part), longest), dtype=bool)
            for j, (_, s) in enumerate(part):
                scores[j, :len(s)] = table[s]
                mask[j, :len(s)] = True
            each = marginals(scores, mask, self.transitions, self.start) * mask[:, :, None]
            share = each.sum(1, dtype=np.float64) / mask.sum(1)[:, None]
            sure = each.max(2).sum(1, dtype=np.float64) / mask.sum(1)
            for (i, _), row, certain in zip(part, share, sure):
                best = int(row.argmax())
                out[i] = self.labels[best], float(min(1.0, row[best])), float(min(1.0, certain))
            lo = hi
        return out


def learn(passages: list[tuple[str, str]], epochs: int = 4, rate: float = 0.15, decay: float = 1e-4, seed: int = 7) -> Model:
    """A model of labelled passages, joined into code-switched sequences of one to three pieces."""
    labels = sorted({lang for _, lang in passages})
    code = {lang: i for i, lang in enumerate(labels)}
    rng = np.random.default_rng(seed)
    pieces = []
    for text, lang in passages:
        found = letter_words(text)
        pieces += [(found[i:i + 24], code[lang]) for i in range(0, len(found), 24)]
    weights = np.zeros((SLOTS, max(1, len(labels))))
    squares = np.full(weights.shape, 1e-3)
    transitions, start = np.zeros((len(labels), len(labels))), np.zeros(len(labels))
    moved = np.full(transitions.shape, 1e-3)
    for _ in range(epochs if len(labels) > 1 else 0):
        order = rng.permutation(len(pieces))
        sequences, at = [], 0
        while at < len(order):
            size = int(rng.integers(1, 4))
            sequences.append([pieces[i] for i in order[at:at + size]])
            at += size
        for lo in range(0, len(sequences), 64):
            part = sequences[lo:lo + 64]
            lengths = [sum(len(found) for found, _ in sequence) for sequence in part]
            gold = np.array([y for sequence in part for found, y in sequence for _ in found])
            n = len(gold)
            owner, slot = features([w for sequence in part for found, _ in sequence for w in found])
            scale = 1 / np.sqrt(np.bincount(owner, minlength=n))
            scores = scores_of(owner, slot, n, weights)
            grid = np.zeros((len(part), max(lengths), len(labels)))
            mask = np.arange(max(lengths))[None, :] < np.array(lengths)[:, None]
            grid[mask] = scores
            pairs = np.zeros_like(transitions)
            given = marginals(grid, mask, transitions, start, pairs)[mask]
            given[np.arange(n), gold] -= 1
            first = np.cumsum([0, *lengths[:-1]])
            after = np.setdiff1d(np.arange(n), first)
            np.subtract.at(pairs, (gold[after - 1], gold[after]), 1)
            push = (given * scale[:, None])[owner]
            gradient = np.stack([np.bincount(slot, push[:, y], SLOTS) for y in range(len(labels))], axis=1)
            gradient = gradient / len(part) + decay * weights
            squares += gradient * gradient
            weights -= rate * gradient / np.sqrt(squares)
            turn = pairs / len(part) + decay * transitions
            moved += turn * turn
            transitions -= rate * turn / np.sqrt(moved)
            start -= rate * (given[first].sum(0) / len(part) + decay * start)
    return Model(labels, weights.astype(np.float32), transitions.astype(np.float32), start.astype(np.float32))


def held_out(key: Column) -> Column:
    """Is the row kept from learning: crc32 of the id as text leaves 0 on division by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", passages: int = FIT_PASSAGES) -> Model:
    """Learn from rows with a language, text and id that are not held out.

    The sample is bounded: about ``passages`` rows per language, chosen by a hash of id and text, of
    each one passage of ``FIT_CHARS`` characters from a hashed place of the whole text.  Every
    language has a passage, however its rows share ids and texts.  More than ``MOST_LABELS``
    languages are an error.
    """
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    rows = rows.where(F.col("__id").isNotNull() & F.col("__text").rlike(r"\p{L}") & F.col("__lang").isNotNull()
                      & ~held_out(F.col("__id")))
    sizes = {r[0]: r[1] for r in rows.groupBy("__lang").count().limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages")
    if not sizes:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    span = 1 << 40
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(span, span * passages // n))])
    own = (F.col("__id").cast("string"), F.col("__text"))
    place = F.pmod(F.xxhash64(*own, F.lit(11)), F.greatest(F.lit(1), F.length("__text") - FIT_CHARS + 1))
    order = F.pmod(F.xxhash64(*own, F.lit(5)), F.lit(span))
    passage = F.substring("__text", (place + 1).cast("int"), F.lit(FIT_CHARS))
    rows = rows.select(order.alias("__order"), passage.alias("__text"), "__lang")
    # Repeated rows share their hash, so the sample is cut at twice its expected size, by hash.
    chosen = (rows.where(F.col("__order") < F.element_at(share, F.col("__lang")))
              .orderBy("__order", "__text", "__lang").limit(2 * passages * len(sizes)))
    first = rows.groupBy("__lang").agg(F.min(F.struct("__order", "__text")).alias("f")).select("f.*", "__lang")
    chosen = chosen.unionByName(first).distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        model = learn(list(zip(rows["__text"], rows["__lang"])))
        yield pd.DataFrame({"label": model.labels, "weights": list(model.weights.T), "next": list(model.transitions),
                            "start": model.start})

    # The bounded sample is learned in one task; the model is one row per language.
    schema = "label string, weights array<float>, next array<float>, start float"
    rows = sorted(chosen.repartition(1).sortWithinPartitions("__order", "__text", "__lang").mapInPandas(run, schema).collect(), key=lambda r: r["label"])
    return Model([r["label"] for r in rows], np.array([r["weights"] for r in rows], dtype=np.float32).T.copy(),
                 np.array([r["next"] for r in rows], dtype=np.float32), np.array([r["start"] for r in rows], dtype=np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct column (lang_pred, score, sure) of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transitions, model.start))

    @F.pandas_udf("lang_pred string, score double, sure double")
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        emissions = Emissions(own.weights) if own.labels else None
        for batch in texts:
            rows = []
            for lo in range(0, len(batch), 1000):
                part = list(batch.iloc[lo:lo + 1000])
                rows += own.predict(part, emissions) if own.labels else [(UNKNOWN, 0.0, 0.0)] * len(part)
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "sure"])

    return label(F.col(text))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    ``und`` with score 0 where the text is null or holds no letter, and everywhere if no
    labelled row is there to learn from.  Null ids are never learned from and count as not
    held out; repeated rows are predicted alike; other columns are ignored.
    """
    model = fit(docs, text, lang, key)
    out = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), predict(docs, model, text).alias("__p"))
    return out.select("doc_id", "held_out", "__p.lang_pred", "__p.score")


def keep_identified(docs: DataFrame, least: float = 0.5, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose words' languages are found, with a mean probability of ``least`` or more.

    It is the mean of each word's best language, so a text in several languages stays
    though none of them has half of its words.
    """
    model = fit(docs, text, lang, key)
    name = free_name(docs, "__p")
    out = docs.withColumn(name, predict(docs, model, text))
    return out.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.sure") >= least)).drop(name)
