import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import empty_documents, nasty_documents
from watchgrid.llm import queries, spelling

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs):
    """All words, every pair found by leaving characters out, the rules of the contract."""
    n = Counter()
    for d, text in docs:
        for run in _RUN.findall(text or ""):
            run = run.translate(_LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    near, holes = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            left = w[:i] + w[i + 1:]
            holes[left, i].append(w)
            if left in n:
                near[w].add(left)
                near[left].add(w)
    for some in holes.values():
        for w in some:
            near[w].update(x for x in some if x != w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_equals_all_pairs(spark, sf):
    docs = queries.table(spark, sf, "documents")
    want = plain(rows(docs))
    assert got(spelling.variants(docs)) == want
    assert sum(w[1] is not None for w in want) >= 10 and max(w[4] for w in want) > 1


def made(seed, size):
    """Words of few letters, so that nearly all have near words and many grams are frequent."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("aabcé", k=rng.randint(7, 10))) for _ in range(size)]
    return [(i, " ".join(w for w in rng.choices(words, weights=[1.15 ** (k % 90) for k in range(size)], k=40))) for i in range(300)]


@pytest.mark.parametrize("meet, most", [(20_000, 4), (15, 4), (20_000, 1), (15, 2)])
def test_full_keys_and_low_bounds(spark, meet, most):
    docs = [*made(meet + most, 700), (400, "zzzzzza " * 2 + "zzzzzzb " * 30 + "zzzzzbb " * 400)]
    want = plain(docs)
    assert got(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), most=most, meet=meet, often=0.02)) == want
    assert any(w[2] not in (w[0], w[1]) for w in want)  # a form of a form


def test_an_edit_leaves_as_many_grams_as_stated():
    rng = random.Random(3)
    for _ in range(4000):
        long = rng.choice([3, 4, 5])
        letters = "ab" if rng.random() < 0.5 else "abcd"
        longer = {"".join(rng.choices(letters, k=rng.randint(3, long))) for _ in range(rng.randint(0, 25))}
        grams = spelling.Grams(longer, 2, long)
        word = "".join(rng.choices(letters, k=rng.randint(4, 14)))
        at, kind = rng.randrange(len(word)), rng.choice("ird")
        new = rng.choice(letters)
        other = word[:at] + (new + word[at:] if kind == "i" else new + word[at + 1:] if kind == "r" else word[at + 1:])
        if other == word:
            continue
        bounds, meets = [], []
        for w in (word, other):
            starts, ends, reach = grams.cut(w)
            bounds.append(grams.bound(w, starts, ends, reach))
            meets.append(set(spelling.keys(w, starts, ends, bounds[-1])))
        if max(bounds) > 0:
            assert meets[0] & meets[1], (word, other, longer)


def test_near_is_one_edit():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(2))
        one = {a[:i] + a[i + 1:] for i in range(len(a))} | {a[:i] + c + a[i + k:] for i in range(len(a) + 1) for c in "ab" for k in (0, 1)}
        assert spelling.near(a, b) == (b in one and b != a)


def test_awkward_tables(spark):
    docs = nasty_documents(spark)
    assert got(spelling.variants(docs)) == plain(rows(docs))
    assert got(spelling.variants(empty_documents(spark))) == []
    long = spark.createDataFrame([(1, "Übergang übergang ÜBERGANG " * 20_000 + "übergäng übergäng"), (None, "übergang×x")], "doc_id long, text string")
    assert got(spelling.variants(long)) == plain(rows(long))
