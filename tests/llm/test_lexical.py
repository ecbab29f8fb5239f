"""The search against plain loops over all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import ROWS, documents, empty
from tidemill.llm import hashed, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_terms(text):
    return [x.translate(LOWER) for x in TERM.findall(text or "")]


def slow_ranked(docs, items, top):
    bags = [(i, Counter(slow_terms(t))) for i, t in docs]
    bags = [(i, bag) for i, bag in bags if bag]
    count, length = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 50 + (50 * sum(bag.values()) * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(slow_terms(text)) if bag[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top])]
    return out


def check(spark, docs, items, top, **more):
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in lexical.ranked(made, spark.createDataFrame(items, "item_id long, text string"), top, **more).collect()]
    assert sorted(map(str, got)) == sorted(map(str, slow_ranked(docs, items, top)))


@pytest.mark.parametrize(("seed", "top", "block"), [(1, 5, 1 << 21), (2, 50, 60)])
def test_against_all_pairs(spark, seed, top, block):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abÉ9", k=rng.choice([1, 1, 2, 3])))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)] + [(3, docs[3][1]), (None, docs[7][1]), (2000, None)]
    items = [(i, ", ".join(word() for _ in range(rng.randrange(0, 25)))) for i in range(30)] + [(77, docs[7][1]), (78, "nowhere"), (None, "a b"), (79, None)]
    check(spark, docs, items, top, block_terms=block)


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 9000, 300)
    sizes = rng.integers(1, 30, 70)
    held = np.concatenate([np.sort(rng.choice(300, s, replace=False)) for s in sizes])
    forest = lexical.Forest(np.concatenate([[0], np.cumsum(sizes)]), held, weights)
    found = lexical.Search(forest, np.zeros(70), 10)
    dense = np.zeros((3000, 300), np.int64)
    for a in range(0, 3000, 500):
        own = (rng.random((500, 300)) < 0.05) * rng.integers(1, 500_000, (500, 300))
        dense[a : a + 500] = own
        of, at = np.nonzero(own)
        found.search(np.arange(a, a + 500), np.zeros(500, bool), of, at, own[of, at])
    all_ = np.zeros((3000, 70), np.int64)
    for i in range(70):
        at = held[forest.starts[i] : forest.starts[i + 1]]
        all_[:, i] = dense[:, at] @ weights[at]
        order = [d for d in np.lexsort((np.arange(3000), -all_[:, i]))[:10] if all_[d, i]]
        assert found.best[i][1].tolist() == order and found.best[i][0].tolist() == all_[order, i].tolist()
    assert found.scored < 0.7 * all_.size  # node pairs were dropped


def test_long_texts_and_long_sums(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + "x" * 5000
    data, ends = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    whole = hashed.cut(data, ends)[0]
    monkeypatch.setattr(hashed, "PIECE", 700)
    assert hashed.cut(data, ends)[0].tolist() == whole.tolist() and len(whole) == 3000
    n, tf, of = np.array([10, 4 * 10**9]), np.array([3, 7]), np.array([0, 1])
    assert lexical.saturated(tf, n, of, 10**10, 10**13).tolist() == [(10**9 * f) // (1000 * f + 20 * (50 + 50 * k * 10**10 // 10**13)) for f, k in ((3, 10), (7, 4 * 10**9))]


def test_edge_rows(spark):
    docs = [(r[0], r[1]) for r in ROWS]
    items = [(1, "the quick brown fox"), (2, "wort Fuchs"), (3, ""), (4, None)]
    check(spark, docs, items, 3)
    made = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.ranked(empty(spark), made).count() == 0 and lexical.ranked(documents(spark), made.limit(0)).count() == 0
