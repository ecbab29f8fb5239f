import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, empty
from tidemill.llm import ngramjoin
from tidemill.llm.common import text_bytes
from tidemill.llm.components import components
from tidemill.llm.shingles import shingles


def slow_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def slow_components(rows):
    sets = [(d, slow_set(t)) for d, t in rows]
    root = {i: i for i in range(len(sets))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aAbÉé \n\t\x1c", max_size=30), max_size=6))
def test_shingles_are_sets_of_words(texts):
    import pyarrow as pa

    data, ends = text_bytes(pa.array(texts, pa.string()))
    got = shingles(data, ends)
    want = [slow_set(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def copies(seed, groups=12, long=120):
    """Groups of graded copies, a passage that many share, short texts and exact copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("abcdefgh") + str(rng.randrange(400))
    line, rows = [word() for _ in range(20)], []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 7, 30, long]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            own = [w if rng.random() > rng.choice([0, 0.01, 0.02, 0.04]) else word() for w in base]
            if rng.random() < 0.3:
                own += line
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    return rows


def test_components_match_brute_force(spark):
    for seed in range(3):
        rows = copies(seed)
        got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, got)) == slow_components(rows)


def test_a_word_at_either_end_of_a_short_text(spark):
    rng, rows = random.Random(5), []
    for i in range(300):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**9)}" for _ in range(9 if i < 200 else rng.randrange(9, 30))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[1:] if i % 2 else words[:-1]))]
    got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == slow_components(rows)


def test_what_may_be_unshared_in_the_first_pass():
    rng = random.Random(2)
    for _ in range(20_000):
        n = rng.randrange(1, 60)
        m = rng.randrange(-(-4 * n // 5), 5 * n // 4 + 1)
        common = -(-4 * (n + m) // 9)
        if common <= min(n, m) and common < max(n, m):
            # n-grams in hash order: in both, only in the first, only in the second
            order = ["both"] * common + ["a"] * (n - common) + ["b"] * (m - common)
            rng.shuffle(order)
            a = [i for i, x in enumerate(order) if x != "b"][: ngramjoin.sent(n)]
            b = [i for i, x in enumerate(order) if x != "a"][: ngramjoin.sent(m)]
            assert len(set(a) - set(b)) <= max(n // 5, ngramjoin.SHORT.get(n, 0)) < ngramjoin.sent(n)
    assert not any(ngramjoin.unshared(n) > n // 5 for n in range(40, 400))


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > (i % 8) / 200 else f"x{rng.random()}" for w in base)) for i in range(300)]
    got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == slow_components(rows)


def test_edge_rows(spark):
    got = ngramjoin.near_duplicates(documents(spark)).collect()
    by = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got)
    assert len(by) == 10
    assert ("6", 9, "1") in by and ("2", 0, "2") in by and ("3", 0, "3") in by and ("None", 6, "None") in by and ("8", 1, "8") in by
    assert [x for x in by if x[0] == "5"] == [("5", 7, "5")] * 2
    assert ngramjoin.near_duplicates(empty(spark)).count() == 0


def test_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 99)] + [(200, 300), (300, 200), (7, 7)], "a long, b long")
    got = {r["vertex"]: r["root"] for r in components(links).collect()}
    assert got == dict.fromkeys(range(100), 0) | {200: 200, 300: 200}
