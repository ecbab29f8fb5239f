import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF
from tests.llm.helpers import documents, empty
from tidemill.llm import toxicity
from tidemill.llm.hashed import ALPHA, Vocabulary, cut


def small_index(rng, terms, rows, most):
    vectors = [(np.sort(rng.choice(terms, rng.integers(0, most), replace=False)).astype(np.int32),) for _ in range(rows)]
    vectors = [(t, rng.integers(1, 4, len(t))) for (t,) in vectors]
    starts = np.cumsum([0, *(len(t) for t, _ in vectors)])
    index = toxicity.Index(rng.random(terms) * rng.choice([0.05, 1, 3], terms) + 0.01, 4.0, np.arange(rows), rng.integers(0, 2, rows), starts, np.concatenate([t for t, _ in vectors]), np.concatenate([c for _, c in vectors]))
    return index, vectors


@pytest.mark.parametrize("few", [20, 300])
@pytest.mark.parametrize(("terms", "rows", "most"), [(60, 700, 6), (400, 900, 120), (5000, 500, 300)])
def test_nearest_is_exact(monkeypatch, terms, rows, most, few):
    monkeypatch.setattr(toxicity, "FEW", few)
    index, vectors = small_index(np.random.default_rng(3), terms, rows, most)
    dense = np.zeros((rows, terms))
    for i, (t, c) in enumerate(vectors):
        dense[i, t] = index.weigh(t, c)
    common = index.common([(t, index.weigh(t, c)) for t, c in vectors[:200]])
    for (t, c), sums in zip(vectors[:200], common, strict=True):
        near, cosine = index.nearest(t, index.weigh(t, c), 15, sums)
        all_ = dense[:, t] @ index.weigh(t, c)
        order = [i for i in np.lexsort((np.arange(rows), -np.round(all_, 12))) if all_[i] > 1e-12][:15]
        assert near.tolist() == order and np.allclose(cosine, all_[order])


def slow_terms(text):
    words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())]
    return Counter(words) + Counter(w[:5] + b"*" for w in words if len(w) > 5)


def slow_scores(texts, labels, k=200):
    """Every text's score by dense loops over all examples; labels: text number -> label."""
    bags = [slow_terms(t) for t in texts]
    df = Counter(t for bag in bags for t in bag)
    known = {t for i in labels for t in bags[i]}
    idf = lambda t: np.log((len(texts) + 1) / ((df[t] if t in known else 0) + 0.5))

    def vector(bag):
        v = {t: (1 + np.log(n)) * idf(t) for t, n in bag.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    vectors = [vector(bag) for bag in bags]
    ones, zeros = [i for i, y in labels.items() if y], [i for i, y in labels.items() if not y]
    n1, n0, told = len(ones), len(zeros), {}
    for t in known:
        a, b = (sum(t in bags[i] for i in some) for some in (ones, zeros))
        chi = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n1 + n0 - a - b + 1e-9) * n1 * n0)
        x = min(1, chi / 20) * min(1, abs(np.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1)))) / np.log(3))
        told[t] = x if x >= 0.1 else 0

    def features(i):
        cosines = sorted(((-round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), 12), j) for j in labels if texts[j] != texts[i]))[:k]
        cosines = [(-c, j) for c, j in cosines if c < 0]
        votes = [(sum(x * vectors[j].get(t, 0) * told.get(t, 0) for t, x in vectors[i].items()), labels[j]) for _, j in cosines]
        share = (sum(v for v, y in votes if y) + 0.006) / (sum(v for v, _ in votes) + 0.012)
        others = [y for j, y in labels.items() if texts[j] != texts[i]]
        return [1, np.log(share / (1 - share)) - np.log((sum(others) + 0.5) / (len(others) - sum(others) + 0.5)), cosines[0][0] if cosines else 0]

    has = [any(t in known for t in bag) for bag in bags]
    rows = [i for i in labels if has[i]]
    x, y, beta = np.array([features(i) for i in rows]), np.array([labels[i] for i in rows]), np.array([0.0, 1, 0])
    for _ in range(20_000):  # plain descent on the same penalised likelihood
        p = 1 / (1 + np.exp(-x @ beta))
        beta += 0.5 / len(rows) * (x.T @ (y - p) - 0.5 * (beta - [0, 1, 0]))
    blank = [labels[i] for i in labels if not has[i]]
    rate = (sum(blank) + 0.1) / (len(blank) + 1)
    return [1 / (1 + np.exp(-np.dot(features(i), beta))) if has[i] else rate for i in range(len(texts))]


def test_whole_score_against_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcÉ"), rng.integers(1, 8)))
    texts = [" ".join(word() for _ in range(rng.integers(0, 30))) + (" vile zorgle" if i % 4 == 1 and rng.random() < 0.8 else "") for i in range(290)]
    texts += texts[:9] + [""]
    labels = {i: int(i % 4 == 1) for i in range(300) if i % 3}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), fold=None)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    want = slow_scores(texts, labels)
    assert np.allclose([got[i] for i in range(300)], want, atol=2e-3)


def test_bags():
    texts = ["One two two", None, "", "three3three ÉÉ", "x" * 9]
    known = Vocabulary(np.concatenate([cut(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), ALPHA)[0] for w in ("two", "three")]))
    got = list(toxicity.bags(pa.array(texts), known))
    assert [x[0].decode() for x in got] == [t or "" for t in texts] and [x[2].tolist() for x in got] == [[2], [], [], [2], []]
    assert np.allclose([x[3] for x in got], [1, 0, 0, 1, 2])


def test_every_shared_word_counts(spark):
    rng = np.random.default_rng(4)
    word = lambda: "abcdefgh"[rng.integers(8)] + str(rng.integers(0, 10)).translate(str.maketrans("0123456789", "qrstuvwxyz"))
    rows = [(i, " ".join(word() for _ in range(12)) + (" zorgle" if i in (1, 3, 5, 7) else ""), i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, "zorgle unseen"), (1001, "aq unseen"), (1002, "unseen")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels, fold=None)).collect()}
    assert set(got[1000]["evidence"]) < {1, 3, 5, 7} and len(got[1000]["evidence"]) == 3 and got[1000]["score"] > 0.5
    assert len(got[1001]["evidence"]) == 3 and all("aq" in rows[i][1].split() for i in got[1001]["evidence"])
    assert got[1002]["evidence"] == [] and all(len(got[i]["evidence"]) == 3 and i not in got[i]["evidence"] for i, _, _ in rows)


def test_held_out_documents(spark):
    sf = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.op3_toxicity(spark, sf).cache()
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    hit = Counter((r["toxic"], r["predicted"]) for r in rows)
    print("held out (toxic, predicted):", dict(hit))
    assert hit[1, 1] >= 0.7 * (hit[1, 1] + hit[1, 0]) and hit[0, 1] <= 0.03 * (hit[0, 0] + hit[0, 1])
    assert found.count() == docs.count()
    assert found.join(docs, "doc_id").filter("trim(text) <> '' and size(evidence) > 0").count() > 0.95 * docs.filter("trim(text) <> ''").count()


def test_edge_rows(spark, monkeypatch):
    labels = spark.createDataFrame([(1, 0), (2, 0), (5, 1), (6, None), (77, 1)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark), labels, fold=None)
    got = toxicity.score(documents(spark), model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.fit(empty(spark), labels, fold=None) is None
    assert toxicity.fit(documents(spark), labels.filter("toxic = 0")) is None
    assert {r["predicted"] for r in toxicity.score(documents(spark), None).collect()} == {0}
    one = toxicity.fit(documents(spark).filter("doc_id in (2, 3)"), spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, toxic int"), fold=None)
    assert {r["score"] for r in toxicity.score(documents(spark), one).collect()} == {1.1 / 3}
    monkeypatch.setattr(toxicity, "EXAMPLE_BYTES", 62)  # document 5 is longer
    assert toxicity.fit(documents(spark), labels, fold=None) is None
