import re

import pytest

from tests.conftest import SF
from tests.llm.helpers import documents, empty
from tidemill.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """sizes: source -> words."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over


def test_targets_and_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    sizes, most = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    want = slow_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= most[s]
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    for r in docs.limit(50).collect():
        assert next(x["size"] for x in rows if x["doc_id"] == r["doc_id"]) == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))


def test_edge_rows(spark):
    rows = mixing.mix(documents(spark)).collect()
    assert len(rows) == 10 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert next(r for r in rows if r["source"] is None)["target"] == 0
    assert mixing.mix(empty(spark)).count() == 0
    got = mixing.repeat_by_mix(documents(spark))
    assert got.columns == documents(spark).columns and got.count() == sum(r["copies"] for r in rows)
