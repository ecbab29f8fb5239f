from collections import Counter

from tests.llm.helpers import documents, empty
from tidemill.llm import sharding


def slow_fill(names, slots):
    import hashlib

    number = lambda name, salt: int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:13], 16)
    orders = [[(number(n, "offset") % slots + j * (number(n, "skip") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            if len(owner) < slots:
                owner[next(s for s in order if s not in owner)] = i
    return [owner[i] for i in range(slots)]


def test_fill_takes_turns():
    for n in (1, 3, 7):
        assert sharding.fill(sharding.shard_names(n), 101) == slow_fill(sharding.shard_names(n), 101)


def test_even_and_stable():
    names = sharding.shard_names()
    owner = sharding.fill(names)
    count = Counter(owner)
    assert max(count.values()) - min(count.values()) <= 1
    fewer = sharding.fill(names[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != len(names) - 1)
    assert moved < 0.05 * len(owner)


def test_rows(spark):
    got = sharding.shard(documents(spark).selectExpr("*", "1 as shard"), "doc_id", sharding.shard_names(5)).collect()
    assert len(got) == 10 and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert sharding.shard(empty(spark), "doc_id", ["one"]).count() == 0
