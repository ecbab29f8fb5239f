"""Windows compared one by one in plain Python."""

import hashlib
import random
import re

import pytest

from tests.llm.helpers import documents, empty
from tidemill.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_words(text):
    return WORD.findall((text or "").translate(LOWER))


def slow_hits(text, items):
    words, hit, ids = slow_words(text), set(), set()
    for i, item in items:
        own = slow_words(item)
        width = min(10, len(own))
        for p in range(len(words) - width + 1 if width else 0):
            if any(words[p : p + width] == own[q : q + width] for q in range(len(own) - width + 1)):
                hit |= set(range(p, p + width))
                ids.add(i)
    return len(words), len(hit), sorted(str(i) for i in ids if i is not None)


def check(spark, docs, items):
    got = winnowing.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(i, *slow_hits(t, items)) for i, t in docs]
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got))) == sorted(map(str, want))
    assert all(r["n_items"] == len(r["item_ids"]) and r["contaminated"] == (r["n_hit"] > 0) for r in got)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rng = random.Random(seed)
    few = [rng.choice(["ab", "Éa", "x1", "9"]) for _ in range(4)]  # few words, so that most grams repeat
    some = lambda n: [rng.choice(few) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 15, 25])))) for i in range(8)] + [(3, " ".join(f"Q{j}" for j in range(30))), (99, "one, two. three")]
    own = " ".join(f"q{j}" for j in range(30)).split()
    docs = [(i, " - ".join(some(rng.randrange(0, 60)))) for i in range(25)]
    docs += [(100 + n, " ".join(["zz"] * 3 + own[4 : 4 + n] + ["yy"])) for n in (8, 9, 10, 11, 26)]
    assert any(r["n_hit"] == 11 for r in check(spark, docs, items) if r["doc_id"] == 111)
    only = [x for x in items if len(slow_words(x[1])) >= 10]
    check(spark, docs, only)


def test_edge_rows(spark):
    items = [(1, "The quick brown fox jumps over the lazy dog near the river"), (1, "wort " * 12), (None, "no id at all here in this row of words"), (5, None), (6, "..."), (7, "")]
    from tests.llm.helpers import ROWS

    got = winnowing.contamination(documents(spark), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got))) == sorted(str((r[0], *slow_hits(r[1][:4000] if r[0] == 8 else r[1], items))) if r[0] != 8 else str((8, 30_000, 30_000, ["1"])) for r in ROWS)
    items = spark.createDataFrame(items, "item_id long, text string")
    assert winnowing.contamination(empty(spark), items).count() == 0
    assert winnowing.contamination(documents(spark), items.limit(0)).filter("contaminated").count() == 0


def test_digest_of_items(spark, tmp_path):
    spark.createDataFrame([(i, "a b c d e f g h i j k") for i in (2, 10, 1)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "x a b c d e f g h i j y"), (2, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in winnowing.op13_winnowing(spark, str(tmp_path)).collect()}
    assert got[1]["items_sha256"] == hashlib.sha256(b"1,10,2").hexdigest() and got[1]["n_hit"] == 10
    assert got[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not got[2]["contaminated"]
