"""Every order played through document by document."""

import re
from itertools import permutations

import pytest

from tests.llm.helpers import documents, empty
from tidemill.llm import filteraudit

LABELS = [(1, 1, 0), (2, 0, 1), (5, 1, 1), (6, None, 1), (6, 1, None), (8, 0, 0), (77, 1, 1)]
ROWS = [
    *[(i, " ".join(f"w{j}" for j in range(120)) + extra, lang, "s", 0) for i, extra, lang in ((20, "", "en"), (21, "", "en"), (22, " #", "en"), (23, " ABCDEFGH" * 30, "de"), (24, "", ""), (25, "", None))],
    (30, None, None, None, None),
    (31, "", "en", None, None),
    (None, "", "en", None, None),
    (20, " ".join(f"w{j}" for j in range(120)), "en", "t", 0),
    (40, "x " * 100, "fr", "s", 0),
]


def slow_audit(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = {}
    kinds = {}
    for i, text, lang, *_ in rows:
        s = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", s)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", s)) > 10 * len(s), "D": bool(re.search(r"[#$%&*|]", s)), "E": i is not None and i > first[s]}
        good, toxic = (any(x[0] == i and x[k] == 1 for x in labels) for k in (1, 2))
        kinds.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, good, toxic))
    for part, docs in kinds.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                failing = [d for d in docs if f in d[0]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for key, x in out.items():
            if key[0] == part:
                x[-1] = shapley[x[-1]]
    return out


@pytest.mark.parametrize("rows", [ROWS, "shared"])
def test_against_all_orders(spark, rows):
    from tests.llm.helpers import ROWS as SHARED

    rows = SHARED if rows == "shared" else rows
    docs = documents(spark, rows).withColumnRenamed("size", "n")
    got = filteraudit.audit(filteraudit.features(docs), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == slow_audit(rows, LABELS)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_paths_count_orders():
    reach, leave = filteraudit.paths(4)
    assert reach[0] == leave[15] == 1 and reach[15] == leave[0] == 24
    for state in range(16):
        k = state.bit_count()
        assert reach[state] * leave[state] == sum({*p[:k]} == {i for i in range(4) if state >> i & 1} for p in permutations(range(4)))


def test_other_filters_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    got = filteraudit.audit(filteraudit.features(docs), labels, {"x": "n_chars > 20", "y": "cast(null as boolean)"}).filter("part = 'en' and filter_order = 'xy'").orderBy("step").collect()
    assert [(r["kept"], r["removed"], r["shapley"]) for r in got] == [(1, 3, 6), (1, 0, 0)]
    assert filteraudit.audit(filteraudit.features(empty(spark)), labels).count() == 0
    with pytest.raises(ValueError, match="filters"):
        filteraudit.audit(filteraudit.features(docs), labels, dict.fromkeys("abcdefgh", "marked"))
