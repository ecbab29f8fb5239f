import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ROWS, documents, empty
from tidemill.llm import fingerprints as fp


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40), st.integers(0, 40), st.integers(0, 40))
def test_extension_and_equality(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    x, y = fp.Prefixes(fp.code_points(a)), fp.Prefixes(fp.code_points(b))
    assert x.extension(i, y, j) == want
    n = min(len(a) - i, len(b) - j, 5)
    assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])


def test_likeness_follows_common_spans():
    import random

    random.seed(1)
    text = "".join(random.choice("abcdefgh ") for _ in range(4000))
    near = text[:1000] + "X" + text[1001:]
    far = "".join(random.choice("abcdefgh ") for _ in range(4000))
    least = lambda t: fp.Prefixes(fp.code_points(t)).least()
    assert fp.likeness(least(text), least(near)) > 0.85
    assert fp.likeness(least(text), least(far)) < 0.05
    assert fp.likeness(least(""), least("")) == 1 and fp.likeness(least(""), least("a")) == 0


def test_all_documents_in_order(spark):
    for buckets in (1, 2, 7):
        got = fp.fingerprints(documents(spark), buckets).collect()
        order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
        texts = [r[1] or "" for r in order]
        want = sorted((str(r[0]), len(t), hashlib.sha256(fp.edited(t, texts[(i + 1) % len(texts)]).encode()).hexdigest()) for i, (r, t) in enumerate(zip(order, texts, strict=True)))
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[1] == by[6] and by[2] == "" == by[3]
    assert fp.fingerprints(empty(spark)).count() == 0


def test_many_buckets(spark):
    rows = [(i * 37 % 9001, f"text {i % 50}") for i in range(6000)]
    texts = dict(rows)
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r["edited_sha256"] for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 1200).collect()}
    assert got == {k: hashlib.sha256(fp.edited(texts[k], texts[order[(i + 1) % len(order)]]).encode()).hexdigest() for i, k in enumerate(order)}


def slow_fingerprint(text):
    """The least mixed hashes of all spans, each hashed on its own in whole numbers."""
    p, out = (1 << 31) - 1, set()
    width = min(fp.SPAN, len(text))
    for i in range(len(text) - width + 1 if text else 0):
        parts = [sum((ord(c) + 1) * pow(base, j, p) for j, c in enumerate(text[i : i + width])) % p for base in fp.BASES]
        x = (parts[0] << 31) | parts[1]
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
        out.add(((x ^ (x >> 32)) >> 13) % 2**32)
    return sorted(out)[: fp.KEPT]


def slow_likeness(a, b):
    both = sorted({*a, *b})[: fp.KEPT]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def test_columns_against_brute_force(spark):
    import random

    rng = random.Random(6)
    base = "".join(rng.choice("abcde ") for _ in range(400))
    rows = [(i, (base[: rng.randrange(400)] + "".join(rng.choice("abü") for _ in range(rng.randrange(60))))[: rng.choice([0, 1, 20, 400])]) for i in range(40)]
    texts = dict(rows)
    for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own, following = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % 40]
        changed = fp.edited(own, following)
        a, b, c = map(slow_fingerprint, (own, changed, following))
        form = lambda x: "".join(f"{v:08x}" for v in x)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (form(a), form(b))
        assert abs(r["near_edited"] - slow_likeness(a, b)) < 1e-9 and abs(r["near_next"] - slow_likeness(a, c)) < 1e-9
