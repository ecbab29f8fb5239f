import math

from tests.conftest import SF
from tests.llm.helpers import documents, empty
from tidemill.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.op2_langid(spark, SF).join(docs, "doc_id").filter("held_out and n_chars > 20").collect()
    assert len(found) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_edge_rows(spark):
    network = langid.fit(documents(spark), fold=None)
    got = {(r["doc_id"]): r for r in langid.identify(documents(spark), network).collect()}
    assert network.languages == ["de", "en", "fr"]
    assert [got[k]["lang_pred"] for k in (2, 3, 4)] == ["und"] * 3 and abs(got[1]["score"] - got[6]["score"]) < 1e-5
    assert langid.identify(empty(spark), network).count() == 0
    assert langid.fit(empty(spark)) is None
    assert {r["lang_pred"] for r in langid.identify(documents(spark), None).collect()} == {"und"}
    twice = langid.identify(documents(spark).filter("doc_id in (1, 6)").union(documents(spark).filter("doc_id = 1")), network).collect()
    assert len(twice) == 3 and len({r["lang_pred"] for r in twice}) == 1


def slow_identify(net, text):
    """Every window, filter and place in loops."""
    raw, sums, mass = text.encode(), [0.0] * len(net.languages), 0.0
    for at in range(0, len(raw), langid.WINDOW):
        own = raw[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        hidden = []
        for f in range(net.filters.shape[1]):
            width, most = langid.WIDTHS[f // langid.FILTERS], -math.inf
            for place in range(langid.WINDOW - langid.WIDTHS[-1] + 1):
                most = max(most, sum(float(net.table[own[place + i], d]) * float(net.filters[i * langid.DEPTH + d, f]) for i in range(width) for d in range(langid.DEPTH)))
            hidden.append(max(most + float(net.bias[f]), 0.0))
        z = [sum(h * float(net.out[i, y]) for i, h in enumerate(hidden)) + float(net.out_bias[y]) for y in range(len(sums))]
        e = [math.exp(x - max(z)) for x in z]
        letters = sum(b >= 128 or chr(b).isalpha() for b in own)
        mass += letters
        sums = [s + letters * x / sum(e) for s, x in zip(sums, e, strict=True)]
    return net.languages[sums.index(max(sums))], max(sums) / mass


def test_network_against_loops(spark):
    network = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = ["Der Hund und die Katze sind hier, aber wo ist der Vogel?", "one two", "ça " * 60, "x" * 129]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), network).collect()
    for r in got:
        lang, score = slow_identify(network, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3


def test_sample_is_of_what_can_be_learned(spark):
    rows = [(i, f"word{i} und die" if i % 4 == 0 else "12 34", "aa") for i in range(1600)] + [(5000, "einzig", "rare")] + [(None, "nobody", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = langid.train
    langid.train = lambda windows, labels, languages: seen.append((len(windows), languages))
    try:
        langid.fit(docs, fold=None, docs_each=200, windows_each=1)
    finally:
        langid.train = real
    assert seen == [(201, ["aa", "rare"])]
