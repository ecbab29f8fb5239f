"""The pipeline, stage by stage, against plain Python on a small table."""

import os

import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.helpers import DDL, ROWS, documents, empty
from tests.llm.test_mixing import slow_targets
from tests.llm.test_ngramjoin import slow_components
from tests.llm.test_packing import check
from tidemill.llm import langid, toxicity
from tidemill.llm.common import saved, scratch, staged


def test_stages(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 250")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, raw, SF).cache()
    assert kept.columns == raw.columns
    bad = {r["doc_id"] for r in toxicity.score(raw, toxicity.fit(raw, labels)).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in raw.collect()} - bad

    known = corpus_pipeline.drop_unknown(spark, kept, SF).cache()
    und = {r["doc_id"] for r in langid.identify(kept, langid.fit(kept)).filter("lang_pred = 'und' or score < 0.3").collect()}
    assert {r["doc_id"] for r in known.collect()} == {r["doc_id"] for r in kept.collect()} - und and known.columns == raw.columns

    single = corpus_pipeline.drop_near_copies(spark, known, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, _, c in slow_components(rows) if d == c)

    mixed = corpus_pipeline.mix(spark, single, SF).cache()
    size, most = {}, {}
    for r in single.collect():
        n = len(r["text"].split())
        size[r["source"]], most[r["source"]] = size.get(r["source"], 0) + n, max(most.get(r["source"], 0), n)
    took = dict.fromkeys(size, 0)
    for r in mixed.collect():
        took[r["source"]] += len(r["text"].split())
    assert all(abs(took[s] - t) <= most[s] for s, t in slow_targets(size).items()) and mixed.columns == raw.columns

    check([(r["doc_id"], r["text"]) for r in mixed.distinct().collect()], corpus_pipeline.pack(spark, mixed, SF).collect())


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 0), (5, 1), (6, 0), (8, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_on_edge_rows(spark, tables):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty(spark), tables)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, tables).collect()} >= {2, 3, 4}
    known = [r["doc_id"] for r in corpus_pipeline.drop_unknown(spark, docs, tables).collect()]
    assert not {2, 3, 4} & set(known) and {1, 6, 8} <= set(known)
    single = sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, docs, tables).collect())
    assert single == sorted(["1", "2", "3", "4", "5", "None", "8", "9"])
    mixed = corpus_pipeline.mix(spark, docs, tables).collect()
    assert all(mixed.count(r) <= 2 * docs.collect().count(r) for r in mixed)
    check([(r[0], r[1]) for r in ROWS if r[0] not in (5, None)], corpus_pipeline.pack(spark, docs.filter("doc_id <> 5"), tables).collect())


def test_near_copies_of_repeated_ids(spark, tables):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a + " more"), (5, b), (5, b), (7, b + " more"), (9, ""), (9, None), (9, a), (11, "x y"), (11, "x  y"), (11, "z")]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], DDL)
    got = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, docs, tables).collect())
    assert got == sorted([(1, a), (5, b), (9, ""), (9, ""), (11, "x  y"), (11, "z")])


def test_run(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").filter("doc_id < 150").write.parquet(f"{tmp_path}/{name}.parquet")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    before = folders(spark)
    got = corpus_pipeline.run(spark, str(tmp_path))
    # the stages' own tables stay, what they wrote on their way doesn't
    assert sorted(x.rsplit("-", 1)[0] for x in folders(spark) - before) == sorted(name for name, _ in corpus_pipeline.STAGES)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert got.count() > 0 and sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def folders(spark):
    return set(os.listdir(os.path.dirname(scratch(spark, "x"))))


def test_failed_stage(spark):
    before = folders(spark)

    def fails():
        saved(spark.range(3).toDF("doc_id"), "way")
        raise ValueError("no stage")

    with pytest.raises(ValueError, match="no stage"):
        staged(spark, "failed", fails)
    assert folders(spark) == before
