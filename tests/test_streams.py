"""Streams against their batch forms; sources and sinks as round trips."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemill.operators import review, rows
from tidemill.plans.fixtures import load
from tidemill.sources import files, logs
from tidemill.streaming import claims, jobs


def test_correction_feed(spark, tmp_path):
    log, path = load(spark, SF, "nf_corrections"), str(tmp_path / "log")
    for part in (0, 1):
        logs.append_corrections(log.filter(F.col("seq") % 2 == part), path)
    logs.append_corrections(log.limit(0), path)
    query = jobs.correction_counts(spark, path).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted((r["grp"], r["n"]) for r in review.group_counts(log).collect())
    jobs.refresh_last(spark, path, str(tmp_path / "last"), str(tmp_path / "ck"), 50).awaitTermination()
    want = sorted(r["seq"] for r in review.last_n(log, 50).collect())
    assert sorted(r["seq"] for r in jobs.last_corrections(spark, str(tmp_path / "last")).collect()) == want
    logs.append_corrections(log.filter("seq < 9").withColumn("seq", F.col("seq") + 10**6), path)
    jobs.refresh_last(spark, path, str(tmp_path / "last"), str(tmp_path / "ck"), 50).awaitTermination()
    again = sorted(r["seq"] for r in jobs.last_corrections(spark, str(tmp_path / "last")).collect())
    assert again[-9:] == [10**6 + i for i in range(9)] and again[:-9] == want[9:]


def test_job_state(spark, tmp_path):
    at = lambda minute, hour=10: datetime(2024, 1, 1, hour, minute)
    ddl = "job_id long, ts timestamp, seq long, status string, phase string"
    batches = [
        [(1, at(0), 1, "running", "a"), (1, at(1), 2, None, "b"), (1, at(1), 1, None, "older"), (2, at(2), 3, "done", None)],
        [(1, at(1), 2, None, "b"), (1, at(0), 1, "running", "a"), (3, at(0, 12), 5, "running", None)],
        [(2, at(3), 9, "late", None), (1, at(4, 12), 6, "done", None), (3, at(5, 12), 7, "done", None), (3, at(6, 12), 8, "running", None)],
        [(4, at(0, 15), 10, None, None)],
        [(1, at(1, 15), 11, None, "again"), (4, at(1, 15), 11, None, "x")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.fold_jobs(stream, ["status", "phase"], str(tmp_path / "out"), str(tmp_path / "ck"), keep=timedelta(hours=1))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("epoch", "closed", "job_id").collect()
    got = [(r["job_id"], r["status"], r["phase"], r["closed"]) for r in rows]
    assert got[:2] == [(1, "running", "b", False), (2, "done", None, False)] and (1, "running", "b", False) in got[2:4]
    assert (2, "done", None, True) in got and (1, "done", "b", True) in got and (2, "late", None, False) not in got
    assert (3, "running", None, False) in got and not any(r[0] == 3 and r[3] for r in got)  # it started again
    last = {r["job_id"]: tuple(r) for r in jobs.last_states(spark, str(tmp_path / "out")).collect()}
    assert last[1] == (1, None, "again", False) and last[2] == (2, "done", None, True)  # a new run has nothing of the old one
    held = spark.read.format("statestore").option("stateVarName", "status").load(str(tmp_path / "ck"))
    assert {r["key"]["job_id"] for r in held.select("key").collect()} == {3}  # done jobs have left the state
    assert spark.conf.get(jobs.STATE_STORE[0], None) != jobs.STATE_STORE[1]


def test_ingest_once(spark, tmp_path):
    import os

    folder, got = tmp_path / "in", []
    folder.mkdir()
    text = load(spark, SF, "nf_text").limit(4).collect()
    run = lambda: jobs.ingest(spark, str(folder), lambda table, epoch: got.extend(table.collect()), str(tmp_path / "ck"), str(tmp_path / "done")).awaitTermination()
    for i, r in enumerate(text):
        (folder / f"{r['doc_id']}.txt").write_text(r["text"])
        if i == 3:  # an old file that arrives late
            os.utime(folder / f"{r['doc_id']}.txt", (10**9, 10**9))
        if i % 2:
            run()
    run()
    want = load(spark, SF, "nf_text").join(spark.createDataFrame([(r["doc_id"],) for r in text], "doc_id int"), "doc_id").withColumn("job_id", F.col("doc_id").cast("string"))
    assert len(got) == jobs.published_notices(want).count() > 0 and {r["sale_date"] for r in got} == {"2023. 7. 3. 10:00"}
    assert len({r["job_id"] for r in got}) == 4


def test_two_runs_publish_each_notice_once(spark, tmp_path):
    folder, got = tmp_path / "in", []
    folder.mkdir()
    text = load(spark, SF, "nf_text").limit(1).first()["text"]
    for i in range(12):
        (folder / f"{i}.txt").write_text(text)
    sink = lambda table, epoch: got.extend(r["job_id"] for r in table.select("job_id").distinct().collect())
    both = [jobs.ingest(spark, str(folder), sink, str(tmp_path / f"ck{k}"), str(tmp_path / "done")) for k in (0, 1)]
    for query in both:
        query.awaitTermination()
    assert len(got) == 12 == len(set(got))


def test_notices_move_once(spark, tmp_path, monkeypatch):
    """Notices are dealt by job once, over tasks by their number; packed ones are taken in like plain ones."""
    import re

    folder, seen = tmp_path / "in", []
    texts = load(spark, SF, "nf_text").filter("doc_id < 24")
    files.write_texts(texts, str(folder), "doc_id", packed=True, dealt=True)
    names = [p.name for p in folder.glob("*/*")]
    assert len(names) == 24 and all(n.endswith(".txt.gz") for n in names)
    back = files.read_notices(spark, f"{folder}/*").select(F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("int"), "text")
    assert back.exceptAll(texts.select("doc_id", F.concat("text", F.lit("\n")))).isEmpty()
    assert sum(p.stat().st_size for p in folder.glob("*/*")) * 4 < texts.agg(F.sum(F.octet_length("text"))).first()[0]

    def sink(table, epoch):
        plan = table._jdf.queryExecution().executedPlan().toString()
        moved = [m for m in re.findall(r"Exchange (\S+)\(([^()]*)", plan) if m[0] == "hashpartitioning"]
        assert moved and all(re.fullmatch(r"job_id#\d+, \d+", keys) for _, keys in moved)
        seen.append((table.rdd.getNumPartitions(), {r["job_id"]: r["n"] for r in table.groupBy("job_id").agg(F.count("*").alias("n")).collect()}))

    run = lambda name: jobs.ingest(spark, f"{folder}/*", sink, str(tmp_path / f"ck{name}"), str(tmp_path / f"done{name}")).awaitTermination()
    run("few")
    monkeypatch.setattr(jobs, "TASK_FILES", 3)
    run("many")
    assert len(seen[0][1]) == 24 and seen[0][1] == seen[1][1] and seen[1][0] == 8


def test_claims(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "job_id string")
    own = lambda df: sorted(r["job_id"] for r in df.collect())
    path = str(tmp_path / "claims")
    a, b, c = (claims.Claims(spark, path, name, lease=60) for name in "abc")
    mine = a.claim(ids("x", "y", "y", None), str(tmp_path / "1"))
    assert own(mine) == ["x", "y"] and own(b.claim(ids("x", "y", "z"), str(tmp_path / "2"))) == ["z"]
    assert own(a.claim(ids("x", "z"), str(tmp_path / "3"))) == ["x"]  # run again
    a.finish(mine)
    dead = claims.Claims(spark, path, "dead", lease=-1).claim(ids("w", "x"), str(tmp_path / "4"))
    assert own(dead) == ["w"] and own(c.claim(ids("w", "x", "z"), str(tmp_path / "5"))) == ["w"]
    buckets = {r["bucket"] for r in ids("w", "x", "y", "z").select(claims.bucket(F.col("job_id")).alias("bucket")).collect()}
    read = c._read(sorted(buckets)[:1]).inputFiles()
    assert read and all(f"bucket={sorted(buckets)[0]}/" in f for f in read)
    before = sorted(map(tuple, c._read(sorted(buckets)).collect()))
    assert c.compact(sorted(buckets), files=2) and sorted(map(tuple, c._read(sorted(buckets)).collect())) == before
    assert not list((tmp_path / "claims" / "locks").glob("[0-9]*"))


def test_failures_stand_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "bad"), (3, None, None), (3, None, "worse")], "id int, v string, error string")
    good, dead = logs.split_failures(df, str(tmp_path / "out"))
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (3, None)] and sorted(r["error"] for r in dead.collect()) == ["bad", "worse"]
    good, dead = logs.split_failures(df.limit(0), str(tmp_path / "none"))
    assert good.count() == dead.count() == 0
    seen = iter(range(10**6))
    unsteady = df.withColumn("error", F.udf(lambda: str(next(seen)), "string")())
    logs.split_failures(unsteady, str(tmp_path / "u"))  # evaluated once, or its counts would not add up


def test_triage_and_texts(spark, tmp_path):
    for name, raw in (("a.pdf", b"%PDF"), ("b.hwpx", b"PK\x03\x04"), ("c.hwp", b"\xd0\xcf\x11\xe0\xa1"), ("d.hwpx", b"plain"), ("e.txt", "사건\xff".encode("utf-8") + b"\xff"), ("f.exe", b"MZ")):
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rpartition("/")[2]: r["kind"] for r in files.triage(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "pdf", "b.hwpx": "hwpx", "c.hwp": "hwp5", "d.hwpx": "text", "e.txt": "text"}
    assert files.read_notices(spark, str(tmp_path / "e.txt")).first()["text"] == "사건ÿ"


def test_results_of_one_job(spark, tmp_path):
    records = rows.assemble(rows.islands(load(spark, SF, "nf_rows").filter("doc_id < 4"))).withColumnRenamed("doc_id", "job_id").drop("price_value")
    path, one = str(tmp_path / "out"), lambda k: records.filter(F.col("job_id") == k)
    read = lambda k=None: logs.read_results(spark, path, records.schema, k)
    for k in (1, 2):
        logs.write_results(one(k), path)
    for k in (1, 2):
        back = read(k)
        assert back.select(*records.columns).exceptAll(one(k)).isEmpty() and back.count() == one(k).count()
        assert "PartitionFilters: [isnotnull(job_id" in back._jdf.queryExecution().toString()
    reviewed = one(1).limit(3).withColumn("note", F.lit("seen"))
    version = logs.write_results(reviewed, path)
    logs.write_results(reviewed, path, version=version)
    assert read(1).count() == 3 and read(2).count() == one(2).count() == read().count() - 3
    logs.write_results(records.limit(0), path, jobs=spark.createDataFrame([(2,)], "job_id int"))
    assert read(2).count() == read(9).count() == 0 and read().count() == 3


def test_results_are_packed(spark, tmp_path):
    """Results take a fraction of their JSON text on disk, whatever older versions of a folder hold, and the jobs are known without them."""
    records, path = spark.createDataFrame([(k, i, "대구광역시 달성군 현풍읍 하리 23") for k in (1, 2, 3) for i in range(400)], "job_id int, rec_no int, note string"), str(tmp_path / "out")
    logs.write_results(records.filter("job_id = 3"), path)
    logs.write_results(records.filter("job_id < 3"), path)
    logs.write_results(records.limit(0), path, jobs=records.select("job_id").filter("job_id = 2"))
    parts = list((tmp_path / "out" / "data").glob("**/part-*"))
    assert parts and all(p.name.endswith(".json.gz") for p in parts) and sum(p.stat().st_size for p in parts) < 1200 * 20
    assert sorted(r["job_id"] for r in logs.known_jobs(spark, path, "int").collect()) == [1, 2, 3]
    records.filter("job_id = 1").withColumn("version", F.lit(9)).write.partitionBy("version", "job_id").json(str(tmp_path / "plain"))
    for p in (tmp_path / "plain").glob("**/part-*"):  # a version from before
        to = tmp_path / "out" / "data" / "version=9" / "job_id=1" / p.name
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(p.read_bytes())
    spark.createDataFrame([(1, 9)], "job_id int, version long").write.mode("append").parquet(f"{path}/jobs")
    got = logs.read_results(spark, path, records.schema)
    assert got.exceptAll(records.filter("job_id <> 2")).isEmpty() and got.count() == 800


def test_pairs_of_written_folders(spark, tmp_path):
    tree = {
        "0320 법원-완료": ["0320 a.hwp", "CS_b.hwpx", "0320 b.pdf"],
        "0321 법원-완료": ["0321 own.hwp", "0321 own.pdf", "원고/CS_c.hwp", "원고/x.hwp", "최종/z.pdf", "최종/수정 y.pdf", "기타/0321 no.hwp"],
        "0322 법원-완료": ["0322 own.hwp", "원고/notes.txt", "최종/a.pdf"],
        "0323 법원": ["0323 a.hwp", "0323 a.pdf"],
    }
    for folder, names in tree.items():
        for name in names:
            path = tmp_path / folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"x" * len(name))
    got = {r["folder"]: (r["raw"], r["final"]) for r in files.pair_files(files.list_files(spark, str(tmp_path))).collect()}
    assert got == {"0320 법원-완료": ("0320 a.hwp", "0320 b.pdf"), "0321 법원-완료": ("CS_c.hwp", "수정 y.pdf"), "0322 법원-완료": ("0322 own.hwp", "a.pdf")}


def test_texts_written_by_tasks(spark, tmp_path):
    """A file a row, of repeated and null keys and null texts too; the driver has no folder a key to commit."""
    texts = [(1, "a\nb"), (1, "c"), (2, None), (None, "사건"), (-3, "")]
    files.write_texts(spark.createDataFrame(texts, "k long, text string"), str(tmp_path / "out"), "k")
    got = files.read_notices(spark, f"{tmp_path}/out/*").select(F.regexp_extract("path", r"k=(-?\d+|null)-", 1), "text").collect()
    assert sorted(map(tuple, got)) == sorted(("null" if k is None else str(k), f"{text or ''}\n") for k, text in texts)
    assert not list((tmp_path / "out").glob("**/k=*/"))
