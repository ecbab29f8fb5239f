"""Cheap looks before patterns give what the patterns alone give."""

import random

from pyspark.sql import functions as F

from tidemill import rules as R
from tidemill.functions import text as X
from tidemill.operators import places, truth

PARTS = [*R.PROVINCES, "철근 콘크리트", "철근콘크리트 벽식구조", "조립식 판넬지붕", "벽돌조 슬래브지붕", "시멘트블럭조강판지붕", "철골구조", "기타지붕(패널)", "샌드위치 판넬조", "콘크리트 슬래브 및", " 및 및 ", "[ ]", "( )", "경기", "도 ", "판넬", "지붕", "  ", "　", " ", "대 10㎡"]


def texts(n):
    rng = random.Random(8)
    cut = lambda p: p[: rng.randrange(len(p) + 1)] + rng.choice(PARTS) + p[len(p) // 2 :]
    return ["".join(rng.choice(PARTS) if rng.random() < 0.8 else cut(rng.choice(PARTS)) for _ in range(rng.randrange(8))) for _ in range(n)]


def test_gated_patterns_equal_plain_ones(spark):
    df = spark.createDataFrame([(t,) for t in [*texts(3000), "대서울특별시구광역시 동구", "경경기도기도 가", ""]], "t string")
    t = F.col("t")
    pairs = [(p, "") for p in R.MATERIALS]
    province = [(p + r"\s*", "") for p in R.PROVINCES]
    bad = df.filter((X.gated(t, pairs, X._MATERIAL_WORDS) != X.replaced(t, pairs)) | (X.strip_province(t) != X.replaced(t, province)))
    assert bad.count() == 0
    assert all(any(any(w in p for w in ws) for ws in X._MATERIAL_WORDS) for p in R.MATERIALS)


def test_records_are_made_again_only_where_needed(spark):
    """A record whose edits hold needs no second text of its source: that is made in the branches that use it, and in no column of every record."""
    ddl = "ok long, src_locs array<struct<address:string,use:string>>, out_locs array<struct<address:string,use:string>>"
    plan = places.enforce(spark.createDataFrame([], ddl))._jdf.queryExecution().analyzed().toString()
    assert "_fallback" not in plan


def test_depth_leaves_room(spark):
    """The analyzer resolves a nested step an iteration; the deepest function stays well within its limit of 100."""
    before = spark.conf.get("spark.sql.analyzer.maxIterations")
    spark.conf.set("spark.sql.analyzer.maxIterations", 90)
    try:
        df = spark.createDataFrame([("하리 1", "대 3㎡", "하리 1", "대")], "a string, b string, c string, d string")
        assert df.select(X.restore_lines(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).count() == 1
    finally:
        spark.conf.set("spark.sql.analyzer.maxIterations", before)


def test_differences_keep_numbers_and_nulls(spark):
    """Repeated rows, null keys and columns in another order, against counting; one aggregation feeds both sides."""
    from collections import Counter

    rng = random.Random(3)
    row = lambda: (rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]), rng.choice(["x", "y"]))
    ours, real = [row() for _ in range(40)], [row() for _ in range(40)]
    names = "doc_id int, grp string, case_no string"
    df = truth.both_differences(spark.createDataFrame(ours, names), spark.createDataFrame(real, names).select("case_no", "grp", "doc_id"))
    a, b = Counter(ours), Counter(real)
    want = Counter({(*k, "missing"): n for k, n in (b - a).items()}) + Counter({(*k, "extra"): n for k, n in (a - b).items()})
    assert Counter(tuple(r) for r in df.collect()) == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_quicker_looks_at_merged_texts(spark):
    """Patterns for texts of single spaces, words cut at in turn, and white space told by its characters, against the plain ways."""
    spaces = [*X.SPACES, "  ", " \t"]
    rng = random.Random(5)
    some = [t + rng.choice(spaces) + rng.choice([*R.MATCH_MARKERS, *R.SHARE_WORDS, "산", "12-3", "제2종 근린생활시설"]) + rng.choice([*spaces, ""]) + rng.choice(PARTS) for t in texts(1500)]
    clauses = ["갑구 7번 공유자 윤석훈 지분 80분의 5 전부", "갑구 4번 이강규 1745분의 785.25 지분 중 일부", "소유자 가 나 지분 일부 3 분의 2", "채무자 가 지분 7분의 3 전부", "가나 지분 전부 7 분의 3"]
    some += [f"{rng.choice(PARTS)}{rng.choice(spaces)}({c.replace(' ', rng.choice(spaces))})" for c in clauses for _ in range(60)]
    t, m = F.col("t"), F.col("m")
    df = spark.createDataFrame([(x,) for x in some], "t string").withColumn("m", X.stripped(F.regexp_replace("t", R.W + "+", " "))).cache()
    assert df.filter(X.merge_space(t) != m).isEmpty()
    head = lambda ws: F.coalesce(F.substring(t, F.lit(1), X.first_of(t, ws) - 1), t)
    assert all(X._apart(ws) and df.filter(X.head_before(t, ws) != head(ws)).isEmpty() for ws in (R.MATCH_MARKERS, R.SHARE_MARKERS)) and not X._apart(["ab", "bc"])
    assert df.select(X.head_before(F.lit("xabc"), ["bc", "ab"]).alias("h")).first()["h"] == "x"
    both = lambda f: f(m, merged=True) != f(m)
    assert df.filter(both(X.share_notation) | both(X.shorten_facility) | both(X.strip_materials) | (X.lot_tokens(t) != X.lot_tokens(m))).isEmpty()
    assert df.filter(X.share_notation(m) != m).count() > 100 and r"\p{Z}" not in R.spaced(r"\s[\sa]\S", merged=True)


def test_prepared_records_are_enforced_alike(spark):
    """What prepare() makes in rows gives the records that whole arrays give."""
    from tests.conftest import SF
    from tidemill.plans.fixtures import load

    rows = load(spark, SF, "nf_shares").filter("ok < 3000").cache()
    pair = lambda a, u: F.struct("seq", F.struct(F.col(a).alias("address"), F.col(u).alias("use")).alias("l"))
    gather = lambda x: F.transform(F.sort_array(F.collect_list(x)), lambda s: s["l"])
    plain = rows.groupBy("ok").agg(gather(pair("src_addr", "src_use")).alias("src_locs"), gather(F.when(F.col("out_addr").isNotNull(), pair("out_addr", "out_use"))).alias("out_locs"))
    made = places.prepare(rows)
    ready = made.groupBy("ok").agg(gather(F.struct("seq", F.col("source").alias("l"))).alias("src_locs"), gather(F.when(F.col("edited").isNotNull(), F.struct("seq", F.col("edited").alias("l")))).alias("out_locs"))
    found = [sorted(map(tuple, places.enforce(df).select("ok", "rebuilt", F.to_json("locations")).collect())) for df in (plain, ready)]
    assert found[0] == found[1] and {x[1] for x in found[0]} == {True, False}
    # texts without a share word are not worked on
    assert made.filter((F.size("source.shares") == 0) & F.col("source.lots").isNotNull()).isEmpty()
