"""Before and after pairs of the standard, and unit cases."""

import re

import pytest
from pyspark.sql import functions as F

from tidemill import rules as R
from tidemill.functions import text as X

PAIRS = [
    ("strip_province", "충청북도 제천시", "제천시"),
    ("strip_province", "세종특별자치시 전의면", "세종특별자치시 전의면"),
    ("strip_province", None, ""),
    ("normal_use", "[철근]콘크리트 3층단독주택", "3층단독주택"),
    ("strip_materials", "철근콘크리트구조 84㎡", "구조 84㎡"),
    ("strip_materials", "판넬지붕 창고 ()", "창고"),
    ("normal_use", "1,2종근린생활시설", "근린시설"),
    ("normal_use", "제2종근린생활시설", "근린시설"),
    ("normal_use", "대 750㎡ (전 소유권 중)", "대 750㎡ (전 소유권 중)"),
    ("strip_shares", "대 750㎡ (전 소유권 중 갑구 7번 윤석훈 80분의 5 지분전부)", "대 750㎡"),
    ("share_clause", "(갑구 53번 공유자 권금자 지분 24157분의 363 전부)", "갑구53번공유자권금자363/24157지분전부"),
    ("share_clause", "전 소유권 중 갑구 7번 윤석훈 80분의 5 지분전부", "갑구7번윤석훈5/80지분전부"),
    ("share_clause", "갑구 4번 이강규 1745분의 785.25 지분전부", "갑구4번이강규785.25/1745지분전부"),
    ("share_notation", "(공유자 주식회사 지우 지분 167분의 3 전부)", "주식회사지우3/167지분전부"),
    ("share_notation", "(소유자 박철진 지분 중 일부(443분의 218))", "박철진218/443지분일부"),
    ("share_notation", "(고우열 지분 전부 131435분의 16520)", "고우열16520/131435지분전부"),
    ("share_notation", "(채무자 김형래 지분 10분의1 전부)", "김형래1/10지분전부"),
    ("normal_note", "일괄매각. 농지취득자격증명원 제출요(미제출시 보증금 미반환).", "일괄매각.농지취득자격증명요"),
    ("merge_lines", " a\r\n\nb   c ", "a b c"),
    ("split_price", "3,850,0003,850,000", "3,850,000\n3,850,000"),
    ("split_price", "3,850,000\n3,850,000", "3,850,000\n3,850,000"),
    ("split_price", "123124", "123124"),
    ("merge_floors", "1층 73.88㎡ 2층 73.88㎡", "1,2층각73.88㎡"),
    ("merge_floors", "주택 1층 5㎡ 2층 5㎡ 3층 5㎡ 4층 7㎡ 끝", "주택 1~3층각5㎡ 4층7㎡ 끝"),
    ("merge_floors", "1층 5㎡", "1층 5㎡"),
    ("shorten_list", "목록1,2,3,7 매각", "목록1~3,7 매각"),
    ("shorten_list", "목록1,2 매각", "목록1,2 매각"),
    ("order_note", "토지별도등기.일괄매각.2024타경11[중복]", "2024타경11[중복].일괄매각.토지별도등기"),
    ("use_group", " 다세대주택 ", "연립주택"),
    ("use_group", "창고", "기타"),
    ("safe_label", "0320 법원/1-완료", "0320_법원_1_완료"),
    ("json_text", 'text {"a": {"b": 1}} tail', '{"a": {"b": 1}}'),
    ("json_text", '```json\n{"a": 1}\n```', '{"a": 1}'),
    ("json_text", '{"a": 1', None),
    ("town", "달성군 현풍읍 하리 23 대", "달성군 현풍읍"),
    ("town", "세종특별자치시 전의면 1", "세종특별자치시 전의면"),
    ("town", "강남구 역삼동 1", ""),
]


@pytest.mark.parametrize("name", sorted({p[0] for p in PAIRS}))
def test_pairs(spark, name):
    own = [(i, b) for i, (n, b, _) in enumerate(PAIRS) if n == name]
    got = spark.createDataFrame(own, "i int, t string").select("i", getattr(X, name)(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: PAIRS[i][2] for i, _ in own}


def test_arrays(spark):
    df = spark.createDataFrame([("2024 타경 11 및 2023타경52024타경7", "대 5㎡", "본리리 417-1 산12")], "a string, b string, c string")
    r = df.select(X.case_numbers(F.col("a")).alias("n"), X.split_use(F.col("b")).alias("u"), X.lot_tokens(F.col("c")).alias("l"), X.keywords(F.col("a")).alias("k")).first()
    assert r["n"] == ["2024타경11", "2023타경52024"] and tuple(r["u"]) == ("대", "5㎡") and r["l"] == ["417-1", "산12"]
    assert r["k"] == ["2024", "타경", "11", "2023타경52024타경7"]


def test_natural_order(spark):
    df = spark.createDataFrame([("a10",), ("a9",), ("10",), ("9",), ("",), ("a",), ("a09b",), (None,)], "t string")
    got = [r["t"] or "" for r in df.orderBy(X.natural_key(F.col("t")), "t").collect()]
    assert got == ["", "", "9", "10", "a", "a9", "a09b", "a10"]


def test_list_numbers_of_any_size(spark):
    from tidemill.functions import text as X

    cases = {
        "목록1,2,3,7": "목록1~3,7",
        "목록1,2,99999999999": "목록1,2,99999999999",
        "목록1,2,3,99999999999999999999 및 목록4,5,6": "목록1,2,3,99999999999999999999 및 목록4~6",
        "목록9223372036854775805,9223372036854775806,9223372036854775807,1": "목록9223372036854775805~9223372036854775807,1",
    }
    got = spark.createDataFrame(list(cases.items()), "a string, b string").select("b", X.shorten_list(F.col("a")).alias("v")).collect()
    assert all(r["v"] == r["b"] for r in got)


def slow_scan(text, strings):
    at = next((i for i, ch in enumerate(text) if ch in "{["), None)
    if at is None:
        return text.strip(), "none"
    stack, quoted, escaped = [], False, False
    for i in range(at, len(text)):
        ch = text[i]
        if strings and quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
            continue
        if strings and ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append(ch)
        elif ch in "}]":
            stack.pop()
            if not stack:
                return text[at : i + 1], "balanced"
    return text[at:], "cut"


def test_json_scan(spark):
    import random

    from tidemill.functions import text as X

    rng = random.Random(7)
    texts = ["".join(rng.choices('{}[]"\\ab ', k=rng.randrange(30))) for _ in range(600)]
    texts += ['x [{"a":1},{"a":2}] y', 'x {"k":"}{","v":[1,2]} y', 'cut {"a":[1,', "", "  none "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for strings in (False, True):
        got = {r["i"]: (r["s"]["json"], r["s"]["state"]) for r in df.select("i", X.json_scan(F.col("t"), strings).alias("s")).collect()}
        assert got == {i: slow_scan(t, strings) for i, t in enumerate(texts)}
    rows = spark.createDataFrame([('x [{"a":1},{"a":2}] y',), ("```json\n{\"a\":3}\n```",), ('{"a":4',), (None,)], "t string").select(X.json_rows(F.col("t"), "a int").alias("r")).collect()
    assert [([x["a"] for x in r["r"]["rows"]] if r["r"]["rows"] else None, r["r"]["error"]) for r in rows] == [([1, 2], None), ([3], None), (None, "no JSON: cut"), (None, "no JSON: null")]


def test_block_fields_search_once(spark):
    """Each search of a block's fields stands once in the plan; runs of digits and commas count from four characters on, with a comma."""
    texts = ["1,2", "1,234", "1234 ,,,, 5,000,000 12345", "12345,", ",1234", "경기도 가 1\n서울특별시 나\n기타", "단독주택, 다가구주택 2023타경1 1,000\n2,000\n3,000", "", None]
    t = spark.createDataFrame([(x,) for x in texts], "t string").repartition(1)
    df = t.select("t", X.block_fields(F.col("t")).alias("f")).select("t", "f.case_no", "f.use", "f.price", "f.min_price", "f.addresses", "f.detail")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 2
    for r in df.collect():
        found = [p for p in re.findall(r"[\d,]{4,}", r["t"] or "") if "," in p]
        assert (r["price"], r["min_price"]) == ((found or [""])[0], (found[1:] or found or [""])[0])
        places = [p.strip() for p in re.findall(R.TEXT_ADDRESS, r["t"] or "")]
        assert r["addresses"] == (places or [""]) and r["use"] == ((re.findall(R.TEXT_USE, r["t"]) or [""])[0] if r["t"] is not None else None)
        assert r["detail"] == ("" if places else r["t"])


def test_located_equals_location(spark):
    """Rules of locations as projections of rows give what the nested functions give, on texts of every rule and on odd ones."""
    details = [
        "철근콘크리트구조 1층 24㎡ 2층 24㎡ (공유자 홍길동 지분 5분의 1 전부)", "판넬지붕 제2종근린생활시설 1층 5㎡ 2층 6㎡", "대 120㎡", "임야\n\n300㎡", "2층 아파트 1 층 7㎡ 3층 9㎡", None, "", " 　 ",
        "1층 5㎡ 2층 5㎡ 3층 5㎡ 옥탑", "1층 5㎡ 2층 5㎡ 3층 6㎡ 5층 6㎡ 6층 5㎡", "\x01 1층 5㎡ 2층 5㎡", "\x02 1층 5㎡ 2층 6㎡", "1층 5㎡", "1층 5.0㎡ / 2층 5㎡ / 4층 5㎡", "(갑구 3번 공유자 김정숙 지분 80분의 5 전부) 소유자 이강규 지분 중 일부 3분의 1",
        "채무자 가나 지분 3분의 2 전부", "가나 지분 전부 5분의 2", "지분", "[철근] 콘크리트 및 및 벽돌조", "기타지붕(패널) 시멘트블럭조 강판지붕 ( ) [ ] 일반철골구조지붕 샌드위치판넬조", "벽돌및 시멘트 벽돌조 슬래브지붕", "서울경기도특별시 1층 3㎡ 2층 3㎡", "주택\r\n공장", "1층 5㎡ 가 2층 5㎡ 나 3층 7㎡ 다",
    ]
    addresses = ["경기도 달성군 현풍읍 12-3", "세종특별자치시 조치원읍 7", "서울특별시 강남구 역삼동 5", "순천시 황전면 9 (공유자 홍길동 지분 5분의 1 전부)", "", None, "전라강원도남도 순천시 황전면 1", " 대구광역시\n달성군\t현풍읍  3"]
    t = spark.createDataFrame([(a, d) for a in addresses for d in details], "addr_cell string, detail_cell string")
    use = X.split_use(X.merge_floors(X.share_notation(X.shorten_facility(X.strip_materials(X.strip_province(X.merge_lines(F.col("detail_cell"))))))))
    place = X.stripped(X.share_notation(X.strip_province(X.merge_lines(F.col("addr_cell")))))
    want = t.select("addr_cell", "detail_cell", place.alias("p"), use.alias("u")).select("addr_cell", "detail_cell", X.stripped(F.concat_ws(" ", "p", X.stripped(F.col("u.rest")))).alias("address"), "u.use")
    want = want.withColumn("town", X.town(F.col("address")))
    got = X.located(t).select("addr_cell", "detail_cell", F.concat("town", "rest").alias("address"), F.col("place_use").alias("use"), "town")
    assert set(map(repr, got.collect())) ^ set(map(repr, want.collect())) == set()
    # floors as tokens one by one, without the quick way for runs of two
    assert spark.createDataFrame([("1층 5㎡ 2층 5㎡ 3층 6㎡ 5층 6㎡ 6층 5㎡ 끝",)], "t string").select(X.merge_floors(F.col("t"))).first()[0] == "1,2층각5㎡ 3,5층각6㎡ 6층5㎡ 끝"


def test_rules_of_locations_are_not_nested(spark):
    """Rules of locations are steps of rows: none stands in a function of an array."""
    t = spark.createDataFrame([("a", "b")], "addr_cell string, detail_cell string")
    plan = X.located(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project [") > 20


def test_natural_key_tokens(spark):
    texts = ["", "12타경3", "12타경003", "a", "a1", "01", "1", "가\n2나10", "0", "00", "2024타경99999999999999999999999"]
    got = {r["t"]: [tuple(k) for k in r["k"]] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.natural_key(F.col("t")).alias("k")).collect()}
    for t in texts:
        parts = re.split(r"(\d+)", t)
        parts = parts[:-1] if len(parts) > 1 and parts[-1] == "" else parts
        assert got[t] == [(i % 2 == 1, len(p.lstrip("0")) if i % 2 else 0, p.lstrip("0") if i % 2 else p) for i, p in enumerate(parts)]
