"""Notice tables derived from the driver's tables, in SQL that Spark and other engines read alike.

TEXT stands for the text type. Where the two differ, a definition is given for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GROUP = "case {} when 0 then '아파트' when 1 then '연립주택/다세대/빌라' when 2 then '단독주택,다가구주택' when 3 then '상가/오피스텔,근린시설' when 4 then '대지/임야/전답' when 5 then '기타' else '게재제외' end"

_ROW_TEXT = "concat_ws(' | ', case_cell, item_cell, use_cell, addr_cell, detail_cell, price_cell, note_cell)"
_NOTICE = "concat('담 당 계 : 경매 ', cast(doc_id as TEXT), '계', chr(10), '매각일시 : 2023. 7. 3. 10:00', chr(10), '매각결정일시 : 2023. 7. 10. 14:00', chr(10), {})"

#: name -> (needs, SQL) or (needs, {engine: SQL}).
TABLES: dict[str, tuple] = {
    "j": ((), """select l_orderkey ok, l_linenumber ln, l_partkey pk, l_suppkey sk, cast(l_quantity as int) q, cast(floor(l_extendedprice) as bigint) px, year(o_orderdate) y,
   row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) seq
 from lineitem join orders on l_orderkey=o_orderkey"""),
    "nf_rows": (("j",), """select cast(floor(ok / 300) as int) doc_id, ok, cast(seq as int) seq,
 case when seq=1 then concat(cast(y as TEXT),'타경',cast(ok as TEXT), case when ok%9=0 then concat(chr(10),cast(y as TEXT),'타경',cast(ok+1 as TEXT),chr(10),'(중복)') else '' end) else '' end case_cell,
 cast(ln as TEXT) item_cell,
 case when pk%7=0 then '근린시설' when pk%7=1 then '아파트' when pk%7=2 then '임야' else '' end use_cell,
 concat(case when sk%3=0 then '경기도 ' when sk%3=1 then '대구광역시 ' else '세종특별자치시 ' end, case when ok%2=0 then '달성군 현풍읍 ' else '순천시 황전면 ' end, cast(pk as TEXT), '-', cast(ln as TEXT)) addr_cell,
 concat(case when pk%4=0 then '철근콘크리트구조 ' when pk%4=1 then '대 ' else '판넬지붕 제2종근린생활시설 ' end, '1층 ', cast(q as TEXT), '㎡ 2층 ', cast(q + pk%2 as TEXT), '㎡',
   case when sk%5=0 then concat(' (공유자 홍길동 지분 ', cast(sk+2 as TEXT), '분의 ', cast(ln as TEXT), ' 전부)') else '' end) detail_cell,
 case when pk%5=0 then concat(cast(px as TEXT),cast(px as TEXT)) when pk%5=1 then '' else concat(cast(px as TEXT),chr(10),cast(px - px%1000 as TEXT)) end price_cell,
 case when pk%6=0 then '일괄매각. 농지취득자격증명원 제출요(미제출시 보증금 미반환).' when pk%6=1 then '지분매각. 토지별도등기 있음' when pk%6=2 then concat('목록1,2,3,', cast(5+ln as TEXT), ' 제시외 건물 포함임') else '' end note_cell
from j"""),
    "nf_floors": (("j",), """select ok, cast(seq as int) seq, concat(case pk%4 when 0 then '철근콘크리트구조 ' when 1 then '지하 9 층 7㎡ ' else '' end, '1층 ', cast(q as TEXT), '㎡',
   case sk%6 when 0 then '' when 1 then concat(' 2층 ', cast(q as TEXT), '㎡') when 2 then concat(' 2층 ', cast(q as TEXT), '㎡ 3층', cast(q as TEXT), ' ㎡ 옥탑')
    when 3 then concat('(주방) 02층 ', cast(q + 1 as TEXT), '.50㎡ / 3층 ', cast(q + 1 as TEXT), '.50㎡, 4층 ', cast(q + 1 as TEXT), '.50㎡') when 4 then concat(' 3층 ', cast(q as TEXT), '㎡ 5층 ', cast(q as TEXT), '㎡ 6층 8㎡ 7층 8㎡ 8층 8㎡ 1층 8㎡ 끝')
    else concat(' 2층 8㎡ 3층 8㎡ 4층 8㎡ 5층 8㎡ 9층 ', cast(q as TEXT), '㎡') end, case when pk%3=0 then ' 부속' else '' end) text from j"""),
    "nf_mixed": (("nf_rows",), """select doc_id, ok, seq, case_cell, item_cell, case when ok%3=0 and (seq%3=1 or ok%5=0) then '' else use_cell end use_cell, addr_cell,
 case when ok%3=0 and (seq%3=1 or ok%5=0) then concat('차명 포터 연식 20', cast(10+seq as TEXT)) when ok%3=0 and seq%3=2 then '보관장소 보관소' else detail_cell end detail_cell, price_cell, case when ok%3=0 then '' else note_cell end note_cell
from (select doc_id, ok, seq, case_cell, case when ok%2=0 and seq>1 then '' else item_cell end item_cell, case when ok%3=0 and seq%3=2 then '' else use_cell end use_cell, addr_cell, detail_cell, price_cell, note_cell from nf_rows) r"""),
    "nf_locs": (("nf_rows",), "select ok, seq, addr_cell src_addr, detail_cell src_use, case when seq%3=0 then replace(addr_cell,'경기도 ','') else addr_cell end out_addr, case when seq%2=0 then detail_cell else '대' end out_use from nf_rows"),
    "nf_shares": (("nf_locs",), """select ok, seq, src_addr, case when ok%4=0 and seq%3<>1 then concat(src_use, ' (갑구 ', cast(seq + 1 as TEXT), '번 이강규 1745분의 785.25 지분전부) (갑구 6번 김정숙 80분의 5 지분 중 일부 ', src_addr, ')') else src_use end src_use,
 case when ok%11=0 and seq=2 then null when ok%13=0 then concat('달성군 하리 ', cast(seq%2 as TEXT)) when ok%5=0 then concat(src_addr, ' ', src_use) else out_addr end out_addr, case when ok%7=0 then null else out_use end out_use from nf_locs"""),
    "nf_lines": (("nf_rows",), """select ok, seq, concat(addr_cell, case when ok%3=0 then concat(chr(10), '  ', chr(13), '하리 ', cast(seq as TEXT), ' [1동]') else '' end) src_addr,
 case when ok%5=0 then null when ok%5=1 then concat(' ', chr(10), detail_cell) else replace(detail_cell, ' 2층', concat(chr(10), '2층')) end src_use,
 concat(addr_cell, case when seq%3=0 then ' [공유자홍길동3/7지분전부] [ 1동 ]' when seq%3=1 then ' [일부] [일부]' else '' end) out_addr,
 case ok%4 when 0 then '' when 1 then '대' when 2 then substring(detail_cell, 1, 20) else null end out_use from nf_rows"""),
    "nf_notes": (("nf_rows",), "select ok, seq, note_cell raw_note, case when seq%4=0 then '' when seq%4=1 then note_cell when seq%4=2 then substring(note_cell,1,6) else replace(note_cell,'일괄매각','') end edit_note from nf_rows"),
    "nf_pred": (("j",), f"select cast(floor(ok / 300) as int) doc_id, cast(y as TEXT)||'타경'||cast(ok as TEXT) case_no, cast(seq as int) seq, cast(ln as TEXT) item_no, {_GROUP.format('pk%7')} pred_grp, {_GROUP.format('(case when sk%10=0 then (pk+1)%6 else pk%6 end)')} truth_grp from j"),
    "nf_words": ((), f"""select cast(floor(user_id / 20) as int) doc_id, cast(user_id as int) page, event_id word_no, cast(event_id%400 as double) top, cast((event_id*37)%500 as double) x0,
 case event_type when 'signup' then concat('[',{_GROUP.format('event_id%6')},']') when 'error' then concat(cast(2020+event_id%5 as TEXT),'타경') when 'click' then cast(event_id as TEXT) when 'view' then concat(cast(2020+event_id%5 as TEXT),'타경',cast(event_id%300 as TEXT)) else '면적' end text from events"""),
    "nf_revisions": ((), "select conv_id rec, turn iter, md5(case when conv_id%3=0 then role when conv_id%3=1 then 'same' else text end) h, text cur, case when turn%2=0 then concat('  ',text,' ') else role end expected, conv_id%4=0 pass from conversations"),
    "nf_progress": ((), "select user_id job_id, ts, event_id seq, case when event_type='purchase' then 'done' when event_type='signup' then 'running' end status, case when event_type in ('click','view') then event_type end phase, case when event_type='error' then props end error from events"),
    "nf_patch": ((), f"select cast(floor(o_custkey / 75) as bigint) job_id, cast(row_number() over (partition by floor(o_custkey / 75) order by o_orderkey)-1 as int) idx, {_GROUP.format('o_orderkey%7')} grp, case when o_orderkey%7=0 then '기타' when o_orderkey%13=0 then '없는그룹' end new_grp, case when o_orderkey%5=0 then concat('메모',cast(o_orderkey as TEXT)) end new_note, o_orderkey%11=0 deleted, case when o_orderkey%3=0 then cast(floor(o_totalprice) as bigint) end order_key from orders"),
    "nf_files": ((), "select concat('0320 법원',cast(p_size as TEXT),case when p_size%4=0 then '' else '-완료' end) folder, concat(case when p_partkey%5=0 then '수정 ' when p_partkey%5=1 then 'CS_' when p_partkey%5=2 then '0320 ' else '' end, cast(p_partkey as TEXT), case when p_partkey%2=0 then '.hwp' else '.pdf' end) name, p_partkey*10%997 length, case when p_partkey%3=0 then '' when p_partkey%7=0 then '기타' when p_size%3=0 then '' when p_partkey%2=0 then '원고' else '최종' end sub from part"),
    "nf_text": (("nf_rows",), {
        "duckdb": f"select doc_id, {_NOTICE.format(f'string_agg({_ROW_TEXT}, chr(10) order by ok, seq)')} text from nf_rows group by doc_id",
        "spark": f"select doc_id, {_NOTICE.format(f'array_join(transform(array_sort(collect_list(struct(ok, seq, {_ROW_TEXT} as l))), x -> x.l), chr(10))')} text from nf_rows group by doc_id",
    }),
    "nf_corrections": ((), "select doc_id seq, cast(doc_id as TEXT) case_no, text signature_text, case doc_id%7 when 0 then '아파트' when 1 then '연립주택/다세대/빌라' when 2 then '단독주택,다가구주택' when 3 then '상가/오피스텔,근린시설' when 4 then '대지/임야/전답' when 5 then '기타' else '게재제외' end grp from documents"),
}

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def chain(name: str, engine: str, seen: list | None = None) -> list[str]:
    """Common table expressions that name needs, itself last."""
    seen = [] if seen is None else seen
    out: list[str] = []
    if name in seen:
        return out
    needs, sql = TABLES[name]
    for n in needs:
        out += chain(n, engine, seen)
    seen.append(name)
    sql = sql if isinstance(sql, str) else sql[engine]
    return [*out, f"{name} as ({sql.replace('TEXT', 'STRING' if engine == 'spark' else 'VARCHAR')})"]


#: Rows of the table that grows which one task is to hold, whatever the session's number of tasks is.
TASK_ROWS = 200_000
#: The key by which a driver's table is joined or grouped.
_JOINED = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
#: Tables that are grouped: what they read, and by which key.
_GROUPED = {"nf_text": ("nf_rows", "doc_id")}
#: Tables that are dealt before their texts are made, whose numbers take much less of a shuffle: what they read, and the columns in its terms.
_EARLY = {("nf_rows", ("doc_id",)): ("j", "cast(floor(ok / 300) as int)")}


def _tasks(spark: SparkSession, sf_dir: str, ctes: list[str]) -> int | None:
    """How many tasks the rows of a table's sources are dealt over; None where the session's own number is enough."""
    rows = max(spark.read.parquet(f"{sf_dir}/{s}.parquet").count() for s in SOURCES if any(f" {s}" in c for c in ctes))
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def load(spark: SparkSession, sf_dir: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A table of the driver, or one derived from them.

    Large ones are dealt over so many tasks that a task's rows don't grow with the table: the sources by the key of their join,
    which is that of windows and joins by order too, and the table by the columns `by`, for what is grouped by these afterwards.
    """
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ctes = chain(name, "spark")
    tasks = _tasks(spark, sf_dir, ctes)
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks and keys else df
    if tasks and (name, by) in _EARLY:
        needed, key = _EARLY[name, by]
        load(spark, sf_dir, needed).repartition(tasks, F.expr(key)).createOrReplaceTempView(needed)
        return spark.sql(f"with {ctes[-1]} select * from {name}")
    if tasks and name in _GROUPED:
        needed, key = _GROUPED[name]
        load(spark, sf_dir, needed, (key,)).createOrReplaceTempView(needed)
        ctes = ctes[-1:]
    else:
        for source in SOURCES:
            if any(f" {source}" in c for c in ctes):
                dealt(spark.read.parquet(f"{sf_dir}/{source}.parquet"), *([_JOINED[source]] if source in _JOINED and any(" join " in c for c in ctes) else [])).createOrReplaceTempView(source)
    return dealt(spark.sql(f"with {', '.join(ctes)} select * from {name}"), *by)
