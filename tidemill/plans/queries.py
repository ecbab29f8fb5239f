"""The registered queries: each operator over a whole table, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill import rules as R
from tidemill.functions import text as X
from tidemill.operators import history, places, publish, review, rows, truth
from tidemill.plans import oracle_sql as Q
from tidemill.plans.fixtures import load
from tidemill.rules import spaced
from tidemill.sources import files, logs
from tidemill.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def column_query(name: str, table: str, keys: str, spark_col, sql_expr: str) -> None:
    """A column function over a table, as column `value`."""
    QUERIES[name] = lambda spark, sf, t=table, k=keys, c=spark_col: load(spark, sf, t).select(*k.split(", "), c().alias("value"))
    ORACLES[name] = Q.over(table) + f"select {keys}, {sql_expr} as value from {table}"


K = "ok, seq"
c = F.col


def _join(x):
    return F.array_join(x, "|")


# ---- 2.7 column functions ----
column_query("f1_strip_province", "nf_rows", K, lambda: X.strip_province(c("addr_cell")), Q.province("addr_cell"))
column_query("f2_strip_materials", "nf_rows", K, lambda: X.strip_materials(c("detail_cell")), Q.materials("detail_cell"))
column_query("f3_merge_lines", "nf_rows", K, lambda: X.merge_lines(c("price_cell")), Q.merge_lines("price_cell"))
column_query("f3_merge_space", "nf_text", "doc_id", lambda: X.merge_space(c("text")), Q.merge_space("text"))
column_query("f3_lines", "nf_rows", K, lambda: _join(X.lines(c("price_cell"))), Q.joined(Q.lines("price_cell")))
column_query("f4_facility", "nf_rows", K, lambda: X.shorten_facility(c("detail_cell")), Q.facility("detail_cell"))
column_query("f5_farmland", "nf_rows", K, lambda: X.shorten_farmland(c("note_cell")), Q.farmland("note_cell"))
column_query("f6_spaces_and_periods", "nf_rows", K, lambda: X.strip_periods(X.squeezed(X.text(c("note_cell")))), Q.rr(Q.squeeze(Q.text("note_cell")), [(r"\.+$", "")]))
column_query("f7_particles", "nf_rows", K, lambda: X.shorten_particles(c("note_cell")), Q.particles("note_cell"))
column_query("f8_share_notation", "nf_rows", K, lambda: X.share_notation(c("detail_cell")), Q.notation("detail_cell"))
column_query("f9_share_clause", "nf_rows", K, lambda: X.share_clause(c("detail_cell")), Q.clause("detail_cell"))
column_query("f10_share_texts", "nf_rows", K, lambda: _join(X.share_texts(c("detail_cell"))), Q.joined(Q.share_texts("detail_cell")))
column_query("f11_strip_shares", "nf_rows", K, lambda: X.strip_shares(c("detail_cell")), Q.strip_shares("detail_cell"))
column_query("f12_normal_use", "nf_rows", K, lambda: X.normal_use(c("detail_cell")), Q.normal_use("detail_cell"))
column_query("f12_normal_address", "nf_rows", K, lambda: X.normal_address(F.concat_ws(" ", "addr_cell", "detail_cell")), Q.normal_address("concat_ws(' ', addr_cell, detail_cell)"))
column_query("f12_normal_note", "nf_rows", K, lambda: X.normal_note(c("note_cell")), Q.normal_note("note_cell"))
_LAND, _BUILDING = Q.lit(spaced(R.LAND_USE)), Q.lit(spaced(R.BUILDING_USE))



def _split_sql(x: str) -> str:
    """Use and rest of a detail, a bar between them."""
    return f"case when regexp_matches({x}, {_LAND}) then regexp_extract({x}, {_LAND}, 1) || '|' || regexp_extract({x}, {_LAND}, 2) when regexp_matches({x}, {_BUILDING}) then regexp_extract({x}, {_BUILDING}, 2) || '|' || {x} else '|' || {x} end"


_SPLIT = _split_sql(Q.strip(Q.text("detail_cell")))
column_query("f13_split_use", "nf_rows", K, lambda: F.concat_ws("|", X.split_use(c("detail_cell"))["use"], X.split_use(c("detail_cell"))["rest"]), _SPLIT)
column_query("f14_use_group", "nf_rows", K, lambda: X.use_group(c("use_cell")), f"case {Q.strip(Q.text('use_cell'))} " + " ".join(f"when {Q.lit(a)} then {Q.lit(b)}" for a, b in R.USE_GROUPS.items()) + f" else {Q.lit(R.OTHER)} end")
_NUMS = r"regexp_extract_all(case_cell, '\d+타경\d+')"
_BOTH = f"regexp_extract(case_cell, '(중복|병합)', 1) <> '' and len({_NUMS}) >= 2"
column_query("f15_duplicate_tag", "nf_rows", K, lambda: F.concat_ws("|", X.duplicate_tag(c("case_cell"))["case_no"], X.duplicate_tag(c("case_cell"))["tag"]), f"case when {_BOTH} then {_NUMS}[1] || '|' || {_NUMS}[2] || '[' || regexp_extract(case_cell, '(중복|병합)', 1) || ']' else {Q.strip('case_cell')} end")
_RANK = r"case when regexp_matches(p, '\d{4}타경\d+') then 0 when regexp_matches(p, '일괄매각|지분매각') then 1 else 2 end"
QUERIES["f16_order_note"] = lambda spark, sf: load(spark, sf, "nf_notes").select("ok", "seq", X.order_note(c("edit_note")).alias("value"))
ORACLES["f16_order_note"] = Q.over("nf_notes", f"p as (select ok, seq, unnest(l) p, generate_subscripts(l, 1) i from (select ok, seq, list_filter(list_transform(string_split(coalesce(edit_note, ''), '.'), lambda e: {Q.strip('e')}), lambda e: e <> '') l from nf_notes))") + f"select n.ok, n.seq, coalesce(v, '') as value from nf_notes n left join (select ok, seq, string_agg(p, '.' order by {_RANK}, i) v from p group by ok, seq) using (ok, seq)"
column_query("f17_split_price", "nf_rows", K, lambda: X.split_price(c("price_cell")), Q.split_price("price_cell"))
_PL = Q.price_lines(Q.split_price("price_cell"))
QUERIES["f17_prices"] = lambda spark, sf: load(spark, sf, "nf_rows").withColumn("p", X.prices(X.split_price(c("price_cell")))).select("ok", "seq", "p.price", "p.min_price", F.col("p.price_value").cast("bigint").alias("price_value"))
ORACLES["f17_prices"] = Q.over("nf_rows", f"p as (select ok, seq, {_PL} l from nf_rows)") + "select ok, seq, coalesce(l[1], '') price, coalesce(l[2], l[1], '') min_price, try_cast(replace(l[1], ',', '') as bigint) price_value from p"
_H = lambda p, n: f"nullif({Q.strip(f'regexp_extract(text, {Q.lit(spaced(p))}, 1)')}, '') {n}"
_OFFICE = f"nullif({Q.rr(Q.strip(f'regexp_extract(text, {Q.lit(spaced(R.OFFICE))}, 1)'), [(r'\s+', ' ')])}, '') damdang"
QUERIES["f18_header"] = lambda spark, sf: rows.headers(load(spark, sf, "nf_text")).drop("text")
ORACLES["f18_header"] = Q.over("nf_text") + f"select doc_id, {_OFFICE}, {_H(R.SALE_DATE, 'sale_date')}, {_H(R.DECISION_DATE, 'decision_date')} from nf_text"

# blocks of the notice texts; in the prices of whole rows commas are put in
_SEG = (
    f"cut as (select doc_id, string_split(regexp_replace(text, {Q.lit('(' + spaced(R.CASE) + ')')}, chr(1) || '\\1', 'g'), chr(1)) l from nf_text)",
    "seg as (select doc_id, p, s from (select doc_id, len(l) n, unnest(l) s, generate_subscripts(l, 1) - 1 p from cut) where n = 1 or p > 0)",
    f"gap as (select *, {Q.strip('substring(lag(s) over (partition by doc_id order by p), 11)')} g from seg)",
    "num as (select *, sum(case when length(g) < 30 and not contains(g, chr(10)) then 0 else 1 end) over (partition by doc_id order by p) block_no from gap)",
    f"blk as (select doc_id, block_no, {Q.strip('string_agg(s, chr(0) order by p)')} t from num group by doc_id, block_no)".replace("chr(0)", "''"),
    f"blocks as (select doc_id, cast(block_no as bigint) block_no, coalesce({Q.case_numbers('t')}[1], {Q.lit(R.UNKNOWN_CASE)}) case_no, {Q.case_numbers('t')} all_nos, t block_text from blk)",
)


@query("w3_segment", Q.over("nf_text", *_SEG) + f"select doc_id, block_no, case_no, {Q.joined('all_nos')} all_nos, block_text from blocks")
def w3_segment(spark, sf):
    return rows.segment(load(spark, sf, "nf_text")).withColumn("all_nos", _join("all_nos"))


@query("a11_inventory", Q.over("nf_text", *_SEG) + "select doc_id, count(*) blocks, string_agg(case_no, '|' order by block_no) cases from blocks group by doc_id")
def a11_inventory(spark, sf):
    return rows.inventory(rows.segment(load(spark, sf, "nf_text"))).withColumn("cases", _join("cases"))


_COMMA = r"regexp_replace(block_text, '(\d)(\d{3})(\D|$)', '\1,\2\3', 'g')"
_TP = "list_filter(regexp_extract_all(b, '[\\d,]{4,}'), lambda p: contains(p, ','))"
_TA = f"list_transform(regexp_extract_all(b, {Q.lit(R.TEXT_ADDRESS)}, 1), lambda a: {Q.strip('a')})"


@query("f19_block_fields", Q.over("nf_text", *_SEG, f"b0 as (select doc_id, block_no, {_COMMA} b from blocks)", f"b1 as (select *, {_TP} pr, {_TA} ad from b0)") + rf"select doc_id, block_no, regexp_extract(b, '\d{{4}}타경\d+') case_no, regexp_extract(b, {Q.lit(spaced(R.TEXT_USE))}, 1) use_, coalesce(pr[1], '') price, coalesce(pr[2], pr[1], '') min_price, array_to_string(ad, '|') addresses, case when len(ad) > 0 then '' else {Q.strip('b')} end detail from b1")
def f19_block_fields(spark, sf):
    blocks = rows.segment(load(spark, sf, "nf_text")).withColumn("b", F.regexp_replace("block_text", r"(\d)(\d{3})(\D|$)", "$1,$2$3"))
    return blocks.withColumn("f", X.block_fields(c("b"))).select("doc_id", "block_no", "f.case_no", F.col("f.use").alias("use_"), "f.price", "f.min_price", _join("f.addresses").alias("addresses"), "f.detail")


column_query("f22_lot_tokens", "nf_rows", K, lambda: _join(X.lot_tokens(c("addr_cell"))), Q.joined(Q.lots("addr_cell")))
column_query("f22_keywords", "nf_rows", K, lambda: _join(F.array_sort(X.keywords(c("note_cell")))), Q.joined(f"list_sort({Q.keywords('note_cell')})"))
column_query("f22_signature", "nf_rows", K, lambda: X.signature(F.array("addr_cell"), F.array("detail_cell"), c("note_cell")), "addr_cell || ' ' || detail_cell || ' ' || note_cell")
column_query("f28_safe_label", "nf_files", "name, length", lambda: X.safe_label(c("folder")), "substring(regexp_replace(folder, '[^A-Za-z0-9가-힣()]+', '_', 'g'), 1, 80)")
column_query("f31_case_numbers", "nf_text", "doc_id", lambda: _join(X.case_numbers(c("text"))), Q.joined(Q.case_numbers("text")))
_W11 = "concat(raw_note, ' 목록', cast(seq as TEXT), ',', cast(seq + 1 as TEXT), case when ok % 2 = 0 then concat(',', cast(seq + 2 as TEXT)) else '' end, ' 및 목록', cast(ok % 3 as TEXT), ',', cast(seq + 20 as TEXT), ',', cast(seq + 21 as TEXT), ',', cast(seq + 22 as TEXT), ',3 제외', case ok % 5 when 0 then ' 목록1,2,99999999999' when 1 then ' 목록1,2,99999999999999999999' when 2 then ' 목록9223372036854775806,9223372036854775807' else '' end)"
_LISTS = Q.lit(R.LISTED)


@query("w11_list_numbers", Q.over(
    "nf_notes",
    f"t as (select ok, seq, {_W11.replace('TEXT', 'VARCHAR')} t from nf_notes)",
    f"m as (select ok, seq, unnest(regexp_extract_all(t, {_LISTS}, 2)) l, generate_subscripts(regexp_extract_all(t, {_LISTS}, 2), 1) i from t)",
    "v as (select ok, seq, i, try_cast(unnest(string_split(l, ',')) as bigint) v, generate_subscripts(string_split(l, ','), 1) p from m)",
    "g as (select *, case when v = lag(v::hugeint) over (partition by ok, seq, i order by p) + 1 then 0 else 1 end s from v)",
    "k as (select *, sum(s) over (partition by ok, seq, i order by p) k from g)",
    "r as (select ok, seq, i, k, min(v)::hugeint a, max(v)::hugeint b, bool_or(v is null) bad from k group by all)",
    "f1 as (select ok, seq, i, bool_or(bad) bad, '목록' || string_agg(case when a = b then a::varchar when b = a + 1 then a || ',' || b else a || '~' || b end, ',' order by k) f from r group by all)",
    "f as (select ok, seq, i, case when bad then '목록' || l else f end f from f1 join m using (ok, seq, i))",
    f"c as (select ok, seq, unnest(string_split_regex(t, {_LISTS})) x, generate_subscripts(string_split_regex(t, {_LISTS}), 1) i from t)",
) + "select c.ok, c.seq, string_agg(x || coalesce(f, ''), '' order by c.i) as value from c left join f using (ok, seq, i) group by c.ok, c.seq")
def w11_list_numbers(spark, sf):
    return load(spark, sf, "nf_notes").select("ok", "seq", F.expr(_W11.replace("TEXT", "STRING")).alias("t")).select("ok", "seq", X.shorten_list(c("t")).alias("value"))


column_query("p9_has_share", "nf_rows", K, lambda: X.has_share(c("detail_cell")), f"regexp_matches(detail_cell, '{'|'.join(R.SHARE_WORDS)}')")
column_query("a6_shares", "nf_rows", K, lambda: _join(X.shares(c("addr_cell"), c("detail_cell"))), Q.joined(Q.shares("addr_cell", "detail_cell")))
column_query("p7_alias", "nf_locs", K, lambda: places.resolve("out_use", "src_use"), "coalesce(nullif(out_use, ''), nullif(src_use, ''), '')")

# the parts of a location made again from its source, with the shares that it lacks
_PLACE = Q.merge_space(f"concat_ws(' ', {Q.normal_address(Q.province(Q.merge_space('addr_cell')))}, {Q.normal_address(Q.province(Q.strip_shares('detail_cell')))})")
_FALL = (f"fb as (select ok, seq, {_PLACE} a, {Q.shares('addr_cell', 'detail_cell')} sh, {Q.normal_use(Q.strip_shares('detail_cell'))} u from nf_rows)",)
_WITH = f"case when len(sh) = 0 or contains({Q.squeeze('a')}, sh[1]) then a else a || ' [' || sh[1] || ']' end"


@query("f21_from_source", Q.over("nf_rows", *_FALL) + f"select ok, seq, {_WITH} address, u use_ from fb")
def f21_from_source(spark, sf):
    return load(spark, sf, "nf_rows").withColumn("l", X.from_source(c("addr_cell"), c("detail_cell"))).select("ok", "seq", "l.address", F.col("l.use").alias("use_"))


# lines of address and detail, what the detail's first line says beyond the use, and the edit's suffixes at the last line
_DETAILS = f"list_transform(list_filter(list_transform({Q.lines('src_use')}, lambda l: {Q.strip_shares('l')}), lambda l: l <> ''), lambda l: {Q.normal_address('l')})"
_SUFFIXES = "regexp_extract_all(out_addr, '\\[[^\\[\\]]+\\]')"
_F20 = (
    f"d0 as (select ok, seq, out_addr, list_transform({Q.lines('src_addr')}, lambda l: {Q.normal_address('l')}) p, {_DETAILS} d, {Q.squeeze(Q.normal_use('out_use'))} u from nf_lines)",
    f"d1 as (select *, {Q.squeeze(Q.normal_address('d[1]'))} f from d0)",
    "d2 as (select *, p || case when u <> '' and len(d) > 0 and starts_with(f, u) then case when f = u then d[2:] else [substring(f, length(u) + 1)] || d[2:] end else d end a from d1)",
    f"d3 as (select *, list_reduce({_SUFFIXES}, lambda t, s: case when contains({Q.squeeze('a[-1]')}, {Q.squeeze('s')}) then t else {Q.strip(chr(39).join(['t || ', ' ', ' || s']))} end, a[-1]) z from d2)",
)


@query("f20_restore_lines", Q.over("nf_lines", *_F20) + f"select ok, seq, len(a) > 1 several, case when len(a) <= 1 then {Q.normal_address('out_addr')} else array_to_string(list_append(a[:-2], z), chr(10)) end as value from d3")
def f20_restore_lines(spark, sf):
    """Sources of one and more lines, uses that the detail starts with or doesn't, and edits with suffixes."""
    value = X.restore_lines(c("src_addr"), c("src_use"), c("out_addr"), c("out_use"))
    return load(spark, sf, "nf_lines").select("ok", "seq", value.contains("\n").alias("several"), value.alias("value"))


_WRAP = """case event_id % 7 when 0 then concat('```json', chr(10), props, chr(10), '```') when 1 then concat('Here: ', props, ' and more') when 2 then concat('cut ', substring(props, 1, length(props) - 1))
 when 3 then concat('x [', props, ', ', props, '] y ]') when 4 then concat('n [{"a":[', props, ',{"b":[]}],"k":7}] z}') when 5 then concat('s {"a":"}{[ \\\\" ]","k":', cast(event_id as TEXT), '} t') else 'none at all' end"""
_SCAN = (
    f"t as (select event_id, {_WRAP.replace('TEXT', 'VARCHAR').replace(chr(92) * 2, chr(92))} t from events)",
    "b as (select event_id, t, coalesce(regexp_extract(t, '```(?:json)?\\s*([\\s\\S]*?)```', 1), '') fenced, coalesce(regexp_extract(t, '[{\\[][\\s\\S]*'), '') body from t)",
    """sc as (select event_id, m, 0 i, 0 depth, false q, false e, false done from b, (values (false), (true)) v(m) where body <> ''
      union all select event_id, m, i + 1, depth + case when m and q then 0 when ch in ('{', '[') then 1 when ch in ('}', ']') then -1 else 0 end,
        case when m and ch = '"' and not e then not q else q end, m and q and ch = chr(92) and not e, not (m and q) and ch in ('}', ']') and depth = 1
      from (select s.*, substr(b.body, s.i + 1, 1) ch from sc s join b using (event_id) where not done and i < length(b.body)))""",
    "ends as (select event_id, m, max(i) n, bool_or(done) done from sc group by all)",
    "got as (select b.event_id, v.m, case when fenced <> '' then trim(fenced, chr(10) || ' ') when body = '' then t when done then left(body, n) else body end json, case when fenced <> '' then 'fenced' when body = '' then 'none' when done then 'balanced' else 'cut' end state from b cross join (values (false), (true)) v(m) left join ends e on e.event_id = b.event_id and e.m = v.m)",
    "ks as (select *, case when not json_valid(json) then null when json like '[%' then array_to_string(list_transform(cast(json_extract(json, '$[*].k') as varchar[]), lambda x: coalesce(x, '-')), '|') else coalesce(json_extract_string(json, '$.k'), '-') end k from got)",
)


def _scanned(spark, sf):
    t = load(spark, sf, "events").withColumn("t", F.expr(_WRAP.replace("TEXT", "STRING").replace("chr(10)", "'\\n'")))
    both = [t.select("event_id", F.lit(m).alias("m"), X.json_scan(c("t"), m).alias("s"), X.json_rows(c("t"), "k bigint", m).alias("r")) for m in (False, True)]
    return both[0].union(both[1]).select("event_id", "m", "s.json", "s.state", "r.rows", "r.error")


def _scan_sql(what: str) -> str:
    return "with recursive " + ", ".join(_SCAN) + " " + what


@query("f23_json_text", _scan_sql("select event_id, m, case when k is not null and state <> 'none' then json end as value, state, k from ks where k is not null"))
def f23_json_text(spark, sf):
    """Answers that can be read, by both ways of scanning; f23_quarantine has the others."""
    good, _ = logs.split_failures(_scanned(spark, sf), logs.shared_path(spark, "answers"))
    return good.select("event_id", "m", c("json").alias("value"), "state", _join(F.transform("rows", lambda x: F.coalesce(x["k"].cast("string"), F.lit("-")))).alias("k"))


@query("f23_quarantine", _scan_sql("select event_id, m, json, 'no JSON: ' || state as error from ks where k is null"))
def f23_quarantine(spark, sf):
    _, dead = logs.split_failures(_scanned(spark, sf), logs.shared_path(spark, "answers"))
    return dead.select("event_id", "m", "json", "error")


@query("f24_content_hash", """select conv_id rec, turn iter, md5('{"iter":' || turn || case when v is null then '' else ',"text":' || to_json(v) end || '}') h from (select *, case when turn % 3 = 0 then role || chr(10) || '"' || conv_id || '\\' || chr(9) else text end v from conversations)""")
def f24_content_hash(spark, sf):
    t = load(spark, sf, "conversations").withColumn("text", F.when(c("turn") % 3 == 0, F.concat("role", F.lit('\n"'), "conv_id", F.lit("\\\t"))).otherwise(c("text")))
    return t.select(c("conv_id").alias("rec"), c("turn").alias("iter"), c("text")).select("rec", "iter", history.content_hash("text", "iter").alias("h"))


@query("f25_event_json", """select event_id, '{"event":"progress","event_id":' || event_id || ',"user_id":' || user_id || '}' as value from events""")
def f25_event_json(spark, sf):
    return load(spark, sf, "events").select("event_id", history.event_json(F.lit("progress"), "event_id", "user_id").alias("value"))


@query("f29_dates", "select o_orderkey, cast(o_orderdate as date) - 14 publish_date, cast(o_orderdate as date) - 16 hand_over from orders")
def f29_dates(spark, sf):
    day = F.to_date("o_orderdate")
    return load(spark, sf, "orders").select("o_orderkey", F.date_sub(day, 14).alias("publish_date"), F.date_sub(day, 16).alias("hand_over"))


# ---- 2.1, 2.2, 2.4, 2.5 over rows ----
_SHAPE = "case when seq % 4 = 0 then [addr_cell, detail_cell] when seq % 7 = 0 then [case_cell, item_cell, use_cell, addr_cell, detail_cell, price_cell] else [case_cell, item_cell, use_cell, addr_cell, detail_cell, price_cell, note_cell] end"


@query("s3_rows_normalise", Q.over("nf_rows") + f"select doc_id, ok, seq, {', '.join(f'''case when seq % 4 = 0 then {x if x in ('addr_cell', 'detail_cell') else repr('')} else {Q.split_price(x) if x == 'price_cell' else x} end {x}''' for x in rows.CELLS)} from nf_rows where seq % 4 = 0 or seq % 7 <> 0")
def s3_rows_normalise(spark, sf):
    t = load(spark, sf, "nf_rows")
    shaped = F.when(c("seq") % 4 == 0, F.array("addr_cell", "detail_cell")).when(c("seq") % 7 == 0, F.array(*rows.CELLS[:-1])).otherwise(F.array(*rows.CELLS))
    return rows.rows_normalise(t.select("doc_id", "ok", "seq", shaped.alias("cells")))


_HEAD_CELLS = "case when seq = 7 then '사건번호' else case_cell end case_cell, item_cell, use_cell, case when seq = 7 then '매각물건' else addr_cell end addr_cell, detail_cell, price_cell, note_cell"


@query("p1_drop_headers", Q.over("nf_rows", f"h as (select ok, seq, {_HEAD_CELLS} from nf_rows)", f"t as (select *, concat_ws(' ', {', '.join(Q.CELLS)}) t from h)") + f"select ok, seq, item_cell from t where not ({Q._HEADER})")
def p1_drop_headers(spark, sf):
    t = load(spark, sf, "nf_rows").withColumn("case_cell", F.when(c("seq") == 7, "사건번호").otherwise(c("case_cell"))).withColumn("addr_cell", F.when(c("seq") == 7, "매각물건").otherwise(c("addr_cell")))
    return rows.drop_headers(t).select("ok", "seq", "item_cell")


@query("p10_tables", Q.over("nf_rows") + "select ok, seq, ok % 3 table_no, case when ok % 3 = 0 then 'header' else 'body' end part from nf_rows")
def p10_tables(spark, sf):
    t = load(spark, sf, "nf_rows").withColumn("table_no", c("ok") % 3)
    parts = rows.header_table(t).withColumn("part", F.lit("header")).unionByName(rows.body_tables(t).withColumn("part", F.lit("body")))
    return parts.select("ok", "seq", "table_no", "part")


def _records(spark, sf):
    return rows.assemble(rows.islands(rows.rows_normalise(rows.as_cells(load(spark, sf, "nf_rows", ("doc_id",))))))


@query("w2_islands", Q.over("nf_rows", *Q.ISLANDS) + 'select doc_id, ok, seq, cast(rec_no as bigint) rec_no, case_no, dup_tag, item_no, "use" use_ from isl')
def w2_islands(spark, sf):
    t = rows.islands(rows.rows_normalise(rows.as_cells(load(spark, sf, "nf_rows", ("doc_id",)))))
    return t.select("doc_id", "ok", "seq", "rec_no", "case_no", "dup_tag", "item_no", c("use").alias("use_"))


@query("a1_assemble", Q.over("nf_rows", *Q.RECORDS) + """select doc_id, rec_no, case_no, dup_tag, item_no, "use" use_, len(locations) n_locations, array_to_string(list_transform(locations, lambda l: l.addr || '/' || l.detail), '|') locations, coalesce(pl[1], '') price, coalesce(pl[2], pl[1], '') min_price, note from rec""")
def a1_assemble(spark, sf):
    t = _records(spark, sf)
    place = F.transform("locations", lambda x: F.concat_ws("/", x["addr"], x["detail"]))
    return t.select("doc_id", "rec_no", "case_no", "dup_tag", "item_no", c("use").alias("use_"), F.size("locations").cast("bigint").alias("n_locations"), _join(place).alias("locations"), "price", "min_price", "note")


@query("a13_assemble_text", Q.over("nf_rows") + f"select doc_id, string_agg(concat_ws(' | ', {', '.join(Q.CELLS)}), chr(10) order by ok, seq) text from nf_rows group by doc_id")
def a13_assemble_text(spark, sf):
    return rows.assemble_text(load(spark, sf, "nf_rows", ("doc_id",)))


@query("p8_quarantine", Q.over("nf_rows") + f"select ok, seq, case when px is null then {Q.lit(R.FAILED)} else addr_cell end address, case when px is null then '' else use_cell end use_, case when px is null then '편집 실패: ' || price_cell else note_cell end note, case when px is null then '기타' else '아파트' end grp from (select *, try_cast(price_cell as bigint) px from nf_rows)")
def p8_quarantine(spark, sf):
    return rows.placeholders(_failing(spark, sf)).withColumnRenamed("use", "use_")


def _failing(spark, sf):
    t = load(spark, sf, "nf_rows")
    return t.select("ok", "seq", c("addr_cell").alias("address"), c("use_cell").alias("use"), c("note_cell").alias("note"), F.lit("아파트").alias("grp"), F.when(c("price_cell").try_cast("bigint").isNull(), c("price_cell")).alias("error"))


_P8 = "select ok, seq, addr_cell address, use_cell use_, note_cell note, '아파트' grp{} from nf_rows where try_cast(price_cell as bigint) is {}"


@query("p8_good", Q.over("nf_rows") + _P8.format("", "not null"))
def p8_good(spark, sf):
    """The rows that didn't fail, as one run wrote them beside the dead letters."""
    return logs.split_failures(_failing(spark, sf), logs.shared_path(spark, "rows"))[0].withColumnRenamed("use", "use_")


@query("p8_dead_letters", Q.over("nf_rows") + _P8.format(", price_cell error", "null"))
def p8_dead_letters(spark, sf):
    return logs.split_failures(_failing(spark, sf), logs.shared_path(spark, "rows"))[1].withColumnRenamed("use", "use_")


def _floors_sql(source: str, keys: str, text: str) -> tuple[str, ...]:
    """floors(keys, value): a text is cut at its tokens; runs of equal area are gathered, and what follows the last token of each stays."""
    floor = Q.lit(spaced(R.FLOOR))
    return (
        f"cut as (select {keys}, {text} t, string_split(regexp_replace({text}, {floor}, chr(1) || '\\1' || chr(2) || '\\2' || chr(2), 'g'), chr(1)) l from {source})",
        f"tk as (select {keys}, i, split_part(t, chr(2), 1) f, split_part(t, chr(2), 2) a, split_part(t, chr(2), 3) rest from (select {keys}, unnest(l) t, generate_subscripts(l, 1) i from cut) where i > 1)",
        f"mk as (select *, case when a = lag(a) over (partition by {keys} order by i) then 0 else 1 end s from tk)",
        f"rn as (select *, sum(s) over (partition by {keys} order by i) r from mk)",
        f"gp as (select {keys}, r, any_value(a) a, count(*) n, list(f order by i) fs, list(f::bigint - i order by i) steps, min(f::bigint) lo, max(f::bigint) hi, arg_max(rest, i) rest from rn group by {keys}, r)",
        f"sh as (select {keys}, string_agg(case when n = 1 then fs[1] when n >= 3 and len(list_distinct(steps)) = 1 then lo || '~' || hi else array_to_string(fs, ',') end || case when n > 1 then '층각' else '층' end || a || '㎡' || rest, '' order by r) v from gp group by {keys})",
        f"floors as (select {keys}, case when len(l) < 3 then t else l[1] || v end as value from cut left join sh using ({keys}))",
    )


@query("w4_merge_floors", Q.over("nf_floors", *_floors_sql("nf_floors", "ok, seq", "text")) + "select ok, seq, value from floors")
def w4_merge_floors(spark, sf):
    return load(spark, sf, "nf_floors").select("ok", "seq", X.merge_floors(c("text")).alias("value"))


_NA = Q.normal_address("addr_cell")


@query("w1_ditto", Q.over("nf_rows", f"a as (select doc_id, ok, seq, {_NA} || ' ' a from nf_rows)", f"t as (select *, {Q.town('a')} tn, lag({Q.town('a')}) over (partition by doc_id, ok order by seq) before from a)") + f"select ok, seq, case when tn <> '' and tn = before then {Q.same_place('a')} else a end address from t")
def w1_ditto(spark, sf):
    t = load(spark, sf, "nf_rows").withColumn("address", F.concat(X.normal_address(c("addr_cell")), F.lit(" ")))
    return places.ditto(t, "address", ["doc_id", "ok"], ["seq"]).select("ok", "seq", "address")


_A8 = "concat(detail_cell, case (ok + seq) % 4 when 0 then concat(' 제시외 창고 10.5㎡ 다용도실 ', item_cell, '㎡') when 1 then concat(chr(10), '제시외-주택 벽돌조 단층 ', item_cell, '1.3㎡', chr(10), '-욕실·변소 조적조 2층 1.25㎡', chr(10), '-감나무 3주 -매실 ', item_cell, '주 압축기 2식') when 2 then ' 제시외 창고 7㎡' else '' end)"
_UN = Q.lit(R.UNREGISTERED)


@query("a8_unregistered", Q.over(
    "nf_rows",
    f"d as (select ok, seq, regexp_extract({_A8}, '(?s)제시외(.*)$', 1) d from nf_rows)",
    f"i as (select ok, seq, unnest(regexp_extract_all(d, {_UN}, 1)) nm, cast(unnest(regexp_extract_all(d, {_UN}, 2)) as decimal(18,4)) a, unnest(regexp_extract_all(d, {_UN}, 3)) unit, generate_subscripts(regexp_extract_all(d, {_UN}), 1) p from d)",
    "s as (select ok, seq, unit, count(*) n, sum(a) t, arg_min(nm, (length(nm), p)) nm from i group by ok, seq, unit)",
) + r"select ok, seq, unit, n, '제시외 ' || nm || '등' || regexp_replace(cast(t as varchar), '\.?0+$', '') || unit summary from s where n >= 2")
def a8_unregistered(spark, sf):
    return places.unregistered(load(spark, sf, "nf_rows").select("ok", "seq", F.expr(_A8).alias("d")), ["ok", "seq"], "d")


_HITS = {
    "province": (X.strip_province, "|".join(R.PROVINCES), Q.province, "addr_cell"),
    "materials": (X.strip_materials, "|".join(R.MATERIALS), Q.materials, "detail_cell"),
    "facility": (X.shorten_facility, R.FACILITY[2][0], Q.facility, "detail_cell"),
    "farmland": (X.shorten_farmland, "농지취득자격증명", Q.farmland, "note_cell"),
    "particles": (X.shorten_particles, R.PARTICLES[1][0], Q.particles, "note_cell"),
}


@query("a12_rule_hits", Q.over("nf_rows") + " union all ".join(f"select {Q.lit(n)} rule, cast(sum(case when {q(col)} <> {col} then 1 else 0 end) as bigint) rows_changed, cast(sum(len(regexp_extract_all({col}, {Q.lit(spaced(p))}))) as bigint) matches from nf_rows" for n, (_, p, q, col) in _HITS.items()))
def a12_rule_hits(spark, sf):
    t = load(spark, sf, "nf_rows")
    by_column: dict[str, dict] = {}
    for n, (f, p, _, col) in _HITS.items():
        by_column.setdefault(col, {})[n] = (f, p)
    out = None
    for col, packs in by_column.items():
        part = publish.rule_hits(t, col, packs)
        out = part if out is None else out.unionByName(part)
    return out


# ---- notes, locations ----
_RN, _EN = Q.normal_note("raw_note"), Q.normal_note("edit_note")
_LOST = " or ".join(f"(contains(r, {Q.lit(w)}) and not contains(e, {Q.lit(w)}))" for w in R.NOTE_GUARDS)


@query("p5_choose_note", Q.over("nf_notes", f"n as (select ok, seq, {_RN} r, {_EN} e from nf_notes)") + f"select ok, seq, case when r = '' then e when e = '' or length(e) < greatest(8, floor(length(r) * 0.65)) or {_LOST} then r else e end as value from n")
def p5_choose_note(spark, sf):
    return load(spark, sf, "nf_notes").select("ok", "seq", publish.choose_note(c("raw_note"), c("edit_note")).alias("value"))


@query("p6_restore_fields", Q.over("nf_notes") + "select ok, seq, coalesce(nullif(edit_note, ''), raw_note) note from nf_notes")
def p6_restore_fields(spark, sf):
    t = load(spark, sf, "nf_notes")
    return places.restore_fields(t.select("ok", "seq", c("edit_note").alias("note")), t.select("ok", "seq", c("raw_note").alias("note")), ["ok", "seq"], ["note"])


@query("j1_align", Q.over("nf_locs") + "select ok, cast(row_number() over (partition by ok order by seq) - 1 as int) pos, src_addr, out_addr from nf_locs")
def j1_align(spark, sf):
    in_order = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("seq", v))), lambda x: x[v])
    t = load(spark, sf, "nf_locs").groupBy("ok").agg(in_order("src_addr").alias("src_addr"), in_order("out_addr").alias("out_addr"))
    return places.align_by_place(t, "src_addr", "out_addr")


_HEADTXT = Q.strip(Q.head_before(Q.merge_space("src_use"), R.MATCH_MARKERS))
_MT = Q.merge_space(f"concat_ws(' ', src_addr, {_HEADTXT})")
_J2 = (
    f"l as (select ok, seq src, regexp_extract_all({_MT}, {Q.lit(R.LOT)}) t, {Q.strip('split_part(' + Q.province(Q.merge_space('src_addr')) + ', chr(40), 1)')} a from nf_locs)",
    f"r as (select ok, seq \"out\", {Q.merge_space('out_addr')} o, {Q.lots('out_addr')} ot from nf_locs)",
    'sc as (select l.ok, src, "out", len(list_filter(t, lambda x: list_contains(ot, x))) + case when a <> \'\' and contains(o, a) then 3 else 0 end score from l join r using (ok))',
)


@query("j2_best_match", Q.over("nf_locs", *_J2) + 'select ok, src, "out" out_, cast(score as int) score from sc qualify row_number() over (partition by ok, src order by score desc, "out") = 1')
def j2_best_match(spark, sf):
    t = load(spark, sf, "nf_locs")
    return places.best_match(t, t).withColumnRenamed("out", "out_")


# A7: shares go to their places in turn (a round a source location with shares), then all of them are looked for again
_SQUARE = "list_reduce({sh}, lambda a, x: case when x = '' or contains({squeezed}, x) or contains(a, '[' || x || ']') then a else {put} end, {address})"
_PUT = lambda sh, address: _SQUARE.format(sh=sh, address=address, squeezed=Q.squeeze("a"), put=Q.strip(f"{Q.rr('a', [(chr(92) + 's+$', '')])} || ' [' || x || ']'"))
_SCORES = lambda locs: f"list_transform({locs}, lambda o: len(list_filter(lots, lambda t: list_contains({Q.lots('o')}, t))) + case when place <> '' and contains(o, place) then 3 else 0 end)"
_AT = lambda scores: f"list_position({scores}, list_max({scores}))"
_A7 = (
    f"""l as (select ok, seq, {Q.shares('src_addr', 'src_use')} sh, regexp_extract_all({_MT}, {Q.lit(R.LOT)}) lots, {Q.strip('split_part(' + Q.province(Q.merge_space('src_addr')) + ', chr(40), 1)')} place,
 {_PLACE.replace('addr_cell', 'src_addr').replace('detail_cell', 'src_use')} again, {Q.normal_use(Q.strip_shares('src_use'))} again_use, {Q.normal_address('out_addr')} edited, {Q.normal_use('out_use')} edited_use, out_addr is not null kept from nf_shares)""",
    f"l1 as (select *, {_PUT('sh', 'again')} whole from l)",
    """base as (select ok, list(whole order by seq) fall, list(again_use order by seq) fall_use, list(edited order by seq) filter (where kept) edits, list(edited_use order by seq) filter (where kept) edits_use, count(*) n from l1 group by ok)""",
    "given as (select ok, fall, fall_use, case when len(edits) = n then edits else fall end locs, case when len(edits) = n then edits_use else fall_use end uses from base)",
    "needs as (select ok, sh, lots, place, row_number() over (partition by ok order by seq) k from l where len(sh) > 0)",
    f"""st as (select ok, cast(0 as bigint) k, locs, cast([] as bigint[]) met from given union all
 select ok, k, list_transform(locs, lambda o, i: case when i = target then {_PUT('sh', 'o')} else o end), list_append(met, target) from (
 select ok, k, locs, met, sh, cast({_AT('scores')} as bigint) target from (select st.ok, needs.k, locs, met, sh, {_SCORES('locs')} scores from st join needs on needs.ok = st.ok and needs.k = st.k + 1)))""",
    "ended as (select ok, locs, met, k from st qualify row_number() over (partition by ok order by k desc) = 1)",
    f"""looked as (select ok, bool_and(len(list_filter(sh, lambda x: not contains({Q.squeeze('held')}, x))) = 0) there from (select ok, sh, locs[{_AT('scores')}] held from (select e.ok, sh, locs, {_SCORES('locs')} scores from ended e join needs using (ok))) group by ok)""",
    "judged as (select g.ok, len(list_distinct(met)) = k and coalesce(there, true) good, e.locs, uses, fall, fall_use from given g join ended e using (ok) left join looked using (ok))",
    "chosen as (select ok, good, unnest(case when good then locs else fall end) a, unnest(case when good then uses else fall_use end) u, unnest(range(1, len(fall) + 1)) pos from judged)",
    f"towns as (select *, {Q.town('a')} tn, lag({Q.town('a')}) over (partition by ok order by pos) before from chosen)",
)


@query("a7_enforce", Q.over("nf_shares", *_A7, recursive=True) + f"select ok, not any_value(good) rebuilt, cast(count(*) as int) n, string_agg(case when tn <> '' and tn = before then {Q.same_place('a')} else a end, '|' order by pos) addresses, string_agg(u, '|' order by pos) uses from towns group by ok")
def a7_enforce(spark, sf):
    """Records whose edits lack shares, name one place twice, or miss a location, next to whole ones."""
    in_order = lambda loc: F.transform(F.sort_array(F.collect_list(F.when(F.col(loc).isNotNull(), F.struct("seq", loc)))), lambda x: x[loc])
    t = places.prepare(load(spark, sf, "nf_shares")).groupBy("ok").agg(in_order("source").alias("src_locs"), in_order("edited").alias("out_locs"))
    parts = lambda f: _join(F.transform("locations", lambda x: x[f]))
    return places.enforce(t).select("ok", "rebuilt", F.size("locations").alias("n"), parts("address").alias("addresses"), parts("use").alias("uses"))


# ---- groups ----
@query("p3_whitelist", Q.over("nf_pred") + f"select doc_id, case_no, seq, case when {Q.in_groups('pred_grp', (R.EXCLUDED,))} then pred_grp else '기타' end a, case when {Q.in_groups('pred_grp')} then pred_grp else '기타' end b from nf_pred")
def p3_whitelist(spark, sf):
    return load(spark, sf, "nf_pred").select("doc_id", "case_no", "seq", publish.whitelist(c("pred_grp")).alias("a"), publish.whitelist(c("pred_grp"), False).alias("b"))


@query("a2_case_majority", Q.over("nf_pred", "n as (select doc_id, case_no, pred_grp, count(*) n, min(seq) f from nf_pred group by all)", "w as (select doc_id, case_no, pred_grp grp from n qualify row_number() over (partition by doc_id, case_no order by pred_grp in ('기타', '게재제외'), n desc, f) = 1)") + "select p.doc_id, p.case_no, p.seq, w.grp from nf_pred p join w using (doc_id, case_no)")
def a2_case_majority(spark, sf):
    t = load(spark, sf, "nf_pred", ("doc_id", "case_no")).withColumn("grp", c("pred_grp"))
    return publish.case_majority(t).select("doc_id", "case_no", "seq", "grp")


_F30 = (*Q.ISLANDS, "ct as (select doc_id, case_no, use_cell || ' ' || detail_cell || ' ' || note_cell as text from isl)", Q.flags_sql("ct"))


def _classified(spark, sf):
    t = rows.islands(rows.rows_normalise(rows.as_cells(load(spark, sf, "nf_rows", ("doc_id",)))))
    return publish.classify(t.select("doc_id", "case_no", F.concat_ws(" ", "use_cell", "detail_cell", "note_cell").alias("text")))


@query("f30_classify", Q.over("nf_rows", *_F30) + "select doc_id, case_no, grp from cls")
def f30_classify(spark, sf):
    return _classified(spark, sf)


def _flagged(spark, sf, table):
    """Rows of islands with their flags, which are found before rows are gathered, as a number; and what is a vehicle's."""
    t = rows.islands(rows.rows_normalise(rows.as_cells(load(spark, sf, table, ("doc_id",)))))
    return publish.parts(t.withColumn("_flags", publish.flags(F.concat_ws(" ", "use_cell", "detail_cell", "note_cell"))))


def _sums():
    return [F.bit_or("_flags").alias("_any"), F.bit_and("_flags").alias("_all")]


_ESTATE = "|".join((R.FACTORIES, R.FIELDS, R.HOUSES, R.FLATS, R.ROWS, R.SHOPS, R.LODGINGS, R.LANDS))
_MIXED = (
    *(x.replace("from nf_rows", "from nf_mixed") for x in Q.ISLANDS),
    "tx as (select *, use_cell || ' ' || detail_cell || ' ' || note_cell as text from isl)",
    f"kd as (select *, case when regexp_matches(text, {Q.lit(_ESTATE)}) then 0 when regexp_matches(text, {Q.lit(R.VEHICLES)}) then 1 end k from tx)",
    "pt as (select *, coalesce(last_value(k ignore nulls) over (partition by doc_id, rec_no order by ok, seq rows between unbounded preceding and current row), 0) = 1 vehicle from kd)",
    "es as (select * from pt where not vehicle)", Q.flags_sql("es"),
    "rp as (select doc_id, rec_no, vehicle, any_value(case_no) case_no, any_value(item_no) item_no, cast(count(*) filter (where is_case or addr_cell <> '' or detail_cell <> '') as int) n from pt group by doc_id, rec_no, vehicle)",
)


@query("f30_mixed", Q.over("nf_mixed", *_MIXED) + f"select r.doc_id, cast(rec_no as bigint) rec_no, vehicle, r.case_no, item_no, n, case when vehicle then {Q.lit(R.EXCLUDED)} else grp end grp from rp r left join cls c on r.doc_id = c.doc_id and r.case_no = c.case_no")
def f30_mixed(spark, sf):
    """Records of cases that hold vehicles and real estate: the vehicles' rows leave as records of their own, the rest is classed without them."""
    records = rows.assemble(_flagged(spark, sf, "nf_mixed"), also=_sums(), by=("vehicle",))
    return publish.classify_records(records, vehicle="vehicle").select("doc_id", "rec_no", "vehicle", "case_no", "item_no", F.size("locations").alias("n"), "grp")


_PUB = (
    *Q.RECORDS, "ct as (select doc_id, case_no, use_cell || ' ' || detail_cell || ' ' || note_cell as text from isl)", Q.flags_sql("ct"),
    f"loc0 as (select doc_id, rec_no, unnest(locations) l, generate_subscripts(locations, 1) - 1 pos from rec)",
    f"loc9 as (select doc_id, rec_no, pos, {Q.strip(Q.notation(Q.province(Q.merge_lines('l.addr'))))} p, {Q.notation(Q.facility(Q.materials(Q.province(Q.merge_lines('l.detail')))))} d from loc0)",
    *_floors_sql("loc9", "doc_id, rec_no, pos", "d"),
    f"loc8 as (select doc_id, rec_no, pos, p, {_split_sql('v')} s from (select doc_id, rec_no, pos, p, {Q.strip('value')} v from loc9 join floors using (doc_id, rec_no, pos)))",
    f"loc1 as (select doc_id, rec_no, pos, {Q.strip('''p || ' ' || ''' + Q.strip('''substring(s, position('|' in s) + 1)'''))} a, split_part(s, '|', 1) u from loc8)",
    f"loc2 as (select *, {Q.town('a')} tn, lag({Q.town('a')}) over (partition by doc_id, rec_no order by pos) before from loc1)",
    f"loc3 as (select doc_id, rec_no, pos, case when tn <> '' and tn = before then {Q.same_place('a')} else a end address, u from loc2)",
)
_LINES = lambda x: f"greatest(ceil(length({x}) / 30.0), 1)"
_TAGS = (
    f"nn as (select doc_id, rec_no, dup_tag, {Q.normal_note('note')} nt from rec)",
    f"hi as (select doc_id, rec_no, sum({_LINES('address')}) h from loc3 group by doc_id, rec_no)",
    f"tg as (select nn.doc_id, nn.rec_no, dup_tag, nt, coalesce(dup_tag, '') <> '' and greatest(coalesce(h, 0), case when nt = '' then 0 else {_LINES('nt')} end) <= 4 moves from nn left join hi on nn.doc_id = hi.doc_id and nn.rec_no = hi.rec_no)",
    "tp as (select doc_id, rec_no, moves, case when moves then '' else dup_tag end tag_cell, case when moves then dup_tag || case when nt = '' then '' else '.' || nt end else nt end note_text from tg)",
)
#: O1. A record's place in its document and group, by natural order of case and item.
_PLACED = f"rk as (select r.doc_id, r.rec_no, cast(row_number() over (partition by r.doc_id, c.grp order by cast(split_part(r.case_no, '타경', 1) as int), cast(split_part(r.case_no, '타경', 2) as bigint), cast(item_no as int), r.rec_no) as int) as \"rank\" from rec r join cls c on r.doc_id = c.doc_id and r.case_no = c.case_no where {Q.in_groups('c.grp')})"
_ORDER = "case c.grp " + " ".join(f"when {Q.lit(g)} then {i + 1}" for i, g in enumerate(R.GROUPS)) + " end"


_LOCATED = {"town": "town", "rest": "rest", "use": "place_use"}


def _addressed(rows_, **more):
    """Rows of islands to records after all rules of locations and notes; places of one town after the other are written once. Rules of locations are of rows, and go before these are gathered."""
    records = places.ditto_locations(rows.assemble(X.located(rows_), fields=_LOCATED, **more))
    return X.staged(records, {"note": (X.text(c("note")), X.normal_note_steps())})


@query("published_table", Q.over("nf_rows", *_PUB, *_TAGS, _PLACED) + f"""select r.doc_id, r.rec_no, k."rank", c.grp, cast({_ORDER} as bigint) group_order, cast(l.pos as int) pos,
 case when l.pos = 0 then r.case_no || case when t.tag_cell <> '' then chr(10) || t.tag_cell else '' end else '' end case_cell, case when l.pos = 0 then r.item_no else '' end item_cell, l.address, l.u use_cell,
 case when l.pos = 0 then coalesce(pl[1], '') || case when coalesce(pl[2], pl[1], '') <> '' then chr(10) || coalesce(pl[2], pl[1]) else '' end else '' end price_cell, case when l.pos = 0 then t.note_text else '' end note_cell
 from rec r join loc3 l using (doc_id, rec_no) join tp t using (doc_id, rec_no) join rk k using (doc_id, rec_no) join cls c on r.doc_id = c.doc_id and r.case_no = c.case_no where {Q.in_groups('c.grp')}""")
def published_table(spark, sf):
    """Rows to records, all rules of locations and notes, ditto, tags by lines, classes by rule, natural order in each document and group, published form. The rows are read and dealt out once, by document: islands, records and the flags of cases share the partitioning."""
    records = _addressed(_flagged(spark, sf, "nf_rows"), also=_sums(), by=("vehicle",))
    records = publish.publishable(publish.classify_records(records, vehicle="vehicle"))
    records = publish.natural_rank(publish.place_tags(records), ["doc_id", "grp"], ["case_no", "item_no"], ["rec_no"])
    return publish.published(records, ("doc_id", "rec_no", "rank"))


@query("f16_place_tags", Q.over("nf_rows", *_PUB, *_TAGS) + "select doc_id, rec_no, moves, tag_cell, note_text from tp")
def f16_place_tags(spark, sf):
    """Every record's tag and note, after tags went to the notes of records of at most four lines."""
    records = _addressed(rows.islands(rows.rows_normalise(rows.as_cells(load(spark, sf, "nf_rows", ("doc_id",))))))
    records = publish.place_tags(records.withColumn("_before", c("dup_tag")))
    return records.select("doc_id", "rec_no", ((c("_before") != "") & (c("dup_tag") == "")).alias("moves"), c("dup_tag").alias("tag_cell"), c("note").alias("note_text"))


@query("p2_publishable", Q.over("nf_pred") + f"select doc_id, case_no, seq, pred_grp grp from nf_pred where {Q.in_groups('pred_grp')}")
def p2_publishable(spark, sf):
    return publish.publishable(load(spark, sf, "nf_pred").withColumn("grp", c("pred_grp"))).select("doc_id", "case_no", "seq", "grp")


@query("o4_group_order", Q.over("nf_pred") + f"select doc_id, case_no, seq, cast(coalesce(list_position([{', '.join(map(Q.lit, R.GROUPS))}], pred_grp), 0) as bigint) o from nf_pred")
def o4_group_order(spark, sf):
    return load(spark, sf, "nf_pred").select("doc_id", "case_no", "seq", publish.group_order(c("pred_grp")).alias("o"))


@query("o1_natural_order", Q.over("nf_pred") + "select doc_id, case_no, item_no, seq, row_number() over (partition by doc_id order by cast(split_part(case_no, '타경', 1) as int), cast(split_part(case_no, '타경', 2) as bigint), cast(item_no as int), seq) as rank from nf_pred")
def o1_natural_order(spark, sf):
    t = publish.natural_rank(load(spark, sf, "nf_pred", ("doc_id",)), ["doc_id"], ["case_no", "item_no"], ["seq"])
    return t.select("doc_id", "case_no", "item_no", "seq", F.col("rank").cast("bigint").alias("rank"))


# ---- truth and measurement ----
_HW = Q.lit(truth._HEADER)


@query("p11_header_words", Q.over("nf_words") + f"select word_no, nullif(regexp_extract({Q.strip('text')}, {_HW}, 1), '') grp from nf_words")
def p11_header_words(spark, sf):
    return load(spark, sf, "nf_words").select("word_no", truth.header_group(c("text")).alias("grp"))


_STITCH = (
    r"inl as (select doc_id, page, word_no, top, x0, text case_no, 'inline' source from nf_words where regexp_matches(text, '^\d{4}타경\d+$'))",
    r"hl as (select doc_id, page, list({'no': word_no, 't': top, 'x': x0, 'y': substring(text, 1, 4)} order by word_no) hs from nf_words where regexp_matches(text, '^\d{4}타경$') group by doc_id, page)",
    r"nl as (select doc_id, page, list({'no': word_no, 't': top, 'x': x0, 'num': text} order by word_no) ns from nf_words where regexp_matches(text, '^\d+$') group by doc_id, page)",
    # one prefix of a page after the other, with the numbers taken so far
    """st as (select doc_id, page, 0 k, cast([] as bigint[]) used, cast(null as bigint) pick, hs, ns from hl join nl using (doc_id, page)
 union all select doc_id, page, k + 1, case when p is null then used else list_append(used, p) end, p, hs, ns from (
  select *, list_sort(list_transform(list_filter(free, lambda n: n.t - h.t > 0 and n.t - h.t <= 30 and abs(n.x - h.x) <= 60 and (stop is null or n.no < stop)), lambda n: {'dy': n.t - h.t, 'no': n.no}))[1].no p from (
   select *, list_filter(free, lambda n: n.t - h.t > 30)[1].no stop from (
    select *, list_filter(ns, lambda n: n.no > h.no and not list_contains(used, n.no)) free from (select *, hs[k + 1] h from st where k < len(hs))))))""",
    "wd as (select doc_id, page, hs[k].no word_no, hs[k].t top, hs[k].x x0, hs[k].y || '타경' || list_filter(ns, lambda n: n.no = pick)[1].num case_no, 'prefix' source from st where pick is not null union all select * from inl)",
)


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@query("j5_stitched", _recursive(Q.over("nf_words", *_STITCH)) + "select doc_id, page, word_no, top, x0, case_no, source from wd")
def j5_stitched(spark, sf):
    return truth.stitched(load(spark, sf, "nf_words", ("doc_id", "page")))


_TB = r"select cast(floor(ok / 2000) as int) doc_id, cast(floor(ok / 100) as int) page, cast(seq as bigint) word_no, cast(ok * 7 % 400 as double) top, cast(ok * 37 % 500 as double) x0, regexp_extract(case_cell, '\d{4}타경\d+') case_no, 'table' source from nf_rows where ok % 5 <> 0 and regexp_matches(case_cell, '\d{4}타경\d+')"


def _tables(spark, sf):
    """Tables on the pages of the words, all over the page."""
    t = load(spark, sf, "nf_rows")
    whole, place = (lambda n: F.floor(c("ok") / n).cast("int")), (lambda n, size: (c("ok") * n % size).cast("double"))
    return t.select(whole(2000).alias("doc_id"), whole(100).alias("page"), c("ok").alias("table_no"), c("seq").cast("long").alias("row_no"), F.when((c("ok") % 5 == 0) & (c("seq") == 1), "사건번호").otherwise(c("case_cell")).alias("cell"), place(7, 400).alias("top"), place(37, 500).alias("x0"))


@query("p12_table_cases", Q.over("nf_rows") + _TB)
def p12_table_cases(spark, sf):
    return truth.table_cases(_tables(spark, sf))


def _whole(spark, sf):
    """Candidates of words, stitched ones among them, and of tables."""
    words = load(spark, sf, "nf_words", ("doc_id", "page"))
    return words, truth.candidates(truth.stitched(words), truth.table_cases(_tables(spark, sf)))


_CAND = (*Q.chain("nf_rows", "duckdb"), *_STITCH, f"tb as ({_TB})", "cand as (select *, 0 src_order from wd union all select *, 1 from tb)", "top1 as (select doc_id, page, case_no, top, x0, source from cand qualify row_number() over (partition by doc_id, page, case_no order by top, src_order, word_no, x0) = 1)")
_ASSIGN = (
    *_CAND,
    f"gh as (select doc_id, page, top gtop, x0 gx0, regexp_extract({Q.strip('text')}, {_HW}, 1) grp from nf_words where regexp_matches({Q.strip('text')}, {_HW}))",
    "ab as (select c.doc_id, c.page, c.case_no, coalesce(arg_min(g.grp, (c.top - gtop, g.grp)) filter (where abs(gx0 - c.x0) <= 100), arg_min(g.grp, (c.top - gtop, g.grp))) own from top1 c join gh g on c.doc_id = g.doc_id and c.page = g.page and gtop <= c.top group by 1, 2, 3)",
    "asg as (select c.*, coalesce(last_value(own ignore nulls) over (partition by c.doc_id order by c.page, c.top, c.x0, c.case_no rows between unbounded preceding and current row), '기타') grp from top1 c left join ab using (doc_id, page, case_no))",
)


@query("u1_candidates", _recursive(Q.over("nf_words", *_CAND)) + "select doc_id, page, word_no, top, x0, case_no, source, src_order from cand")
def u1_candidates(spark, sf):
    return _whole(spark, sf)[1]


@query("w10_topmost", _recursive(Q.over("nf_words", *_CAND)) + "select * from top1")
def w10_topmost(spark, sf):
    return truth.topmost(_whole(spark, sf)[1])


def _assigned(spark, sf):
    words, found = _whole(spark, sf)
    return words, truth.assign_groups(truth.topmost(found), truth.group_headers(words))


@query("j4_w5_assign_groups", _recursive(Q.over("nf_words", *_ASSIGN)) + "select doc_id, page, case_no, top, x0, source, grp from asg")
def j4_w5_assign_groups(spark, sf):
    return _assigned(spark, sf)[1].select("doc_id", "page", "case_no", "top", "x0", "source", "grp")


@query("a5_cases_by_group", _recursive(Q.over("nf_words", *_ASSIGN, "f as (select doc_id, grp, case_no, min((page, top, x0)) m from asg group by 1, 2, 3)")) + "select doc_id, grp, string_agg(case_no, '|' order by m, case_no) cases from f group by 1, 2")
def a5_cases_by_group(spark, sf):
    return truth.cases_by_group(_assigned(spark, sf)[1]).withColumn("cases", _join("cases"))


@query("a10_self_check", _recursive(Q.over("nf_words", *_ASSIGN, r"said as (select distinct doc_id, regexp_extract(text, '\d{4}타경\d+') case_no from nf_words where regexp_matches(text, '\d{4}타경\d+'))", "got as (select distinct doc_id, case_no from asg)")) + "select doc_id, count(s.case_no) in_text, count(g.case_no) extracted, count(*) - count(g.case_no) missing, count(*) - count(s.case_no) as unknown, bool_and(s.case_no is not null and g.case_no is not null) passed from (select doc_id, case_no from said union select doc_id, case_no from got) a left join said s using (doc_id, case_no) left join got g using (doc_id, case_no) group by doc_id")
def a10_self_check(spark, sf):
    return truth.self_check(*_assigned(spark, sf))


@query("o3_reading_order", Q.over("nf_words") + "select doc_id, page, word_no, row_number() over (partition by doc_id, page order by top, x0, word_no) r from nf_words")
def o3_reading_order(spark, sf):
    w = Window.partitionBy("doc_id", "page").orderBy("top", "x0", "word_no")
    return truth.reading_order(load(spark, sf, "nf_words")).select("doc_id", "page", "word_no", F.row_number().over(w).cast("bigint").alias("r"))


_W12 = (
    "pt as (select doc_id, string_agg(text, ' ' order by page, top, x0, word_no) t from nf_words group by doc_id)",
    f"sp as (select doc_id, unnest(string_split(regexp_replace(t, {Q.lit('\\[(' + '|'.join(R.GROUPS) + ')\\]')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))) s, generate_subscripts(string_split(regexp_replace(t, {Q.lit('\\[(' + '|'.join(R.GROUPS) + ')\\]')}, chr(1) || '\\1' || chr(2), 'g'), chr(1)), 1) - 1 section from pt)",
    f"cs as (select doc_id, section, split_part(s, chr(2), 1) grp, unnest(l) case_no, generate_subscripts(l, 1) - 1 a from (select *, {Q.case_numbers('split_part(s, chr(2), 2)')} l from sp where section > 0))",
)


@query("w12_sections", Q.over("nf_words", *_W12) + "select doc_id, cast(section as int) section, grp, case_no, cast(min(a) as int) as at from cs group by 1, 2, 3, 4")
def w12_sections(spark, sf):
    t = load(spark, sf, "nf_words", ("doc_id",)).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "top", "x0", "word_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    return truth.sections(t)


_OURS, _TRUE = "select distinct doc_id, pred_grp grp, case_no from nf_pred", "select distinct doc_id, truth_grp grp, case_no from nf_pred"
_CMP = (f"o as ({_OURS})", f"t as ({_TRUE})", "cmp as (select doc_id, grp, case_no, case when o.x is null then 'missing' when t.x is null then 'extra' else 'match' end verdict from (select *, 1 x from o) o full join (select *, 1 x from t) t using (doc_id, grp, case_no))")


def _sides(spark, sf):
    t = load(spark, sf, "nf_pred", ("doc_id", "case_no"))
    return t.select("doc_id", c("pred_grp").alias("grp"), "case_no").distinct(), t.select("doc_id", c("truth_grp").alias("grp"), "case_no").distinct()


@query("j6_compare", Q.over("nf_pred", *_CMP) + "select * from cmp")
def j6_compare(spark, sf):
    return truth.compare(*_sides(spark, sf))


@query("u2_differences", Q.over("nf_pred", *_CMP) + "select doc_id, grp, case_no, verdict side from cmp where verdict <> 'match'")
def u2_differences(spark, sf):
    return truth.both_differences(*_sides(spark, sf))


@query("u3_intersection", Q.over("nf_pred", *_CMP) + "select doc_id, grp, case_no from cmp where verdict = 'match'")
def u3_intersection(spark, sf):
    ours, real = _sides(spark, sf)
    return ours.intersect(real)


@query("a4_accuracy", Q.over("nf_pred", *_CMP, f"k as (select doc_id, sum(case when verdict <> 'extra' then 1 else 0 end) truth_total, sum(case when verdict = 'match' then 1 else 0 end) matched from cmp where {Q.in_groups('grp')} group by 1)", f"p as (select doc_id, sum(case when {Q.in_groups('pred_grp')} then 1 else 0 end) ours, sum(case when pred_grp = '게재제외' then 1 else 0 end) excluded from nf_pred group by 1)", "e as (select distinct doc_id, 1 failed from nf_pred where case_no like '%77')", "b as (select doc_id, case when failed is null then truth_total else 0 end truth_total, case when failed is null then matched else 0 end matched, case when failed is null then ours else 0 end ours, case when failed is null then excluded else 0 end excluded, failed from k full join p using (doc_id) full join e using (doc_id))", "s as (select doc_id, cast(coalesce(sum(truth_total), 0) as bigint) truth_total, cast(coalesce(sum(matched), 0) as bigint) matched, cast(coalesce(sum(ours), 0) as bigint) ours, cast(coalesce(sum(excluded), 0) as bigint) excluded, cast(coalesce(sum(failed), 0) as bigint) failed from b group by rollup (doc_id))") + "select *, case when truth_total > 0 then round(matched / truth_total * 100, 1) else 0.0::double end rate from s")
def a4_accuracy(spark, sf):
    ours, real = _sides(spark, sf)
    published = load(spark, sf, "nf_pred").withColumn("grp", c("pred_grp"))
    # documents that hold such a case count as not measured
    errors = published.filter("case_no like '%77'").select("doc_id", F.lit("unreadable").alias("error"))
    return truth.accuracy(truth.compare(ours, real), published, errors).drop("is_total")


# ---- review ----
def _patched(spark, sf):
    t = load(spark, sf, "nf_patch")
    place = lambda a, u: F.array(F.struct(a.alias("address"), u.alias("use")))
    records = t.select("job_id", "idx", "grp", F.lit("").alias("note"), F.concat(F.lit("c"), c("idx").cast("string")).alias("case_no"), place(c("grp"), F.lit("대")).alias("locations"))
    field = lambda name, value, at: t.select("job_id", "idx", F.lit(at).alias("at"), F.lit(name).alias("field"), value.alias("value"))
    edits = field("note", c("new_note"), 2).filter("value is not null").unionByName(field("note", F.lit("earlier"), 1).filter("idx % 2 = 0")).unionByName(field("grp", F.lit("x"), 1))
    changes = t.filter("new_grp is not null").select("job_id", "idx", F.lit(2).alias("at"), "new_grp").unionByName(t.filter("idx % 4 = 0").select("job_id", "idx", F.lit(1).alias("at"), F.lit(R.OTHER).alias("new_grp")))
    places_ = t.filter("idx % 3 = 0").select("job_id", "idx", F.lit(1).alias("at"), place(c("new_note"), F.lit(None).cast("string")).alias("locations"))
    return t, review.patch(records, changes, edits, places_)


_VALID = Q.in_groups("new_grp", (R.EXCLUDED,))
_PATCHED = f"pt as (select job_id, idx, grp old_grp, case when {_VALID} then new_grp when idx % 4 = 0 then '기타' else grp end grp, coalesce(new_note, case when idx % 2 = 0 then 'earlier' else '' end) note, case when idx % 3 = 0 then coalesce(new_note, '') || '/' else grp || '/대' end locations from nf_patch)"


@query("j7_patch", Q.over("nf_patch", _PATCHED) + "select job_id, idx, grp, note, 'c' || idx case_no, old_grp, locations from pt")
def j7_patch(spark, sf):
    return _patched(spark, sf)[1].withColumn("locations", _join(F.transform("locations", lambda x: F.concat_ws("/", x["address"], x["use"]))))


@query("f26_corrections", Q.over("nf_patch", _PATCHED) + "select job_id, idx, 'c' || idx case_no, note, old_grp original_group, grp \"group\", note signature_text, locations from pt where grp <> old_grp")
def f26_corrections(spark, sf):
    found = review.corrections(_patched(spark, sf)[1], c("note"), F.current_timestamp()).drop("timestamp")
    return found.withColumn("locations", _join(F.transform("locations", lambda x: F.concat_ws("/", x["address"], x["use"]))))


@query("j8_delete", Q.over("nf_patch") + "select job_id, idx, grp from nf_patch where not deleted")
def j8_delete(spark, sf):
    t = load(spark, sf, "nf_patch")
    gone = t.filter("deleted").select("job_id", c("idx").cast("string").alias("idx")).unionByName(t.filter("idx = 0").select("job_id", F.lit("none").alias("idx")))
    return review.delete(t.select("job_id", "idx", "grp"), gone)


@query("o2_explicit_order", Q.over("nf_patch") + "select job_id, idx, row_number() over (partition by job_id order by order_key is null, order_key, idx) as rank from nf_patch")
def o2_explicit_order(spark, sf):
    t = load(spark, sf, "nf_patch")
    order = t.filter("order_key is not null").select("job_id", "idx", c("order_key").alias("pos"))
    return review.explicit_order(t.select("job_id", "idx"), order).withColumn("rank", F.col("rank").cast("bigint"))


_J3 = (
    f"ex as (select seq, case_no, grp, signature_text, {Q.keywords('signature_text')} e from (select * from nf_corrections order by seq desc limit 200) x)",
    f"tg as (select doc_id, {Q.keywords('text')} t from documents)",
    "ov as (select doc_id, seq, count(*) o from (select doc_id, unnest(t) w from tg) a join (select seq, unnest(e) w from ex) b using (w) group by 1, 2)",
    "pr as (select doc_id, seq, case_no, grp, signature_text, o, len(t) nt, len(e) ne from ov join tg using (doc_id) join ex using (seq))",
    "sm as (select doc_id, seq, case_no, grp, signature_text, row_number() over (partition by doc_id order by cast(o as double) / (nt + ne - o) desc, seq) as rank from pr qualify rank <= 3)",
)


def _similar(spark, sf):
    targets = load(spark, sf, "documents").select("doc_id", "text")
    return review.similar(targets, load(spark, sf, "nf_corrections"), "doc_id", "text")


@query("j3_w6_similar", Q.over("nf_corrections", *_J3) + "select doc_id, seq, case_no, grp, cast(rank as bigint) as rank from sm")
def j3_w6_similar(spark, sf):
    return _similar(spark, sf).select("doc_id", "seq", "case_no", "grp", F.col("rank").cast("bigint").alias("rank"))


@query("f27_examples", Q.over("nf_corrections", *_J3) + """select doc_id, '[사용자 검수로 학습된 분류 예시]' || chr(10) || string_agg(rank || '. 사건: ' || case_no || ' → group="' || grp || '"' || chr(10) || '   특징: ' || replace(substring(signature_text, 1, 200), chr(10), ' '), chr(10) order by rank) || chr(10) || '위 예시와 패턴이 비슷하면 같은 group으로 분류한다.' || chr(10) block from sm group by doc_id""")
def f27_examples(spark, sf):
    return review.examples_text(_similar(spark, sf), "doc_id")


@query("w7_last_n", Q.over("nf_corrections") + "select seq, grp from nf_corrections order by seq desc limit 50")
def w7_last_n(spark, sf):
    return review.last_n(load(spark, sf, "nf_corrections"), 50).select("seq", "grp")


@query("a3_group_counts", Q.over("nf_corrections") + "select grp, count(*) n, array_to_string(list_sort(list(distinct case_no)), '|') cases from nf_corrections group by grp")
def a3_group_counts(spark, sf):
    return review.group_counts(load(spark, sf, "nf_corrections")).withColumn("cases", _join("cases"))


@query("s4_parse_log", Q.over("nf_corrections") + "select seq, case_no, grp from (select * from nf_corrections order by seq desc limit 200) x where seq % 15 <> 0 and seq % 35 <> 0")
def s4_parse_log(spark, sf):
    t = load(spark, sf, "nf_corrections")
    line = F.when(c("seq") % 15 == 0, "  ").when(c("seq") % 35 == 0, '{"seq": 1, "case').otherwise(F.to_json(F.struct("seq", "case_no", "grp", "signature_text")))
    return logs.parse_log(t.select("seq", line.alias("line"))).select("seq", "case_no", "grp")


@query("s5_append_log", Q.over("nf_corrections") + "select seq, case_no, grp from nf_corrections")
def s5_append_log(spark, sf):
    log, path = load(spark, sf, "nf_corrections"), logs.shared_path(spark, "corrections")
    logs.append_corrections(log.filter("seq % 2 = 0"), path)
    logs.append_corrections(log.filter("seq % 2 <> 0"), path)
    return logs.read_log(spark, path).select("seq", "case_no", "grp")


@query("s6_results", Q.over("nf_rows", *Q.RECORDS) + """select rec_no, case_no, item_no, "use" use_, len(locations) n, case when doc_id % 3 = 0 then '검수 ' || note else note end note, doc_id job_id
 from rec where doc_id % 5 <> 1 and (doc_id % 3 <> 0 or rec_no % 2 = 1)""")
def s6_results(spark, sf):
    """All jobs written, then the reviewed ones again with fewer records, then some emptied; what holds for each job is read back."""
    records, path = _records(spark, sf).withColumnRenamed("doc_id", "job_id").drop("price_value"), logs.shared_path(spark, "results")
    logs.write_results(records, path)
    reviewed = logs.read_results(spark, path, records.schema).filter("job_id % 3 = 0 and rec_no % 2 = 1")
    logs.write_results(reviewed.withColumn("note", F.concat(F.lit("검수 "), "note")), path)
    logs.write_results(records.limit(0), path, jobs=logs.known_jobs(spark, path, dict(records.dtypes)["job_id"]).filter("job_id % 5 = 1"))
    return logs.read_results(spark, path, records.schema).select("rec_no", "case_no", "item_no", c("use").alias("use_"), F.size("locations").cast("bigint").alias("n"), "note", "job_id")


# ---- revisions and progress ----
_CE = f"{Q.merge_space('cur')} <> '' and {Q.merge_space('cur')} = {Q.merge_space('expected')}"


@query("p4_filter_noise", Q.over("nf_revisions", f"n as (select rec, pass, {_CE} noise from nf_revisions)") + 'select rec, sum(case when noise then 1 else 0 end)::bigint dropped, sum(case when noise then 0 else 1 end)::bigint "left", (bool_and(pass) and bool_and(noise)) or (bool_and(noise) and bool_or(noise)) passed from n group by rec')
def p4_filter_noise(spark, sf):
    return history.filter_noise(load(spark, sf, "nf_revisions"))


@query("a9_issue_digest", Q.over("nf_revisions", "n as (select *, row_number() over (partition by rec order by iter, cur, expected) i from nf_revisions)") + "select rec, string_agg(i || '. 현재: ' || coalesce(cur, '') || chr(10) || '   수정: ' || coalesce(expected, ''), chr(10) order by i) digest from n group by rec")
def a9_issue_digest(spark, sf):
    return history.issue_digest(load(spark, sf, "nf_revisions"))


_LAGS = ", ".join(f"lag(h, {i}) over (partition by rec order by iter) h{i}" for i in (1, 2, 3))


@query("w8_convergence", Q.over("nf_revisions", f"l as (select *, {_LAGS} from nf_revisions)", "f as (select rec, iter, case when h = h1 and h1 = h2 then 'converged' when h = h2 and h1 = h3 and h <> h1 then 'oscillating' end reason from l)") + "select rec, min(iter) iter, arg_min(reason, iter) reason from f where reason is not null group by rec")
def w8_convergence(spark, sf):
    return history.convergence(load(spark, sf, "nf_revisions"))


@query("w9_progress", Q.over("nf_progress", "p as (select job_id, seq, row_number() over (partition by job_id order by ts, seq) done, count(*) over (partition by job_id) total, (epoch(cast(ts as timestamp)) - epoch(cast(min(ts) over (partition by job_id) as timestamp))) * 0.9::double el from nf_progress)", "q as (select *, el / (done / total) - el + 5 eta from p)") + "select job_id, seq, done, total, cast(10 + floor(80 * done / total) as bigint) percent, case when done / total > 0.05 and eta > 0 and eta < 600 then round(eta, 3) end eta from q")
def w9_progress(spark, sf):
    return history.progress(load(spark, sf, "nf_progress")).select("job_id", "seq", F.col("done").cast("bigint").alias("done"), "total", "percent", "eta")


@query("t2_fold_state", Q.over("nf_progress") + "select job_id, arg_max(status, (ts, seq)) filter (where status is not null) status, arg_max(phase, (ts, seq)) filter (where phase is not null) phase, arg_max(error, (ts, seq)) filter (where error is not null) error from nf_progress group by job_id")
def t2_fold_state(spark, sf):
    return history.fold_state(load(spark, sf, "nf_progress"), ["status", "phase", "error"])


_T2 = "select job_id, arg_max(status, (ts, seq)) filter (where status is not null) status, arg_max(phase, (ts, seq)) filter (where phase is not null) phase, arg_max(error, (ts, seq)) filter (where error is not null) error from nf_progress group by job_id"


# ---- streams, run to the end of what is there ----
@query("t2_job_stream", Q.over("nf_progress", f"s as ({_T2})") + "select *, coalesce(status = 'done', false) closed from s")
def t2_job_stream(spark, sf):
    """Events in file batches in order of time, each batch with rows of the one before again; then late events, and one far in the future, after which done jobs are closed."""
    events = load(spark, sf, "nf_progress").withColumn("ts", F.col("ts").cast("timestamp"))
    path, target, checkpoint = (logs.shared_path(spark, n) for n in ("events", "states", "checkpoint"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * k / 3 for k in range(4)]
    for k in range(3):
        part = events.filter((F.col("ts") >= (cuts[k - 1] if k else first)) & ((F.col("ts") < cuts[k + 1]) | F.lit(k == 2)))
        part.coalesce(1).write.mode("append").parquet(path)
    late = events.filter(F.col("ts") <= cuts[1]).select("job_id", F.lit(first).alias("ts"), (-F.col("seq")).alias("seq"), F.lit("late").alias("status"), F.lit("late").alias("phase"), F.lit("late").alias("error"))
    clock = lambda days: spark.range(1).select(F.lit(-1).cast(events.schema["job_id"].dataType).alias("job_id"), F.lit(last + timedelta(days=days)).alias("ts"), F.lit(0).cast("long").alias("seq"), *(F.lit(None).cast("string").alias(f) for f in ("status", "phase", "error")))
    late.unionByName(clock(4000)).coalesce(1).write.mode("append").parquet(path)
    clock(4001).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.fold_jobs(stream, ["status", "phase", "error"], target, checkpoint, late="1 hour", keep=timedelta(days=3000)).awaitTermination()
    return jobs.last_states(spark, target).filter("job_id <> -1")


@query("t1_last_corrections", Q.over("nf_corrections") + "select seq, case_no, grp from nf_corrections order by seq desc limit 200")
def t1_last_corrections(spark, sf):
    log, path, target = load(spark, sf, "nf_corrections"), logs.shared_path(spark, "feed"), logs.shared_path(spark, "last")
    checkpoint = logs.shared_path(spark, "checkpoint")
    for part in (0, 1):
        logs.append_corrections(log.filter(F.col("seq") % 2 == part), path)
        jobs.refresh_last(spark, path, target, checkpoint).awaitTermination()
    return jobs.last_corrections(spark, target).select("seq", "case_no", "grp")


_AD = "concat_ws(' ', a, dt)"
_T3 = (
    *_SEG,
    f"b1 as (select doc_id, block_no, case_no, block_text, list_filter(regexp_extract_all(block_text, '[\\d,]{{4,}}'), lambda p: contains(p, ',')) pr, list_transform(regexp_extract_all(block_text, {Q.lit(R.TEXT_ADDRESS)}, 1), lambda a: {Q.strip('a')}) ad, regexp_extract(block_text, {Q.lit(spaced(R.TEXT_USE))}, 1) u from blocks)",
    "b2 as (select *, case when len(ad) > 0 then ad else [''] end al, case when len(ad) > 0 then '' else block_text end dt from b1)",
    "ct as (select doc_id, case_no, block_text as text from b1)", Q.flags_sql("ct"),
    "l0 as (select doc_id, block_no, case_no, pr, u, dt, unnest(al) a, generate_subscripts(al, 1) - 1 pos from b2)",
    f"l1 as (select *, {Q.normal_address(_AD)} address, {Q.normal_use('u')} use_cell from l0)",
)


@query("t3_ingest", Q.over("nf_text", *_T3) + f"select l.doc_id, l.block_no rec_no, c.grp, cast(pos as int) pos, case when pos = 0 then l.case_no else '' end case_cell, address, use_cell, case when pos = 0 then coalesce(pr[1], '') || case when coalesce(pr[2], pr[1], '') <> '' then chr(10) || coalesce(pr[2], pr[1]) else '' end else '' end price_cell, '2023. 7. 3. 10:00' sale_date from l1 l join cls c on l.doc_id = c.doc_id and l.case_no = c.case_no where {Q.in_groups('c.grp')}")
def t3_ingest(spark, sf):
    """Notices as packed files, one each, taken in by the stream and published; a second run over the same folder does nothing again."""
    folder, out, checkpoint, done = (logs.shared_path(spark, n) for n in ("notices", "published", "checkpoint", "done"))
    files.write_texts(load(spark, sf, "nf_text"), folder, "doc_id", packed=True, dealt=True)
    for _ in range(2):
        jobs.ingest(spark, f"{folder}/*", lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), checkpoint, done).awaitTermination()
    found = spark.read.parquet(out).withColumn("doc_id", F.regexp_extract("job_id", r"doc_id=(\d+)", 1).cast("int"))
    return found.select("doc_id", "rec_no", "grp", "pos", "case_cell", "address", "use_cell", "price_cell", "sale_date")


# ---- files and words ----
@query("s1_triage", Q.over("nf_files") + "select name, length, case when name like '%.pdf' then 'pdf' when length % 3 = 0 then 'hwpx' when length % 3 = 1 then 'hwp5' else 'text' end kind from nf_files")
def s1_triage(spark, sf):
    head = F.when(c("length") % 3 == 0, F.unhex(F.lit("504B0304"))).when(c("length") % 3 == 1, F.unhex(F.lit("D0CF11E0A1B1"))).otherwise(F.unhex(F.lit("EC82AC")))
    return load(spark, sf, "nf_files").select("name", "length", files.kind(c("name"), head).alias("kind"))


@query("s2_whole_texts", "select doc_id, text || chr(10) as text from documents")
def s2_whole_texts(spark, sf):
    """Documents written as a file each, and read back whole."""
    path = logs.shared_path(spark, "texts")
    files.write_texts(load(spark, sf, "documents"), path, "doc_id")
    return files.read_notices(spark, f"{path}/*").select(F.regexp_extract("path", r"doc_id=(-?\d+)", 1).try_cast("bigint").alias("doc_id"), "text")


@query("s8_pair_files", Q.over("nf_files", "d as (select *, trim(replace(folder, '-완료', '')) lb, regexp_replace(name, '\\.[^.]*$', '') st from nf_files where contains(folder, '-완료'))", r"r as (select folder, name from d where regexp_matches(name, '\.hwpx?$') and sub in ('', '원고') qualify row_number() over (partition by folder order by sub = '', case when starts_with(st, split_part(lb, ' ', 1)) then 0 when starts_with(st, 'CS_') then 1 else 2 end, length desc, name) = 1)", r"f as (select folder, name from d where regexp_matches(name, '\.pdf$') and sub in ('', '최종') qualify row_number() over (partition by folder order by sub = '', case when starts_with(name, '수정') then 0 when starts_with(st, split_part(lb, ' ', 1)) or (length(split_part(lb, ' ', 1)) > 2 and contains(st, split_part(lb, ' ', 1))) or (length(split_part(lb, ' ', 2)) > 2 and contains(st, split_part(lb, ' ', 2))) then 1 else 2 end, name) = 1)") + "select coalesce(r.folder, f.folder) folder, r.name raw, f.name final from r full join f on r.folder = f.folder")
def s8_pair_files(spark, sf):
    return files.pair_files(load(spark, sf, "nf_files"))


@query("s9_words", Q.over("nf_words") + "select doc_id, page, count(*) n, max(top) bottom from nf_words group by 1, 2")
def s9_words(spark, sf):
    path = logs.shared_path(spark, "words")
    load(spark, sf, "nf_words").write.parquet(path)
    return files.read_words(spark, path).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.max("top").alias("bottom"))
