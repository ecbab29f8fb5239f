"""SQL of other engines for the registered queries, built from the same rule packs."""

from __future__ import annotations

import re

from tidemill import rules as R
from tidemill.plans.fixtures import chain
from tidemill.rules import spaced

S = r"\s\p{Z}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pairs) -> str:
    for pattern, to in pairs:
        to = re.sub(r"\$(\d)", r"\\\1", to)
        x = f"regexp_replace({x}, {lit(spaced(pattern))}, {lit(to)}, 'g')"
    return x


def text(x: str) -> str:
    return f"coalesce({x}, '')"


def strip(x: str, chars: str = S) -> str:
    return f"regexp_replace({x}, {lit(f'^[{chars}]+|[{chars}]+$')}, '', 'g')"


def squeeze(x: str) -> str:
    return rr(x, [(r"\s+", "")])


def merge_space(x: str) -> str:
    return strip(rr(text(x), [(r"\s+", " ")]))


def merge_lines(x: str) -> str:
    return strip(rr(f"replace({text(x)}, chr(13), chr(10))", [(r"\n+", " "), (r"\s{2,}", " ")]))


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split(replace({text(x)}, chr(13), chr(10)), chr(10)), lambda l: {merge_space('l')}), lambda l: l <> '')"


def province(x: str) -> str:
    return rr(text(x), [(p + r"\s*", "") for p in R.PROVINCES])


def materials(x: str) -> str:
    return strip(rr(text(x), [*((p, "") for p in R.MATERIALS), *R.MATERIAL_CLEANUP]))


def facility(x: str) -> str:
    return rr(text(x), R.FACILITY)


def notation(x: str) -> str:
    x = text(x)
    for pattern, to in R.SHARE_FORMS:
        parts = re.split(r"([<>])", re.sub(r"\$(\d)", r"\\\1", to))
        rep = " || ".join({"<": "chr(1)", ">": "chr(2)"}.get(p, lit(p)) for p in parts if p)
        x = f"regexp_replace({x}, {lit(spaced(pattern))}, {rep}, 'g')"
        if "<" in to:
            x = f"array_to_string(list_transform(string_split({x}, chr(1)), lambda p: case when contains(p, chr(2)) then replace(split_part(p, chr(2), 1), ' ', '') || split_part(p, chr(2), 2) else p end), '')"
    return x


def clause(x: str) -> str:
    x = f"replace(replace({merge_space(x)}, '전 소유권 중', ''), '전소유권중', '')"
    x = rr(strip(x, r" \[\]()"), [("지분 중 일부", "지분일부"), ("지분중일부", "지분일부")])
    return squeeze(rr(merge_space(notation(x)), R.SHARE_CLAUSES))


def first_of(x: str, words) -> str:
    return "least(" + ", ".join(f"nullif(strpos({x}, {lit(w)}), 0)" for w in words) + ")"


def head_before(x: str, words) -> str:
    return f"coalesce(substring({x}, 1, {first_of(x, words)} - 1), {x})"


def share_texts(x: str) -> str:
    x = merge_space(x)
    found = f"list_transform(regexp_extract_all({x}, {lit(R.SHARE_GROUP)}, 1), lambda l: {strip('l')})"
    at = first_of(x, R.SHARE_WORDS)
    rest = strip(f"substring({x}, {at})", r" \[\]()")
    return f"case when len({found}) > 0 then {found} when {at} is not null then [{rest}] else [] end"


def strip_shares(x: str) -> str:
    x = f"regexp_replace({merge_space(x)}, {lit(R.SHARE_GROUP)}, '', 'g')"
    return strip(rr(head_before(x, R.SHARE_MARKERS), [(r"\s+", " ")]), " ,.;")


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def shares(address: str, use: str) -> str:
    x = f"concat_ws(' ', {text(address)}, {text(use)})"
    found = f"list_filter(list_transform({share_texts(x)}, lambda c: {clause('c')}), lambda c: c <> '')"
    return distinct_in_order(found)


def normal_use(x: str) -> str:
    return strip(facility(materials(merge_space(x))), " ,.;")


def normal_address(x: str) -> str:
    return strip(rr(notation(facility(materials(province(merge_space(x))))), [(r"\s{2,}", " ")]), " ,.;")


def farmland(x: str) -> str:
    return rr(text(x), R.FARMLAND)


def particles(x: str) -> str:
    return rr(text(x), R.PARTICLES)


def normal_note(x: str) -> str:
    x = rr(f"replace({text(x)}, chr(13), chr(10))", [(r"\n+", " ")])
    return rr(squeeze(particles(farmland(x))), [(r"\.+$", "")])


def case_numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({text(x)}, {lit(spaced(R.CASE))}), lambda c: {squeeze('c')})"


def split_price(x: str) -> str:
    s = f"replace({text(x)}, ' ', '')"
    half = f"(length({s}) // 2)"
    a, b = f"substring({s}, 1, {half})", f"substring({s}, {half} + 1, {half})"
    return f"case when length({s}) % 2 = 0 and {a} = {b} and regexp_matches({a}, '^[\\d,]+$') and not contains({text(x)}, chr(10)) then {a} || chr(10) || {b} else {text(x)} end"


def price_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split(replace({text(x)}, chr(13), chr(10)), chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def town(x: str) -> str:
    cut = lambda p: rr(f"regexp_extract({x}, {lit(spaced(p))})", [(r"\s+$", "")])
    return f"case when regexp_matches({x}, {lit(spaced(R.TOWN))}) then {cut(R.TOWN)} else {cut(R.TOWN_SEJONG)} end"


def same_place(x: str) -> str:
    return f"'동소 ' || {strip(f'substring({x}, length({town(x)}) + 1)')}"


def lots(x: str) -> str:
    return f"regexp_extract_all({merge_space(x)}, {lit(R.LOT)})"


def keywords(x: str) -> str:
    stop = "[" + ", ".join(map(lit, R.STOPWORDS)) + "]"
    return f"list_filter(list_distinct(regexp_extract_all({text(x)}, {lit(R.KEYWORD)})), lambda k: not list_contains({stop}, k))"


def in_groups(x: str, more: tuple[str, ...] = ()) -> str:
    return f"{x} in ({', '.join(map(lit, [*R.GROUPS, *more]))})"


def joined(x: str, by: str = "|") -> str:
    return f"array_to_string({x}, {lit(by)})"


def over(name: str, *ctes: str, recursive: bool = False) -> str:
    """The leading WITH of a fixture and more tables."""
    return ("with recursive " if recursive else "with ") + ", ".join([*chain(name, "duckdb"), *ctes]) + " "


# Record assembly, as tables that several queries read.
_HEADER = "(contains(t, '사건번호') and (contains(t, '매 각 물 건') or contains(t, '매각물건'))) or contains(t, '물건' || chr(10) || '번호') or (contains(t, '용 도') and contains(t, '소 재 지')) or (contains(t, '감정평가액') and contains(t, '최저매각가격') and contains(t, '비'))"
CELLS = ["case_cell", "item_cell", "use_cell", "addr_cell", "detail_cell", "price_cell", "note_cell"]
_NUM = r"regexp_matches(item_cell, '^\d+$')"
ISLANDS = (
    f"w0 as (select doc_id, ok, seq, {', '.join(strip(text(split_price(c) if c == 'price_cell' else c)) + ' ' + c for c in CELLS)} from nf_rows)",
    f"w1 as (select *, {case_numbers('case_cell')} nos, regexp_extract(case_cell, '(중복|병합)', 1) tg from w0)",
    f"""w2 as (select *, len(nos) > 0 is_case, case when len(nos) > 0 then case when tg <> '' and len(nos) >= 2 then nos[2] || '[' || tg || ']' else '' end end tag,
 case when len(nos) > 0 then case when item_cell = '' then '1' else item_cell end when {_NUM} then item_cell end eff from w1)""",
    "w3 as (select *, sum(case when is_case then 1 else 0 end) over (partition by doc_id order by ok, seq) seg, last_value(eff ignore nulls) over (partition by doc_id order by ok, seq rows between unbounded preceding and 1 preceding) prev from w2)",
    f"w4 as (select *, is_case or ({_NUM} and item_cell <> prev) st from w3 where seg > 0)",
    """isl as (select *, sum(case when st then 1 else 0 end) over (partition by doc_id order by ok, seq) rec_no,
 last_value(nos[1] ignore nulls) over (partition by doc_id order by ok, seq rows between unbounded preceding and current row) case_no,
 last_value(tag ignore nulls) over (partition by doc_id order by ok, seq rows between unbounded preceding and current row) dup_tag,
 coalesce(last_value(case when st and use_cell <> '' then use_cell end ignore nulls) over (partition by doc_id, seg order by ok, seq rows between unbounded preceding and current row), '') "use",
 last_value(case when st then eff end ignore nulls) over (partition by doc_id order by ok, seq rows between unbounded preceding and current row) item_no from w4)""",
)
RECORDS = (
    *ISLANDS,
    f"""rec as (select doc_id, cast(rec_no as bigint) rec_no, any_value(case_no) case_no, any_value(dup_tag) dup_tag, any_value(item_no) item_no, arg_min("use", (ok, seq)) filter (where st) "use",
 list({{'addr': addr_cell, 'detail': detail_cell}} order by ok, seq) filter (where is_case or addr_cell <> '' or detail_cell <> '') locations,
 arg_min({price_lines('price_cell')}, (ok, seq)) filter (where price_cell <> '') pl, coalesce(string_agg(note_cell, chr(10) order by ok, seq) filter (where note_cell <> ''), '') note
 from isl group by doc_id, rec_no)""",
)


def flags_sql(source: str) -> str:
    """F30's decision table over rows (doc_id, case_no, text)."""
    h = lambda p: f"bool_or(regexp_matches(text, {lit(p)}))"
    g = [lit(x) for x in R.GROUPS]
    building = "(house or shop or lodging)"
    return f"""fl as (select doc_id, case_no, bool_and(regexp_matches(text, {lit(R.VEHICLES)})) only_vehicle, {h(R.CONDITIONS)} special, {h('지분매각')} share, {h('공유자우선매수권')} co, {h('분묘')} grave,
 {h(R.FACTORIES)} factory, {h(R.FIELDS)} field, {h(R.HOUSES)} house, {h(R.FLATS)} flat, {h(R.ROWS)} rows_, {h(R.SHOPS)} shop, {h(R.LODGINGS)} lodging, {h(R.LANDS)} land from {source} group by doc_id, case_no),
cls as (select doc_id, case_no, case when only_vehicle then {lit(R.EXCLUDED)} when grave and share and land then {g[4]} when special or (share and co) then {g[5]} when factory or (field and {building}) then {g[5]}
 when house and shop then {g[2]} when lodging or shop then {g[3]} when flat then {g[0]} when rows_ then {g[1]} when house and not flat and not rows_ then {g[2]} when land then {g[4]} else {g[5]} end grp from fl)"""
