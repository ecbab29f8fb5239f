"""Column functions of the editing standard. Each takes and gives columns, and null counts as empty text."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill import rules as R
from tidemill.rules import spaced

#: Stand around text whose spaces are to go.
OPEN, CLOSE = "\x01", "\x02"


def replaced(c: Column, pairs: Iterable[tuple[str, str]], merged: bool = False) -> Column:
    """Ordered replacements; plain words without the cost of a pattern. merged: the text's only white space is the space."""
    for pattern, to in pairs:
        plain = not set(pattern) & set("\\[](){}.*+?^$|")
        c = F.replace(c, F.lit(pattern), F.lit(to)) if plain else F.regexp_replace(c, spaced(pattern, merged), to)
    return c


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def has_any(c: Column, words: Iterable[str]) -> Column:
    """Whether plain words stand in a text; much cheaper than a pattern of them."""
    found = [c.contains(w) for w in words]
    return reduce(lambda a, b: a | b, found)


def gated(c: Column, pairs: Iterable[tuple[str, str]], words: Iterable[tuple[str, ...]], merged: bool = False) -> Column:
    """replaced(), where pairs that stand together and hold words of one tuple are looked for only in texts that hold one of these.

    A word must stand in its patterns so that nothing without it can match: then the result is that of replaced().
    """
    words, groups = list(words), []
    for pair in pairs:
        some = next((ws for ws in words if any(w in pair[0] for w in ws)), None)
        if groups and groups[-1][0] == some:
            groups[-1][1].append(pair)
        else:
            groups.append((some, [pair]))
    for some, together in groups:
        if some is None:
            c = replaced(c, together, merged)
        else:
            c = once(c, lambda x, ws=some, ps=together: F.when(has_any(x, (w.removeprefix("\\") for w in ws)), replaced(x, ps, merged)).otherwise(x))
    return c


def once(c: Column, f) -> Column:
    """f(c) where f uses its argument more than once: a nested expression is then computed once and not for every use."""
    return F.element_at(F.transform(F.array(c), lambda x: f(x)), 1)


def chained(c: Column, steps: Iterable) -> Column:
    """Functions one after the other, in one expression."""
    for f in steps:
        c = once(c, f)
    return c


def staged(df: DataFrame, columns: dict[str, tuple[Column, list]]) -> DataFrame:
    """Adds columns name -> (start, steps), as chained(start, steps) gives them, with a projection for every step.

    Spark compiles these; what once() nests it interprets, which takes several times as long.
    """
    df = df.withColumns({name: start for name, (start, _) in columns.items()})
    for step in itertools.zip_longest(*([(name, f) for f in steps] for name, (_, steps) in columns.items())):
        df = df.withColumns({at[0]: at[1](F.col(at[0])) for at in step if at})
    return df


#: The characters of R.W, one by one.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column, chars: str = SPACES) -> Column:
    return F.btrim(c, F.lit(chars))


def squeezed(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, R.W + "+", "")


def any_of(words: Iterable[str]) -> str:
    return "|".join(w.replace("[", r"\[").replace("(", r"\(") for w in words)


def first_of(c: Column, words: Iterable[str]) -> Column:
    """The least 1-based place of any of the words; null if there is none."""
    return F.least(*(F.nullif(F.instr(c, w), F.lit(0)) for w in words))


def _apart(words: list[str]) -> bool:
    """Whether no word can begin inside another, so that words can be cut at in turn."""
    return not any(a[k:].startswith(b) or b.startswith(a[k:]) for a in words for b in words for k in range(1, len(a)))


def head_before(c: Column, words: Iterable[str]) -> Column:
    """What stands before the first of the words; all of it if there is none."""
    words = list(words)
    if _apart(words):
        return reduce(lambda x, w: F.substring_index(x, w, 1), words, c)
    return once(c, lambda x: F.coalesce(F.substring(x, F.lit(1), first_of(x, words) - 1), x))


# F3
def merge_lines(c: Column) -> Column:
    """Line breaks and runs of white space to one space."""
    c = F.replace(text(c), F.lit("\r"), F.lit("\n"))
    c = once(c, lambda x: F.when(x.contains("\n"), F.regexp_replace(x, "\n+", " ")).otherwise(x))
    return stripped(F.regexp_replace(c, R.W + "{2,}", " "))


def merge_lines_steps() -> list:
    return [
        lambda x: F.replace(text(x), F.lit("\r"), F.lit("\n")),
        lambda x: F.when(x.contains("\n"), F.regexp_replace(x, "\n+", " ")).otherwise(x),
        lambda x: stripped(F.regexp_replace(x, R.W + "{2,}", " ")),
    ]


#: White space other than a space.
_LOOSE = r"[\t-\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _single(c: Column) -> Column:
    """Runs of spaces to one, in a text of merge_space() from which parts were taken out: it has no other white space."""
    return once(c, lambda x: F.when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x))


def merge_space(c: Column) -> Column:
    """All white space to one space. A text without other white space, and with single spaces alone and none at its ends, stays."""
    loose = lambda x: x.contains("  ") | x.startswith(" ") | x.endswith(" ") | x.rlike(_LOOSE)
    return once(text(c), lambda x: F.when(loose(x), stripped(F.regexp_replace(x, R.W + "+", " "))).otherwise(x))


def lines(c: Column) -> Column:
    """The lines that are not blank, merged."""
    return F.filter(F.transform(F.split(F.regexp_replace(text(c), "\r", "\n"), "\n"), merge_space), lambda x: x != "")


# F1, F2, F4 to F7
#: Words that patterns of materials hold, whatever else they match; the first tuple that a pattern has a word of counts.
_MATERIAL_WORDS = (("콘크리트", "철골"), ("슬래브지", "블럭조", "아스팔트", "기타지붕", "샌드위치", "강판지붕", "강파이프", "평스라브"), ("판넬", "벽돌조"))


#: What every province ends with, and any province, looked for where a first character of one stands.
_PROVINCE_ENDS = ("도", "특별시", "광역시")
_PROVINCE = "(?=[" + "".join(sorted({p[0] for p in R.PROVINCES})) + "])(?:" + "|".join(R.PROVINCES) + ")"


def strip_province(c: Column) -> Column:
    """One pass over all names, none of which overlap; where that leaves or makes a name, they go one after the other."""
    chain = lambda x: replaced(x, ((p + r"\s*", "") for p in R.PROVINCES))
    cut = lambda x: once(F.regexp_replace(x, _PROVINCE + R.W + "*", ""), lambda y: F.when(has_any(y, _PROVINCE_ENDS) & y.rlike(_PROVINCE), chain(x)).otherwise(y))
    return once(text(c), lambda x: F.when(has_any(x, _PROVINCE_ENDS), cut(x)).otherwise(x))


def strip_province_steps() -> list:
    """strip_province(), in steps, of a text that isn't null."""
    chain = lambda x: replaced(x, ((p + r"\s*", "") for p in R.PROVINCES))
    return [
        lambda x: F.struct(x.alias("t"), F.when(has_any(x, _PROVINCE_ENDS), F.regexp_replace(x, _PROVINCE + R.W + "*", "")).otherwise(x).alias("cut")),
        lambda s: F.when(has_any(s["cut"], _PROVINCE_ENDS) & s["cut"].rlike(_PROVINCE), once(s["t"], chain)).otherwise(s["cut"]),
    ]


#: A word of every pattern of materials, for steps; the first that stands in a pattern counts.
_MATERIAL_STEPS = ("콘크리트", "철골", "슬래브", "블럭조", "아스팔트", "기타지붕", "샌드위치", "강판지붕", "강파이프", "스라브", "판넬", "벽돌조")


def gated_steps(pairs: Iterable[tuple[str, str]], words: tuple[str, ...], most: int = 3) -> list:
    """gated(), in steps of `most` pairs, so that a word which is gone isn't looked for by further patterns."""
    groups: list[tuple] = []
    for pair in pairs:
        word = next((w for w in words if w in pair[0]), None)
        if groups and groups[-1][0] == word and len(groups[-1][1]) < most:
            groups[-1][1].append(pair)
        else:
            groups.append((word, [pair]))

    def step(word: str | None, some: list[tuple[str, str]]):
        return lambda x: replaced(x, some) if word is None else F.when(x.contains(word.removeprefix("\\")), replaced(x, some)).otherwise(x)

    return [step(*group) for group in groups]


def strip_materials_steps() -> list:
    """strip_materials(), in steps, of a text that isn't null."""
    *pairs, runs = R.MATERIAL_CLEANUP
    return [*gated_steps(((p, "") for p in R.MATERIALS), _MATERIAL_STEPS), *gated_steps(pairs, ("콘크리트", "및", r"\[", r"\(")), lambda x: stripped(replaced(x, [runs]))]


def strip_materials(c: Column, longest_first: bool = False, merged: bool = False) -> Column:
    """Material words in the standard's order; longest_first takes longer patterns before those they contain. merged: the text is one of merge_space()."""
    patterns = sorted(R.MATERIALS, key=len, reverse=True) if longest_first else R.MATERIALS
    removed = once(text(c), lambda x: F.when(has_any(x, R.MATERIAL_STEMS.split("|")), gated(x, ((p, "") for p in patterns), _MATERIAL_WORDS, merged)).otherwise(x))
    *pairs, runs = R.MATERIAL_CLEANUP
    cleaned = gated(removed, pairs, [("콘크리트", "및", r"\[", r"\(")], merged)
    return stripped(_single(cleaned) if merged else replaced(cleaned, [runs]))


def shorten_facility(c: Column, merged: bool = False) -> Column:
    return gated(text(c), R.FACILITY, [("근린생활시설",)], merged)


def shorten_farmland(c: Column) -> Column:
    return gated(text(c), R.FARMLAND, [("농지법", "농지취득자격증명", "미제출시")])


def strip_periods(c: Column) -> Column:
    return F.regexp_replace(text(c), r"\.+$", "")


def shorten_particles(c: Column) -> Column:
    return replaced(text(c), R.PARTICLES)


# F8, F9
def _tight(c: Column) -> Column:
    """Spaces go between the marks, and the marks go."""
    part = lambda p: F.when(F.instr(p, CLOSE) > 0, F.concat(F.replace(F.substring_index(p, CLOSE, 1), F.lit(" "), F.lit("")), F.substring_index(p, CLOSE, -1))).otherwise(p)
    return F.array_join(F.transform(F.split(c, OPEN), part), "")


def share_notation_steps(merged: bool = False) -> list:
    """share_notation(), in steps, of a text that isn't null."""

    def forms(out: Column, some: list[tuple[str, str]]) -> Column:
        for pattern, to in some:
            out = F.regexp_replace(out, spaced(pattern, merged), to.replace("<", OPEN).replace(">", CLOSE))
            out = _tight(out) if "<" in to else out
        return out

    def step(some: list[tuple[str, str]], there):
        # forms are few texts' business and stay nested
        return lambda x: F.when(x.contains("지분") & x.contains("분의") & there(x), once(x, lambda y: forms(y, some))).otherwise(x)

    # forms are tried where their own word stands, and the one without a word where its fixed middle does
    middle = lambda x: x.contains("채무자") | x.rlike(spaced(r"지분\s+전부\s+\d", merged))
    gates = [(1, lambda x: x.contains("갑구")), (2, lambda x: x.contains("소유자")), (1, lambda x: x.contains("공유자")), (2, middle)]
    ends = list(itertools.accumulate(n for n, _ in gates))
    return [step(R.SHARE_FORMS[end - n : end], there) for end, (n, there) in zip(ends, gates)]


def share_notation(c: Column, merged: bool = False) -> Column:
    return once(text(c), lambda x: F.when(x.contains("지분"), chained(x, share_notation_steps(merged))).otherwise(x))


def share_clause(c: Column) -> Column:
    """The canonical form of one share clause."""
    c = F.replace(F.replace(merge_space(c), F.lit("전 소유권 중"), F.lit("")), F.lit("전소유권중"), F.lit(""))
    c = stripped(c, " []()")
    c = F.regexp_replace(F.regexp_replace(c, "지분 중 일부", "지분일부"), "지분중일부", "지분일부")
    c = gated(stripped(_single(share_notation(c, merged=True))), R.SHARE_CLAUSES, [("갑구",), ("공유자", "소유자", "채무자")], merged=True)
    return F.replace(c, F.lit(" "), F.lit(""))


# F10, F11, P9
def has_share(c: Column) -> Column:
    return once(text(c), lambda x: has_any(x, R.SHARE_WORDS))


def share_texts(c: Column) -> Column:
    """Bracketed share texts, or what follows the first share word."""

    def pick(c: Column) -> Column:
        found = F.transform(F.regexp_extract_all(c, F.lit(R.SHARE_GROUP), F.lit(1)), lambda x: stripped(x))
        rest = lambda: stripped(F.substring(c, first_of(c, R.SHARE_WORDS), F.length(c)), " []()")
        # every word of a group is one of the share words
        return F.when(has_any(c, R.SHARE_WORDS), once(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(rest())))).otherwise(F.array().cast("array<string>"))

    return once(merge_space(c), pick)


def strip_shares(c: Column) -> Column:
    without = once(merge_space(c), lambda x: F.when(x.contains("("), F.regexp_replace(x, R.SHARE_GROUP, "")).otherwise(x))
    return stripped(_single(head_before(without, R.SHARE_MARKERS)), " ,.;")


def strip_shares_by_line(c: Column) -> Column:
    return F.filter(F.transform(lines(c), strip_shares), lambda x: x != "")


# A6
def shares(address: Column, use: Column) -> Column:
    """Canonical share clauses of a location, in order, once each."""
    found = F.transform(share_texts(F.concat_ws(" ", text(address), text(use))), share_clause)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def source_location(s: Column) -> Column:
    """A source location (struct of address and use) with its shares(), and where it has some the lots, each between commas, and the place by which its output is looked for."""
    address, use = s["address"], s["use"]
    empty = F.array().cast("array<string>")
    fields = lambda shares, lots, place: F.struct(address.alias("address"), use.alias("use"), shares.alias("shares"), lots.alias("lots"), place.alias("place"))
    lots = lambda: F.transform(lot_tokens(F.concat_ws(" ", address, head_before(merge_space(use), R.MATCH_MARKERS))), lambda t: F.concat(F.lit(","), t, F.lit(",")))
    place = lambda: stripped(F.substring_index(strip_province(merge_space(address)), "(", 1))
    found = lambda: once(shares(address, use), lambda x: F.when(F.size(x) > 0, fields(x, lots(), place())).otherwise(fields(x, F.lit(None).cast("array<string>"), F.lit(None).cast("string"))))
    # texts that can't hold a share aren't worked on
    some = has_any(text(address), R.SHARE_WORDS) | has_any(text(use), R.SHARE_WORDS)
    return F.when(some, found()).otherwise(fields(empty, F.lit(None).cast("array<string>"), F.lit(None).cast("string")))


# F12
def normal_use(c: Column) -> Column:
    return stripped(shorten_facility(strip_materials(merge_space(c), merged=True), merged=True), " ,.;")


def normal_address(c: Column) -> Column:
    c = share_notation(shorten_facility(strip_materials(strip_province(merge_space(c)), merged=True), merged=True), merged=True)
    return stripped(_single(c), " ,.;")


def normal_note(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(text(c), "\r", "\n"), "\n+", " ")
    return strip_periods(squeezed(shorten_particles(shorten_farmland(c))))


def normal_note_steps() -> list:
    return [
        lambda x: F.regexp_replace(F.replace(text(x), F.lit("\r"), F.lit("\n")), "\n+", " "),
        *gated_steps(R.FARMLAND, ("농지취득자격증명", "미제출시", "농지법")),
        lambda x: squeezed(replaced(x, R.PARTICLES)),
        strip_periods,
    ]


# F13, F14
def split_use(c: Column) -> Column:
    """struct(use, rest)."""
    land, building = spaced(R.LAND_USE), spaced(R.BUILDING_USE)

    def split(c: Column) -> Column:
        use = F.when(c.rlike(land), F.regexp_extract(c, land, 1)).when(c.rlike(building), F.regexp_extract(c, building, 2)).otherwise("")
        return F.struct(use.alias("use"), F.when(c.rlike(land), F.regexp_extract(c, land, 2)).otherwise(c).alias("rest"))

    return once(stripped(text(c)), split)


def use_group(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in R.USE_GROUPS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, stripped(text(c))), F.lit(R.OTHER))


# F15, F31
def case_numbers(c: Column) -> Column:
    """All case numbers of a text without their spaces."""
    found = F.transform(F.regexp_extract_all(c, F.lit(spaced(R.CASE)), F.lit(0)), squeezed)
    return F.when(c.contains("경"), found).otherwise(F.array().cast("array<string>"))


def duplicate_tag(c: Column) -> Column:
    """struct(case_no, tag) of a case cell: second[tag] where it has a tag and two numbers, else the cell and null."""
    c = text(c)
    numbers, tag = F.regexp_extract_all(c, F.lit(r"\d+타경\d+"), F.lit(0)), F.regexp_extract(c, r"(중복|병합)", 1)
    both = (tag != "") & (F.size(numbers) >= 2)
    return F.struct(F.when(both, F.get(numbers, F.lit(0))).otherwise(stripped(c)).alias("case_no"), F.when(both, F.concat(F.get(numbers, F.lit(1)), F.lit("["), tag, F.lit("]"))).alias("tag"))


# F16, W11
def order_note(c: Column) -> Column:
    """Sentences by rank: those with a case number, those of the sale's kind, the rest; each rank in its order."""
    parts = F.filter(F.transform(F.split(text(c), r"\."), lambda x: stripped(x)), lambda x: x != "")
    rank = lambda x: F.when(x.rlike(r"\d{4}타경\d+"), 0).when(x.rlike("일괄매각|지분매각"), 1).otherwise(2)
    ranked = F.transform(parts, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda s: s["x"]), ".")


def printed_lines(parts: Column, width: int) -> Column:
    """Lines that texts take in a column `width` characters wide. Each text, and each line of one, begins a new line; an empty or null text takes one."""
    lines = F.flatten(F.transform(parts, lambda x: F.split(text(x), "\n")))
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda n, x: n + F.greatest(F.ceil(F.length(x) / width), F.lit(1)))


def shorten_list(c: Column) -> Column:
    """목록1,2,3,7 -> 목록1~3,7, for each list of a text. Runs of three or more numbers are joined, two keep their comma. A list with a number beyond bigint stays as it is."""
    c = text(c)
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))
    follows = lambda n, b: F.coalesce(n == F.try_add(b, F.lit(1)), F.lit(False))
    show = lambda s: F.concat(s["out"], F.when(s["out"] != "", ",").otherwise(""), F.when(s["a"] == s["b"], s["a"].cast("string")).when(follows(s["b"], s["a"]), F.concat_ws(",", s["a"], s["b"])).otherwise(F.concat_ws("~", s["a"], s["b"])))
    step = lambda s, n: F.when(s["a"].isNull(), F.struct(F.lit("").alias("out"), n.alias("a"), n.alias("b"))).when(follows(n, s["b"]), F.struct(s["out"].alias("out"), s["a"].alias("a"), n.alias("b"))).otherwise(F.struct(show(s).alias("out"), n.alias("a"), n.alias("b")))
    fold = lambda numbers: F.when(F.exists(numbers, lambda x: x.isNull()), F.lit(None).cast("string")).otherwise(F.aggregate(numbers, start, step, show))
    short = lambda numbers: F.coalesce(once(F.transform(F.split(numbers, ","), lambda x: x.try_cast("bigint")), fold), numbers)
    # each list is put between marks, so that lists and the texts between them are parts of their own
    parts = F.split(F.regexp_replace(c, R.LISTED, "$1\u0001$2\u0001"), "\u0001")
    folded = F.transform(parts, lambda x, i: F.when(i % 2 == 1, short(x)).otherwise(x))
    return F.when(c.rlike(R.LISTED), F.array_join(folded, "")).otherwise(c)


# F17
def split_price(c: Column) -> Column:
    """Two equal halves of digits and commas that stand together get a line each."""
    c = text(c)
    s = F.replace(c, F.lit(" "), F.lit(""))
    half = F.floor(F.length(s) / 2).cast("int")
    a, b = F.substring(s, F.lit(1), half), F.substring(s, half + 1, half)
    twice = (c != "") & ~c.contains("\n") & (F.length(s) % 2 == 0) & (a == b) & a.rlike(r"^[\d,]+$")
    return F.when(twice, F.concat_ws("\n", a, b)).otherwise(c)


def prices(c: Column) -> Column:
    """struct(price, min_price, price_value): the first lines, and the price as a number."""
    found = F.filter(F.transform(F.split(F.replace(text(c), F.lit("\r"), F.lit("\n")), "\n"), lambda x: stripped(x)), lambda x: x != "")

    def fields(found: Column) -> Column:
        price = F.coalesce(F.get(found, F.lit(0)), F.lit(""))
        value = F.replace(price, F.lit(","), F.lit("")).try_cast("decimal(18,0)")
        return F.struct(price.alias("price"), F.coalesce(F.get(found, F.lit(1)), price).alias("min_price"), value.alias("price_value"))

    return once(found, fields)


# F18, F19
def header(c: Column) -> Column:
    office = F.regexp_replace(stripped(F.regexp_extract(c, spaced(R.OFFICE), 1)), R.W + "+", " ")
    line = lambda p: F.nullif(stripped(F.regexp_extract(c, spaced(p), 1)), F.lit(""))
    return F.struct(F.nullif(office, F.lit("")).alias("damdang"), line(R.SALE_DATE).alias("sale_date"), line(R.DECISION_DATE).alias("decision_date"))


def _ahead(words: Iterable[str]) -> str:
    """A test for the first character of any word, so that words aren't tried one by one at every place of a text."""
    return "(?=[" + "".join(sorted({w[0] for w in words})) + "])"


#: Runs of digits and commas, four or more, with a comma.
_PRICES = r"(?=\d*+,)[\d,]{4,}"


def block_fields(c: Column) -> Column:
    """Fields of the free text of one case."""

    def fields(x: Column) -> Column:
        price = F.coalesce(F.get(x["prices"], F.lit(0)), F.lit(""))
        some = F.size(x["places"]) > 0
        return F.struct(
            x["case_no"].alias("case_no"),
            x["use"].alias("use"),
            price.alias("price"),
            F.coalesce(F.get(x["prices"], F.lit(1)), price).alias("min_price"),
            F.when(some, x["places"]).otherwise(F.array(F.lit(""))).alias("addresses"),
            F.when(some, F.lit("")).otherwise(stripped(c)).alias("detail"),
        )

    # searched once each, before the fields that use what was found
    places = F.regexp_extract_all(c, F.lit(_ahead([*R.PROVINCES, R.SEJONG]) + R.TEXT_ADDRESS), F.lit(1))
    found = F.struct(
        F.regexp_extract(c, r"\d{4}타경\d+", 0).alias("case_no"),
        F.regexp_extract(c, _ahead(R.TEXT_USE.strip("()").split("|")) + spaced(R.TEXT_USE), 1).alias("use"),
        F.regexp_extract_all(c, F.lit(_PRICES), F.lit(0)).alias("prices"),
        F.transform(places, lambda x: stripped(x)).alias("places"),
    )
    return once(found, fields)


# F20, F21
def with_missing(address: Column, found: Column) -> Column:
    """The address, and in brackets each share that it lacks."""
    add = lambda a, s: F.when((s == "") | squeezed(a).contains(s) | a.contains(F.concat(F.lit("["), s, F.lit("]"))), a).otherwise(stripped(F.concat(F.rtrim(a, F.lit(SPACES)), F.lit(" ["), s, F.lit("]"))))
    return F.aggregate(found, address, add)


def from_source(address: Column, use: Column, found: Column | None = None) -> Column:
    """struct(address, use): a location made again from its source text. found: its shares(), where they are known."""
    plain = lambda x: shorten_facility(strip_materials(x, merged=True), merged=True)
    ends = lambda x: stripped(x, " ,.;")

    def made(g: Column) -> Column:
        # a detail without a province is the use; materials are then looked for once
        detail = F.when(g["detail"] == g["use"], g["plain"]).otherwise(plain(g["detail"]))
        place = normal_address(strip_province(merge_space(address)))
        merged = F.struct(merge_space(F.concat_ws(" ", place, ends(_single(share_notation(detail, merged=True))))).alias("a"), (shares(address, use) if found is None else found).alias("s"))
        whole = once(merged, lambda m: F.when(F.size(m["s"]) > 0, with_missing(m["a"], m["s"])).otherwise(m["a"]))
        return F.struct(whole.alias("address"), ends(g["plain"]).alias("use"))

    given = once(merge_space(strip_shares(use)), lambda u: F.struct(u.alias("use"), strip_province(merge_space(strip_province(u))).alias("detail"), plain(u).alias("plain")))
    return once(given, made)


def restore_lines(src_address: Column, src_use: Column, out_address: Column, out_use: Column) -> Column:
    """Where the source has several lines they replace the address; bracketed suffixes of the edit stay."""
    given = F.struct(
        F.transform(lines(src_address), lambda x: normal_address(x)).alias("places"), F.transform(strip_shares_by_line(src_use), lambda x: normal_address(x)).alias("details"),
        squeezed(normal_use(out_use)).alias("use"), text(out_address).alias("out"),
    )

    def without_use(g: Column) -> Column:
        first = squeezed(normal_address(F.get(g["details"], F.lit(0))))
        tail = F.slice(g["details"], F.lit(2), F.greatest(F.size(g["details"]) - 1, F.lit(0)))
        rest = lambda f: F.substring(f, F.length(g["use"]) + 1, F.length(f))
        cut = once(first, lambda f: F.when(F.startswith(f, g["use"]), F.filter(F.array(rest(f)), lambda x: x != "")))
        return F.when(g["use"] == "", g["details"]).otherwise(F.coalesce(F.concat(cut, tail), g["details"]))

    def several(a: Column, out: Column) -> Column:
        last = F.element_at(a, -1)
        suffixes = F.regexp_extract_all(stripped(out), F.lit(r"\[[^\[\]]+\]"), F.lit(0))
        add = lambda t, s: F.when(squeezed(last).contains(squeezed(s)), t).otherwise(stripped(F.concat_ws(" ", t, s)))
        return F.concat_ws("\n", F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.aggregate(suffixes, last, add))))

    joined = lambda g: once(F.concat(g["places"], without_use(g)), lambda a: F.when(F.size(a) <= 1, normal_address(g["out"])).otherwise(several(a, g["out"])))
    return once(given, joined)


# F22
def lot_tokens(c: Column) -> Column:
    """Lot numbers of a text. None holds white space, so it needn't be merged."""
    return F.regexp_extract_all(text(c), F.lit(R.LOT), F.lit(0))


def keywords(c: Column) -> Column:
    """Different words of two characters or more, without the stopwords."""
    found = F.regexp_extract_all(text(c), F.lit(R.KEYWORD), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, R.STOPWORDS)))


def signature(addresses: Column, uses: Column, note: Column) -> Column:
    pairs = F.flatten(F.zip_with(addresses, uses, lambda a, u: F.array(text(a), text(u))))
    return F.array_join(F.concat(pairs, F.array(text(note))), " ")


# F23
def json_scan(c: Column, strings: bool = False) -> Column:
    """struct(json, state) of a model's answer: the fenced block; else from the first brace or bracket to the one that closes it (balanced), or to the end (cut); else the answer itself (none).

    Any closing mark closes the innermost open one. Marks inside strings count too, as long as `strings` is not set: then
    quotes and backslashes are followed and what stands in strings is passed over. Null stays null.
    """
    fenced = F.regexp_extract(c, r"```(?:json)?\s*([\s\S]*?)```", 1)
    body = F.regexp_extract(c, r"[{\[][\s\S]*", 0)
    # runs of other characters are one token
    tokens = F.regexp_extract_all(body, F.lit(r'[{}\[\]"\\]|[^{}\[\]"\\]+'), F.lit(0))
    no = F.lit(False)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), no.alias("done"), no.alias("quoted"), no.alias("escaped"))

    def step(s, x):
        counts = ~s["quoted"] if strings else F.lit(True)
        opens, closes = counts & x.isin("{", "["), counts & x.isin("}", "]")
        quote = (x == '"') & ~s["escaped"] if strings else no
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        return F.when(s["done"], s).otherwise(F.struct(
            depth.alias("depth"), (s["n"] + F.length(x)).alias("n"), (closes & (depth == 0)).alias("done"),
            (s["quoted"] != quote).alias("quoted"), (s["quoted"] & (x == "\\") & ~s["escaped"]).alias("escaped"),
        ))

    found = once(F.aggregate(tokens, start, step), lambda s: F.struct(F.when(s["done"], F.substring(body, F.lit(1), s["n"])).otherwise(body).alias("json"), F.when(s["done"], "balanced").otherwise("cut").alias("state")))
    alone = lambda x, state: F.struct(stripped(x).alias("json"), F.lit(state).alias("state"))
    return F.when(F.length(stripped(fenced)) > 0, alone(fenced, "fenced")).when(body != "", found).when(c.isNotNull(), alone(c, "none"))


def json_text(c: Column, strings: bool = False) -> Column:
    """The JSON of a model's answer, fenced or balanced; null if there is none."""
    return once(json_scan(c, strings), lambda x: F.when(x["state"].isin("fenced", "balanced"), x["json"]))


def json_rows(c: Column, fields: str, strings: bool = False) -> Column:
    """struct(rows, error) of a model's answer: its object, or the objects of its array, by the given fields; an answer that can't be read has an error."""
    parsed = lambda x: F.struct(F.from_json(x["json"], f"array<struct<{fields}>>", {"mode": "PERMISSIVE"}).alias("rows"), x["state"].alias("state"))
    told = lambda x: F.struct(x["rows"].alias("rows"), F.when(x["rows"].isNull(), F.concat(F.lit("no JSON: "), F.coalesce(x["state"], F.lit("null")))).alias("error"))
    return once(once(json_scan(c, strings), parsed), told)


# F28
def safe_label(c: Column) -> Column:
    return F.substring(F.regexp_replace(text(c), "[^A-Za-z0-9가-힣()]+", "_"), 1, 80)


# W4
def merge_floors(c: Column) -> Column:
    """Floors of equal area that follow each other become one token; what stands between them goes."""
    token = lambda p: F.struct(F.split_part(p, F.lit(CLOSE), F.lit(1)).alias("floor"), F.split_part(p, F.lit(CLOSE), F.lit(2)).alias("area"), F.split_part(p, F.lit(CLOSE), F.lit(3)).alias("after"))
    none = F.array().cast("array<string>")

    def label(floors: Column) -> Column:
        numbers = F.transform(floors, lambda x: x.cast("bigint"))
        run = lambda n: F.forall(F.transform(n, lambda x, i: x - i), lambda x: x == F.element_at(n, 1))
        listed = F.when(F.size(floors) < 3, F.array_join(floors, ",")).otherwise(once(numbers, lambda n: F.when(run(n), F.concat_ws("~", F.element_at(n, 1), F.element_at(n, -1))).otherwise(F.array_join(floors, ","))))
        return F.when(F.size(floors) == 1, F.concat(F.element_at(floors, 1), F.lit("층"))).otherwise(F.concat(listed, F.lit("층각")))

    def show(s: Column) -> Column:
        return F.when(F.size(s["floors"]) == 0, s["out"]).otherwise(F.concat(s["out"], label(s["floors"]), s["area"], F.lit("㎡"), s["after"]))

    def step(s: Column, t: Column) -> Column:
        more = F.struct(s["out"].alias("out"), F.concat(s["floors"], F.array(t["floor"])).alias("floors"), s["area"].alias("area"), t["after"].alias("after"))
        new = F.struct(show(s).alias("out"), F.array(t["floor"]).alias("floors"), t["area"].alias("area"), t["after"].alias("after"))
        return F.when((F.size(s["floors"]) > 0) & (s["area"] == t["area"]), more).otherwise(new)

    def merged(parts: Column) -> Column:
        start = F.struct(F.element_at(parts, 1).alias("out"), none.alias("floors"), F.lit("").alias("area"), F.lit("").alias("after"))
        return F.aggregate(F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), token), start, step, show)

    parts = lambda x: F.split(F.regexp_replace(x, spaced(R.FLOOR), f"{OPEN}$1{CLOSE}$2{CLOSE}"), OPEN)
    slow = lambda x: once(parts(x), lambda p: F.when(F.size(p) < 3, x).otherwise(merged(p)))
    return chained(text(c), merge_floors_steps(slow))


#: A floor in marks; two that follow each other with one area, and three of them.
_FLOOR = rf"{OPEN}(\d+){CLOSE}([\d.]+){CLOSE}"
_FLOORS_2 = rf"{_FLOOR}[^{OPEN}]*{OPEN}(\d+){CLOSE}\2{CLOSE}"
_FLOORS_3 = rf"{_FLOORS_2}[^{OPEN}]*{OPEN}\d+{CLOSE}\2{CLOSE}"


def merge_floors_steps(slow) -> list:
    """merge_floors(), in steps; what has longer runs than two, or marks of its own, goes to `slow`."""
    marked = lambda x: F.when(x.contains("㎡"), F.regexp_replace(x, spaced(R.FLOOR), f"{OPEN}$1{CLOSE}$2{CLOSE}")).otherwise(x)

    def joined(s: Column) -> Column:
        own = s["t"].contains(OPEN) | s["t"].contains(CLOSE)
        several = s["m"].rlike(f"{OPEN}[^{OPEN}]*{OPEN}")
        quick = F.regexp_replace(F.regexp_replace(s["m"], _FLOORS_2, "$1,$3층각$2㎡"), _FLOOR, "$1층$2㎡")
        return F.when(own, slow(s["t"])).when(~several, s["t"]).when(s["m"].rlike(_FLOORS_3), slow(s["t"])).otherwise(quick)

    return [lambda x: F.struct(x.alias("t"), marked(x).alias("m")), joined]


def located(df: DataFrame, address: str = "addr_cell", detail: str = "detail_cell") -> DataFrame:
    """A record's location by all rules, as columns `town`, `rest` and `place_use`: the address, which is town and rest, with what the detail says beyond its use, floors of equal area joined. `town` is town() of the address."""
    floors = merge_floors_steps(lambda x: merge_floors(x))
    detail_steps = [*merge_lines_steps(), *strip_province_steps(), *strip_materials_steps(), *gated_steps(R.FACILITY, ("근린생활시설",)), *share_notation_steps(), *floors, lambda x: stripped(x)]
    address_steps = [*merge_lines_steps(), *strip_province_steps(), *share_notation_steps(), lambda x: stripped(x)]
    df = staged(df, {"_d": (text(F.col(detail)), detail_steps), "_a": (text(F.col(address)), address_steps)})
    land, building = spaced(R.LAND_USE), spaced(R.BUILDING_USE)
    df = df.withColumn("_land", F.col("_d").rlike(land))
    use = F.when(F.col("_land"), F.regexp_extract("_d", land, 1)).otherwise(F.regexp_extract("_d", building, 2))
    df = df.withColumns({"place_use": use, "_a": stripped(F.concat_ws(" ", "_a", stripped(F.when(F.col("_land"), F.regexp_extract("_d", land, 2)).otherwise(F.col("_d")))))})
    led = F.regexp_extract("_a", spaced(R.TOWN), 0)
    df = df.withColumn("town", led)
    sejong = F.when(F.col("_a").contains(R.SEJONG), F.regexp_extract("_a", spaced(R.TOWN_SEJONG), 0)).otherwise("")
    df = df.withColumn("town", F.rtrim(F.when(F.col("town") != "", F.col("town")).otherwise(sejong), F.lit(SPACES)))
    df = df.withColumn("rest", F.substring(F.col("_a"), F.length("town") + 1, F.length("_a")))
    return df.drop("_a", "_d", "_land")


def town(c: Column) -> Column:
    """The city and town that lead an address, or empty."""
    found = lambda x, p: F.regexp_extract(x, spaced(p), 0)
    sejong = lambda x: F.when(x.contains("세종특별자치시"), found(x, R.TOWN_SEJONG)).otherwise("")
    # a town ends in white space, so the pattern found something if it is not empty
    led = lambda x: once(found(x, R.TOWN), lambda t: F.when(t != "", t).otherwise(sejong(x)))
    return once(c, lambda x: F.when(x.isNotNull(), F.rtrim(led(x), F.lit(SPACES))))


def natural_key(c: Column) -> Column:
    """A sort key in which runs of digits compare as numbers; texts that begin with a digit come first."""
    c = text(c)
    # the first token is a text, maybe empty, and texts and numbers take turns
    found = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    tokens = F.when(c.rlike(r"^\D"), found).otherwise(F.concat(F.array(F.lit("")), found))
    number = lambda x: F.ltrim(x, F.lit("0"))
    of = lambda kind, x, long: F.struct(F.lit(kind).alias("kind"), long.alias("long"), x.alias("text"))
    return F.transform(tokens, lambda x, i: F.when(i % 2 == 1, once(number(x), lambda n: of(True, n, F.length(n)))).otherwise(of(False, x, F.lit(0))))
