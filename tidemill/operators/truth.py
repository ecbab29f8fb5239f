"""Groups of cases from positioned words of a printed notice, and measurement against them."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill import rules as R
from tidemill.functions import text as X

_HEADER = r"^\[(" + "|".join(R.GROUPS) + r")\]$"


def header_group(word: Column) -> Column:
    """P11. The group of a word that is exactly a bracketed group name, else null."""
    return F.nullif(F.regexp_extract(X.stripped(X.text(word)), _HEADER, 1), F.lit(""))


def group_headers(words: DataFrame) -> DataFrame:
    """(doc_id, page, top, x0, text) -> doc_id, page, gtop, gx0, grp."""
    return words.withColumn("grp", header_group(F.col("text"))).filter("grp is not null").select("doc_id", "page", F.col("top").alias("gtop"), F.col("x0").alias("gx0"), "grp")


def _taken(heads: list[dict], numbers: list[dict], down: float, aside: float) -> list[tuple[int, int]]:
    """A page's prefixes in word order, each with the nearest free number below it: pairs of word numbers."""
    at, used, out = [n["no"] for n in numbers], set(), []
    for head in heads:
        best = None
        for i in range(bisect_right(at, head["no"]), len(numbers)):
            if at[i] in used:
                continue
            dy = numbers[i]["top"] - head["top"]
            if dy > down:
                break
            if dy > 0 and abs(numbers[i]["x0"] - head["x0"]) <= aside:
                best = min(best or (dy, at[i]), (dy, at[i]))
        if best:
            used.add(best[1])
            out.append((head["no"], best[1]))
    return out


def stitched(words: DataFrame, down: float = 30, aside: float = 60) -> DataFrame:
    """J5. Case candidates of words: whole numbers, and split ones: a prefix takes the nearest number that follows it below, near its column.

    Numbers are used once, in word order, and a scan ends at the first free number that is more than `down` below. A page's
    prefixes and numbers are one row, so no pairs are made; Python scans them.
    """
    inline = X.spaced(r"^(\d{4})\s*타\s*경\s*(\d+)$")
    prefix = X.spaced(r"^(\d{4})\s*타\s*경$")
    case = lambda y, n: F.concat(y, F.lit("타경"), n)
    whole = words.filter(F.col("text").rlike(inline)).select("doc_id", "page", "word_no", "top", "x0", case(F.regexp_extract("text", inline, 1), F.regexp_extract("text", inline, 2)).alias("case_no"), F.lit("inline").alias("source"))
    heads = words.filter(F.col("text").rlike(prefix)).select("doc_id", "page", "word_no", "top", "x0", F.regexp_extract("text", prefix, 1).alias("_year"))
    numbers = words.filter(F.col("text").rlike(r"^\d+$")).select("doc_id", "page", F.col("word_no").alias("number_no"), F.col("top").alias("_top"), F.col("x0").alias("_x0"), F.col("text").alias("_number"))
    # the prefixes and the numbers of a page, in word order: as much as stands on one page
    listed = lambda df, no, top, x0, name: df.filter(F.col(top).isNotNull() & F.col(x0).isNotNull()).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.col(no).cast("long").alias("no"), F.col(top).alias("top"), F.col(x0).alias("x0")))).alias(name))
    pages = listed(heads, "word_no", "top", "x0", "heads").join(listed(numbers, "number_no", "_top", "_x0", "numbers"), ["doc_id", "page"])
    kinds = {f.name: f.dataType.simpleString() for f in words.schema}

    def work(batches):
        for batch in batches:
            pairs = [_taken(h, n, down, aside) for h, n in zip(batch.column("heads").to_pylist(), batch.column("numbers").to_pylist(), strict=True)]
            row = pa.array([i for i, found in enumerate(pairs) for _ in found], pa.int64())
            flat = [x for found in pairs for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("page").take(row), pa.array([x for x, _ in flat], pa.int64()), pa.array([x for _, x in flat], pa.int64())], names=["doc_id", "page", "word_no", "number_no"])

    taken = pages.mapInArrow(work, f"doc_id {kinds['doc_id']}, page {kinds['page']}, word_no long, number_no long")
    taken = taken.join(heads, ["doc_id", "page", "word_no"]).join(numbers.select("doc_id", "page", "number_no", "_number"), ["doc_id", "page", "number_no"])
    split = taken.select("doc_id", "page", "word_no", "top", "x0", case(F.col("_year"), F.col("_number")).alias("case_no"), F.lit("prefix").alias("source"))
    return whole.unionByName(split)


def table_cases(cells: DataFrame) -> DataFrame:
    """P12. (doc_id, page, table_no, row_no, cell, top, x0) -> candidates at the table's corner; tables whose first cell names a heading give none."""
    pattern = X.spaced(r"(\d{4})\s*타\s*경\s*(\d+)")
    first = F.first("cell").over(Window.partitionBy("doc_id", "page", "table_no").orderBy("row_no"))
    rows = cells.withColumn("_first", X.text(first)).filter(~F.col("_first").rlike("사건번호|매각물건|물건번호") & F.col("cell").rlike(pattern))
    return rows.select("doc_id", "page", F.col("row_no").alias("word_no"), "top", "x0", F.concat(F.regexp_extract("cell", pattern, 1), F.lit("타경"), F.regexp_extract("cell", pattern, 2)).alias("case_no"), F.lit("table").alias("source"))


def candidates(words: DataFrame, tables: DataFrame) -> DataFrame:
    """U1. Candidates of words, then of tables."""
    return words.withColumn("src_order", F.lit(0)).unionByName(tables.withColumn("src_order", F.lit(1)))


def topmost(found: DataFrame) -> DataFrame:
    """W10. Of a page's candidates for one case, the topmost; then that of words, then the first listed."""
    order = F.struct("top", "src_order", "word_no", "x0", "source")
    best = found.groupBy("doc_id", "page", "case_no").agg(F.min(order).alias("_b"))
    return best.select("doc_id", "page", "case_no", "_b.top", "_b.x0", "_b.source")


def assign_groups(cases: DataFrame, headers: DataFrame, aside: float = 100) -> DataFrame:
    """J4 and W5. The nearest header above in the case's column, else above anywhere, else the group before it in reading order, else 기타."""
    above = cases.join(headers, ["doc_id", "page"]).filter("gtop <= top")
    near = F.struct((F.col("top") - F.col("gtop")).alias("dy"), F.col("grp").alias("g"))
    column = F.abs(F.col("gx0") - F.col("x0")) <= aside
    found = above.groupBy("doc_id", "page", "case_no").agg(F.coalesce(F.min(F.when(column, near)), F.min(near))["g"].alias("own"))
    all_ = cases.join(found, ["doc_id", "page", "case_no"], "left")
    w = Window.partitionBy("doc_id").orderBy("page", "top", "x0", "case_no").rowsBetween(Window.unboundedPreceding, 0)
    return all_.withColumn("grp", F.coalesce(F.last("own", True).over(w), F.lit(R.OTHER))).drop("own")


def reading_order(df: DataFrame) -> DataFrame:
    """O3."""
    return df.orderBy("doc_id", "page", "top", "x0")


def cases_by_group(assigned: DataFrame) -> DataFrame:
    """A5. Different cases of each document and group, in order of first appearance."""
    first = assigned.groupBy("doc_id", "grp", "case_no").agg(F.min(F.struct("page", "top", "x0")).alias("_at"))
    return first.groupBy("doc_id", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "case_no"))), lambda x: x["case_no"]).alias("cases"))


def self_check(words: DataFrame, assigned: DataFrame) -> DataFrame:
    """A10. Per document: cases in its text, extracted ones, what is missing on either side, and whether nothing is."""
    pattern = X.spaced(r"\d{4}\s*타\s*경\s*\d+")
    said = words.select("doc_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), X.squeezed)).alias("case_no")).distinct().withColumn("_said", F.lit(1))
    got = assigned.select("doc_id", "case_no").distinct().withColumn("_got", F.lit(1))
    both = said.join(got, ["doc_id", "case_no"], "full")
    flag = lambda c: F.count_if(F.col(c).isNotNull())
    return both.groupBy("doc_id").agg(flag("_said").alias("in_text"), flag("_got").alias("extracted"), F.count_if(F.col("_got").isNull()).alias("missing"), F.count_if(F.col("_said").isNull()).alias("unknown"), F.bool_and(F.col("_said").isNotNull() & F.col("_got").isNotNull()).alias("passed"))


def sections(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """W12. A text cut at [group] headers -> doc, grp, case_no, at: first mention of a case in each section; what precedes the first header is left out."""
    header = r"\[(" + "|".join(R.GROUPS) + r")\]"
    parts = df.select(doc, F.posexplode(F.split(F.regexp_replace(X.text(F.col(text)), header, X.OPEN + "$1" + X.CLOSE), X.OPEN)).alias("section", "_t")).filter("section > 0")
    cases = parts.select(doc, "section", F.substring_index("_t", X.CLOSE, 1).alias("grp"), F.posexplode(X.case_numbers(F.substring_index("_t", X.CLOSE, -1))).alias("at", "case_no"))
    return cases.groupBy(doc, "section", "grp", "case_no").agg(F.min("at").alias("at"))


def compare(ours: DataFrame, truth: DataFrame) -> DataFrame:
    """J6. Different (doc_id, grp, case_no) of both sides with verdict match, missing or extra."""
    keys = ["doc_id", "grp", "case_no"]
    a = ours.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").otherwise("match").alias("verdict"))


def both_differences(ours: DataFrame, truth: DataFrame) -> DataFrame:
    """U2. Rows that one side has more often than the other, as often as it has more of them. Each side is read and summed once for both directions."""
    names = ours.columns
    n, more = F.sum("_n"), F.abs("_n").cast("int")
    counted = ours.withColumn("_n", F.lit(-1)).unionByName(truth.select(*names).withColumn("_n", F.lit(1))).groupBy(*names).agg(n.alias("_n")).filter("_n <> 0")
    return counted.select(*names, F.when(F.col("_n") > 0, "missing").otherwise("extra").alias("side"), F.explode(F.array_repeat(F.lit(0), more)).alias("_copy")).drop("_copy")


def accuracy(compared: DataFrame, published: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A4. Per document and in total (doc_id null): counts, the rate in percent to one place, and whether, or how many, failed.

    errors (doc_id, error): documents that couldn't be measured. They have a row each, and count in none of the sums but `failed`.
    """
    failed = (published.select("doc_id").limit(0) if errors is None else errors.select("doc_id")).distinct().withColumn("failed", F.lit(1))
    counts = compared.filter(F.col("grp").isin(R.GROUPS)).groupBy("doc_id").agg(F.count_if(F.col("verdict") != "extra").alias("truth_total"), F.count_if(F.col("verdict") == "match").alias("matched"))
    ours = published.groupBy("doc_id").agg(F.count_if(F.col("grp").isin(R.GROUPS)).alias("ours"), F.count_if(F.col("grp") == R.EXCLUDED).alias("excluded"))
    names = ("truth_total", "matched", "ours", "excluded")
    rows = counts.join(ours, "doc_id", "full").join(failed, "doc_id", "full")
    rows = rows.select("doc_id", *(F.when(F.col("failed").isNull(), F.col(c)).alias(c) for c in names), "failed")
    total = rows.rollup("doc_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*names, "failed")), F.grouping("doc_id").alias("is_total"))
    return total.withColumn("rate", F.when(F.col("truth_total") > 0, F.round(F.col("matched") / F.col("truth_total") * 100, 1)).otherwise(0.0))
