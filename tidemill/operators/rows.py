"""From cell rows and notice texts to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill import rules as R
from tidemill.functions import text as X

CELLS = ["case_cell", "item_cell", "use_cell", "addr_cell", "detail_cell", "price_cell", "note_cell"]


def rows_normalise(df: DataFrame, cells: str = "cells") -> DataFrame:
    """S3. Rows of seven cells are kept, with glued prices cut; two cells are an address and a detail; others go."""
    c, n = F.col(cells), F.size(cells)
    blank = F.lit("")
    seven = F.when(n == 7, F.array(c)).when(n == 2, F.array(F.concat(F.array(blank, blank, blank), c, F.array(blank, blank))))
    # exploded and not filtered: a filter would be pushed below and make the cells again for each of its tests
    rows = df.select(*(k for k in df.columns if k != cells and k not in CELLS), F.explode(seven).alias("_cells"))
    named = [(X.split_price(F.get("_cells", F.lit(i))) if name == "price_cell" else F.coalesce(F.get("_cells", F.lit(i)), blank)).alias(name) for i, name in enumerate(CELLS)]
    return rows.select(*(k for k in df.columns if k != cells and k not in CELLS), *named)


def as_cells(df: DataFrame) -> DataFrame:
    """Named cells to an array of them."""
    return df.select(*(k for k in df.columns if k not in CELLS), F.array(*CELLS).alias("cells"))


def is_header(cells: list[str] | None = None) -> Column:
    """Whether the cells of a row are column headings."""

    def names(joined: Column) -> Column:
        has = joined.contains
        return (has("사건번호") & (has("매 각 물 건") | has("매각물건"))) | has("물건\n번호") | (has("용 도") & has("소 재 지")) | (has("감정평가액") & has("최저매각가격") & has("비"))

    return X.once(F.concat_ws(" ", *(cells or CELLS)), names)


def drop_headers(df: DataFrame, cells: list[str] | None = None) -> DataFrame:
    """P1."""
    return df.filter(~is_header(cells))


def header_table(df: DataFrame, table_no: str = "table_no") -> DataFrame:
    """P10. The rows of a document's first table."""
    return df.filter(F.col(table_no) == 0)


def body_tables(df: DataFrame, table_no: str = "table_no") -> DataFrame:
    """P10. The rows of the others."""
    return df.filter(F.col(table_no) > 0)


def _by(doc: str, order: list[str]):
    return Window.partitionBy(doc).orderBy(*order)


def islands(df: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("ok", "seq")) -> DataFrame:
    """W2. Rows after a document's first case, with rec_no, case_no, dup_tag, item_no and use carried down.

    A record starts at a row with a case number, and at a numeric item that is not the current one. All windows share one
    partitioning, by document.
    """
    w = _by(doc, list(order))
    running, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    for c in CELLS:
        df = df.withColumn(c, X.stripped(X.text(F.col(c))))
    numbers = X.case_numbers(F.col("case_cell"))
    tag = F.regexp_extract("case_cell", "(중복|병합)", 1)
    numeric = F.col("item_cell").rlike(r"^\d+$")
    df = df.withColumn("_nos", numbers).withColumn("_case", F.size("_nos") > 0)
    df = df.withColumn("_tag", F.when(F.col("_case"), F.when((tag != "") & (F.size("_nos") >= 2), F.concat(F.get("_nos", F.lit(1)), F.lit("["), tag, F.lit("]"))).otherwise("")))
    df = df.withColumn("_no", F.get("_nos", F.lit(0))).drop("_nos")
    df = df.withColumn("_item", F.when(F.col("_case"), F.when(F.col("item_cell") == "", "1").otherwise(F.col("item_cell"))).when(numeric, F.col("item_cell")))
    df = df.select("*", F.sum(F.col("_case").cast("int")).over(running).alias("_seg"), F.last("_item", True).over(before).alias("_last"))
    # _item is the cell of a numeric one
    df = df.filter("_seg > 0").withColumn("_start", F.col("_case") | F.coalesce((F.col("_item") != F.col("_last")), F.lit(False)))
    used = F.struct(F.col("_seg").alias("seg"), F.col("use_cell").alias("u"))
    # all in one pass: a use counts as far as its case
    df = df.select(
        "*", F.sum(F.col("_start").cast("int")).over(running).alias("rec_no"), F.last("_no", True).over(running).alias("case_no"), F.last("_tag", True).over(running).alias("dup_tag"),
        F.last(F.when(F.col("_start") & (F.col("use_cell") != ""), used), True).over(running).alias("_used"), F.last(F.when(F.col("_start"), F.col("_item")), True).over(running).alias("item_no"),
    )
    own = {"_tag", "_no", "_item", "_seg", "_last", "_case", "_start", "_used"}
    use = F.when(F.col("_used.seg") == F.col("_seg"), F.col("_used.u")).otherwise("")
    return df.select(*(k for k in df.columns if k not in own and k != "item_no"), "_case", "_start", use.alias("use"), "item_no")


def assemble(df: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("ok", "seq"), also: list[Column] | None = None, by: tuple[str, ...] = (), fields: dict[str, str] | None = None) -> DataFrame:
    """A1. islands() -> a row a record: locations and notes in order, price and minimum of the first row with a price; and further sums over its rows.

    `by`: columns that part a record further; a part without the record's first row has no use. `fields`: the
    locations' fields and the columns that they are taken of, where not addr and detail of the cells.
    """
    fields = fields or {"addr": "addr_cell", "detail": "detail_cell"}
    at = F.struct(*order)
    place = F.struct(at.alias("at"), *(F.col(column).alias(f) for f, column in fields.items()))
    keep = F.col("_case") | (F.col("addr_cell") != "") | (F.col("detail_cell") != "")
    first_price = F.min(F.when(F.col("price_cell") != "", F.struct(at.alias("at"), F.col("price_cell").alias("p"))))["p"]
    grouped = df.groupBy(doc, "rec_no", *by).agg(
        F.first("case_no").alias("case_no"),
        F.first("dup_tag").alias("dup_tag"),
        F.first("item_no").alias("item_no"),
        F.min(F.when(F.col("_start"), F.struct(at.alias("at"), F.col("use").alias("u"))))["u"].alias("use"),
        F.sort_array(F.collect_list(F.when(keep, place))).alias("_places"),
        first_price.alias("_price_cell"),
        F.sort_array(F.collect_list(F.when(F.col("note_cell") != "", F.struct(at.alias("at"), F.col("note_cell").alias("n"))))).alias("_notes"),
        *(also or []),
    )
    known = {doc, "rec_no", "case_no", "dup_tag", "item_no", "use", "_places", "_price_cell", "_price", "_notes"}
    grouped = grouped.withColumn("_price", X.prices(F.col("_price_cell")))
    return grouped.select(
        doc, "rec_no", "case_no", "dup_tag", "item_no", "use",
        F.transform("_places", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("locations"),
        "_price.price", "_price.min_price", "_price.price_value",
        F.array_join(F.transform("_notes", lambda x: x["n"]), "\n").alias("note"), *(c for c in grouped.columns if c not in known),
    )


def row_text(cells: list[str] | None = None) -> Column:
    return F.concat_ws(" | ", *(cells or CELLS))


def assemble_text(df: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("ok", "seq")) -> DataFrame:
    """A13. One text a document: cells joined by bars, rows by line breaks."""
    rows = F.array_sort(F.collect_list(F.struct(*order, row_text().alias("_line"))))
    return df.groupBy(doc).agg(F.array_join(F.transform(rows, lambda x: x["_line"]), "\n").alias("text"))


def segment(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """W3. Texts cut at case numbers -> block_no, case_no, all_nos, block_text.

    A number with less than 30 characters and no line break after the one before belongs to its block. Text before the
    first number goes; a text without one is a single block of an unknown case.
    """
    cut = F.split(F.regexp_replace(X.text(F.col(text)), f"({X.spaced(R.CASE)})", X.OPEN + "$1"), X.OPEN)
    placed = F.transform(cut, lambda t, i: F.struct(i.alias("_pos"), t.alias("_seg")))
    # all of it under the explode, so that a text is cut once and not for every part
    placed = F.when(F.size(placed) == 1, placed).otherwise(F.slice(placed, F.lit(2), F.greatest(F.size(placed) - 1, F.lit(0))))
    parts = df.select(doc, F.explode(placed).alias("_p")).select(doc, "_p.*")
    w = _by(doc, ["_pos"])
    gap = X.stripped(F.substring(F.lag("_seg").over(w), 11, 1 << 30))
    parts = parts.withColumn("_new", F.coalesce(~((F.length(gap) < 30) & ~gap.contains("\n")), F.lit(True)).cast("int"))
    parts = parts.withColumn("block_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = parts.groupBy(doc, "block_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_seg"))), lambda x: x["_seg"]), "").alias("_t"))
    blocks = blocks.withColumn("block_text", X.stripped(F.col("_t"))).withColumn("all_nos", X.case_numbers(F.col("block_text")))
    return blocks.select(doc, "block_no", F.coalesce(F.get("all_nos", F.lit(0)), F.lit(R.UNKNOWN_CASE)).alias("case_no"), "all_nos", "block_text")


def inventory(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A11. Number of blocks and the cases in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "case_no"))), lambda x: x["case_no"])
    return blocks.groupBy(doc).agg(F.count("*").alias("blocks"), ordered.alias("cases"))


def headers(df: DataFrame, text: str = "text") -> DataFrame:
    """F18 over documents."""
    return df.withColumn("_h", X.header(F.col(text))).select(*df.columns, "_h.*")


def placeholders(df: DataFrame, error: str = "error") -> DataFrame:
    """P8. Failed records become placeholders that keep their place and keys; logs.split_failures keeps the failed rows as they were."""
    failed = F.col(error).isNotNull()
    marks = {"address": F.lit(R.FAILED), "use": F.lit(""), "note": F.concat(F.lit("편집 실패: "), F.col(error)), "grp": F.lit(R.OTHER)}
    return df.select(*(F.when(failed, marks[c]).otherwise(F.col(c)).alias(c) if c in marks else F.col(c) for c in df.columns if c != error))
