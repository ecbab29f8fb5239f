"""Benchmark decontamination by winnowing; DataFrame functions only.

A window is WIDTH consecutive words of an item (a shorter item is one window of its own width). Every window has
WIDTH - k + 1 k-grams of words, and its least k-gram hash is its fingerprint. Neighbouring windows mostly share it, so a
text is a list of runs: a fingerprint, where the run begins, and a hash of each of its windows. A span that a document
shares with an item, of a window's length or more, holds equal windows, which have equal fingerprints: none is lost.

Runs meet the items' fingerprints by hash join. A hit is extended over the run: its windows are compared whole with those
of the items under that fingerprint, by two hashes that don't depend on each other, 128 bits in all. What stays is which
words of the text stand in windows of which items.

Documents are read once, and their texts don't move: a document gives a head row and its runs, of which those without a
hit go in the same stage. What was found is held by text, so copies share it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import light, saved, table

WIDTH = 10
#: Words after lower-casing A-Z.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RUN = "array<struct<width:int,fp:bigint,first:int,windows:array<bigint>>>"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; texts of one byte a character take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def grams(width: int) -> int:
    """Words of a k-gram for windows of a width: half of it, so that about two of width - k + 2 windows bring a new fingerprint."""
    return max(1, width // 2)


def _shifted(a: Column, b: Column, by: int, f) -> Column:
    """f of each element of a and the one `by` places later of b; the last ones, without a partner, are cut by the caller."""
    return F.zip_with(a, F.slice(b, by + 1, F.greatest(F.size(b) - by, F.lit(0))), f)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)


def _powers(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length()) if 1 << i <= n]


def with_spans(df: DataFrame, sizes: set[int]) -> DataFrame:
    """df with column g1 (a hash of each word) -> also g<n> for each n: hashes of the n words from each place on, by doubling."""
    need = set()
    rest = sorted(sizes - {1}, reverse=True)
    while rest:
        n = rest.pop(0)
        if n > 1 and n not in need:
            need.add(n)
            low = 1 << ((n - 1).bit_length() - 1)
            rest += [low, n - low]
    for n in sorted(need):
        low = 1 << ((n - 1).bit_length() - 1)
        df = df.withColumn(f"g{n}", _shifted(F.col(f"g{low}"), F.col(f"g{n - low}"), low, lambda x, y: F.xxhash64(x, y)))
    return df


def with_least(df: DataFrame, width: int) -> DataFrame:
    """-> also m<width>: the least k-gram hash of the window at each place."""
    k = grams(width)
    count = width - k + 1
    df = df.withColumn("_m1", F.col(f"g{k}"))
    for low in _powers(count)[:-1]:
        df = df.withColumn(f"_m{2 * low}", _shifted(F.col(f"_m{low}"), F.col(f"_m{low}"), low, _least))
    top = _powers(count)[-1]
    at = F.size("g1") - width + 1
    least = _shifted(F.col(f"_m{top}"), F.col(f"_m{top}"), count - top, _least) if count > top else F.col(f"_m{top}")
    df = df.withColumn(f"m{width}", F.when(at > 0, F.slice(least, 1, F.greatest(at, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    return df.drop(*(f"_m{p}" for p in _powers(count)))


def with_windows(df: DataFrame, widths: list[int]) -> DataFrame:
    """df with column text -> also n_words, and for each width m<width> and g<width>."""
    df = df.withColumn("g1", F.transform(F.regexp_extract_all(lowered(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(w)))
    df = with_spans(df, {x for w in widths for x in (w, grams(w))})
    for width in widths:
        df = with_least(df, width)
    return df.withColumn("n_words", F.size("g1").cast("long"))


def _runs(width: int) -> Column:
    m, g = F.col(f"m{width}"), F.col(f"g{width}")
    starts = F.col(f"_starts{width}")
    run = lambda s, i: F.struct(
        F.lit(width).alias("width"), F.get(m, s).alias("fp"), s.alias("first"), F.slice(g, s + 1, F.coalesce(F.get(starts, i + 1), F.size(m)) - s).alias("windows")
    )
    return F.transform(starts, run).cast(_RUN)


def _starts(width: int) -> Column:
    m = F.col(f"m{width}")
    places = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda s: (s == 0) | (F.get(m, s) != F.get(m, s - 1)))


def item_windows(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """items (item_id, text) -> item_id, width, fp, window; and the widths there are, at most WIDTH."""
    items = items.select("item_id", "text").withColumn("_n", F.least(F.regexp_count("text", F.lit(TERM.replace(r"\x60", r"\x40\x5B-\x60"))), F.lit(WIDTH)))
    widths = sorted(r["_n"] for r in items.filter("_n > 0").select("_n").distinct().collect())
    found = None
    items = with_windows(items, widths)
    for width in widths:
        own = items.filter(F.col("_n") == width).select("item_id", F.lit(width).alias("width"), F.explode(F.arrays_zip(F.col(f"m{width}").alias("fp"), F.slice(f"g{width}", 1, F.size(f"m{width}")).alias("window"))).alias("x"))
        own = own.select("item_id", "width", "x.fp", "x.window")
        found = own if found is None else found.union(own)
    if found is None:
        found = items.sparkSession.createDataFrame([], "item_id long, width int, fp long, window long")
    return saved(found.distinct(), "windows"), widths


def _covered(spans: Column) -> Column:
    """Words that lie in any of the spans (pos, width)."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(done, x):
        stop = (x["pos"] + x["width"]).cast("long")
        return F.struct(F.greatest(done["end"], stop).alias("end"), (done["n"] + F.greatest(stop - F.greatest(x["pos"].cast("long"), done["end"]), F.lit(0).cast("long"))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda x: x["n"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, n_words, n_hit, n_items, item_ids, contaminated: a row for each of docs.

    A null or empty text has no words and no hit; an item without words hits nothing. Repeated rows and equal texts have
    equal results; items of one id count once, and an item without an id hits but isn't listed. A long run of one
    word is one run of windows. A very long text is one row of arrays. Without items nothing is contaminated; without docs there
    are no rows. Other columns play no part.
    """
    bench, widths = item_windows(items)
    docs = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"), "text")
    docs = with_windows(docs, widths)
    for width in widths:
        docs = docs.withColumn(f"_starts{width}", _starts(width))
    head = F.array(F.struct(F.lit(None).alias("width"), F.lit(None).alias("fp"), F.lit(None).alias("first"), F.lit(None).alias("windows"))).cast(_RUN)
    rows = docs.select("doc_id", "key", "n_words", F.explode(F.concat(head, *(_runs(w) for w in widths))).alias("x")).select("doc_id", "key", "n_words", "x.*")
    fps = light(saved(bench.select("width", "fp").distinct(), "fingerprints")).withColumn("_hit", F.lit(True))
    rows = saved(rows.join(fps, ["width", "fp"], "left").filter("width is null or _hit").drop("_hit"), "winnowed")

    windows = light(saved(bench.select("width", "fp", "window").distinct(), "distinct_windows"))
    near = rows.filter("width is not null").select("key", "width", "fp", "first", F.posexplode("windows").alias("_i", "window"))
    near = saved(near.select("key", "width", "fp", "window", (F.col("first") + F.col("_i")).alias("pos")).join(windows, ["width", "fp", "window"], "left_semi").distinct(), "hits")
    spans = near.groupBy("key").agg(F.collect_set(F.struct("pos", "width")).alias("_spans")).select("key", _covered(F.col("_spans")).alias("n_hit"))
    named = near.select("key", "width", "fp", "window").distinct().join(bench.filter("item_id is not null"), ["width", "fp", "window"]).select("key", "item_id").distinct()
    named = named.groupBy("key").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    found = light(saved(spans.join(named, "key", "left"), "contaminated"))

    none = F.array().cast("array<string>")
    out = rows.filter("width is null").select("doc_id", "key", "n_words").join(found, "key", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("item_ids", F.coalesce("item_ids", none))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def op13_winnowing(spark, sf_dir) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


OP13_SQL = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
bw as (select item_id, ws, least(len(ws), 10) w from b where len(ws) > 0),
x as (select distinct item_id, w, array_to_string(ws[p : p + w - 1], ' ') s from (select *, unnest(range(1, len(ws) - w + 2)) p from bw)),
k as (select distinct w from x),
dw as (select r, w, p, array_to_string(ws[p : p + w - 1], ' ') s from (select *, unnest(range(1, len(ws) - w + 2)) p from d, k where len(ws) >= w)),
h as (select r, p, dw.w, item_id from dw join x on dw.w = x.w and dw.s = x.s),
n as (select r, count(distinct q) n_hit from (select r, unnest(range(p, p + w)) q from h) group by 1),
i as (select r, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from h group by 1)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (r) left join i using (r)"""
