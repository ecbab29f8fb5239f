"""Jaccard join on word 5-grams by vertical partitioning.

Sets that are equal are one class. The global order of n-grams is cut into fragments; a class's n-grams in one fragment
are a segment. Overlaps of two classes are counted segment by segment and summed per pair.

Which pairs are counted follows from exact bounds, so no link is lost:

- A class has a link only if four fifths of its n-grams are in other classes too. First the lowest three tenths of
  every set (in hash order) show most classes to have none (`unshared` bounds what the other class may not have sent);
  then whole sets of the rest are counted.
- The rest are ordered by rarity. Two linked classes share an n-gram in the first fifth (plus one) of both.
- Within such an n-gram's list, members are paired with a few leaders first. Links found join components, and then only
  members of different components are paired, so a large group of near copies doesn't make all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import blocks, light, saved, small_batches, table, text_bytes
from tidemill.llm.components import components
from tidemill.llm.shingles import mix, shingles

#: Words of an n-gram; share of a set that pass 1 sends, in tenths; fragments of the order for counting overlaps.
WORDS, TENTHS, FRAGMENTS = 5, 3, 4
#: Classes up to which their ids are sent to all executors to fetch texts; beyond, texts are joined by id.
SENT_IDS = 1_000_000


def class_of(grams: np.ndarray) -> int:
    """A signed 64-bit number for a set of n-grams, from a hash of its sorted members."""
    places = mix(np.arange(1, len(grams) + 1, dtype=np.uint64))
    return int(mix(np.array([(mix(grams ^ places)).sum(dtype=np.uint64) + np.uint64(len(grams))]))[0].astype(np.int64))


def _sets(batch: pa.RecordBatch, column: str = "text") -> Iterator[np.ndarray]:
    data, ends = text_bytes(batch.column(column))
    for a, b in blocks(ends):
        yield from shingles(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], WORDS)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n (n-grams), cls."""

    def work(batches):
        for batch in batches:
            found = list(_sets(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([class_of(s) for s in found], pa.int64())], names=["doc_id", "n", "cls"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, cls long")


def sent(n: int) -> int:
    """How many of n n-grams pass 1 sends."""
    return min(n, n * TENTHS // 10 + 1)


def unshared(n: int) -> int:
    """How many n-grams that a class of n sent can be absent from what a linked class sent.

    Those that the other has not, or, where its own come first, those that it has but didn't send.
    """
    worst = 0
    for m in range(-(-4 * n // 5), 5 * n // 4 + 1):
        common = -(-4 * (n + m) // 9)
        if common <= min(n, m) and common < max(n, m):
            worst = max(worst, n - common, sent(n) - sent(m) + m - common)
    return min(worst, sent(n))


#: Sizes of which more than a fifth can be absent. From 40 on there are none: sent(n) - sent(m) + m - common is below 0.175 n + 1.
SHORT = {n: unshared(n) for n in range(1, 40) if unshared(n) > n // 5}

_ROWS = "gram long, cls long, n int"


def _emit(rows: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
    """rows: n-grams, class, size."""
    size = [len(g) for g, _, _ in rows]
    grams = np.concatenate([g for g, _, _ in rows] or [np.zeros(0, np.uint64)]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.repeat(np.array([c for _, c, _ in rows], np.int64), size)), pa.array(np.repeat(np.array([n for _, _, n in rows], np.int32), size))], names=["gram", "cls", "n"])


def _low_grams(docs: DataFrame) -> DataFrame:
    """The lowest n-grams of each class, once a task."""

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            out = []
            for grams in _sets(batch):
                if len(grams) and (c := class_of(grams)) not in seen:
                    seen.add(c)
                    out.append((grams[: sent(len(grams))], c, len(grams)))
            yield _emit(out)

    return docs.select("text").mapInArrow(work, _ROWS)


def _all_grams(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """All n-grams of the wanted classes (doc_id, cls), from one document each."""

    def work(batches):
        for batch in batches:
            got = zip(_sets(batch), batch.column("cls").to_pylist(), strict=True)
            yield _emit([(grams, c, len(grams)) for grams, c in got if class_of(grams) == c])

    return docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(work, _ROWS)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of n-grams that more than one class has."""
    by = Window.partitionBy("gram")
    found = rows.withColumn("_a", F.min("cls").over(by)).withColumn("_b", F.max("cls").over(by)).filter("_a <> _b").drop("_a", "_b")
    return found.dropDuplicates(["gram", "cls"])


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs (a, b) -> those whose sets link: partial overlaps of segments, summed per pair."""
    left = segments.select(F.col("cls").alias("a"), "fragment", F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = segments.select(F.col("cls").alias("b"), "fragment", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    parts = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"])
    parts = parts.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    return parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common")).filter("9 * common >= 4 * (na + nb)").select("a", "b")


def linked_classes(docs: DataFrame, doc_classes: DataFrame) -> DataFrame:
    """-> vertex, root: components of classes with links."""
    low = saved(_shared(_low_grams(docs)), "lowgrams")
    # of the n-grams sent, at most a fifth of the whole set may be in no other class, more in the short sets
    least = F.least(F.col("n"), F.floor(F.col("n") * TENTHS / 10) + 1)
    spare = F.floor(F.col("n") / 5)
    for n, most in SHORT.items():
        spare = F.when(F.col("n") == n, most).otherwise(spare)
    maybe = low.groupBy("cls").agg(F.count("*").alias("k"), F.first("n").alias("n")).filter(least - F.col("k") <= spare).select("cls")
    wanted = saved(doc_classes.filter("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(maybe, "cls"), "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted
    rows = saved(_shared(_all_grams(docs, ids)), "grams")

    enough = rows.groupBy("cls").agg(F.count("*").alias("k"), F.first("n").alias("n")).filter("5 * k >= 4 * n").select("cls")
    rows = rows.join(enough, "cls", "left_semi").withColumn("df", F.count("*").over(Window.partitionBy("gram"))).filter("df > 1")
    rows = saved(rows.withColumn("k", F.count("*").over(Window.partitionBy("cls"))).filter("5 * k >= 4 * n"), "grams")
    # n-grams of no other class come first, then the rarer ones
    # the global order as one number: how many classes have an n-gram, then the upper bits of its hash
    rows = rows.withColumn("place", F.shiftleft(F.least("df", F.lit((1 << 20) - 1)), 43) + F.shiftrightunsigned("gram", 21))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("place", "gram"))
    first = rows.withColumn("_r", rank + F.col("n") - F.col("k")).filter(F.col("_r") <= F.floor(F.col("n") / 5) + 1).select("gram", "cls", "n", "k", F.col("_r").alias("r"))
    first = saved(first, "prefixes")
    bounds = rows.agg(F.percentile_approx("place", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).first()[0] or []
    fragment = sum(((F.col("place") >= b).cast("int") for b in bounds), F.lit(0))
    segments = rows.groupBy("cls", "n", fragment.alias("fragment")).agg(F.collect_list("gram").alias("grams"))
    segments = saved(segments, "segments")

    # sizes are near, enough n-grams are shared with anyone, and if this n-gram is the first that both have, enough follow it
    fits = "5 * least(na, nb) >= 4 * greatest(na, nb) and 9 * least(ka, kb, na - ra + 1, nb - rb + 1) >= 4 * (na + nb)"
    member = F.struct("cls", "n", "k", "r")
    leaders = first.groupBy("gram").agg(F.min(F.struct((F.col("n") - F.col("k")).alias("o"), member.alias("m")))["m"].alias("x"), *(F.min(F.struct(F.xxhash64(F.lit(s), "cls").alias("o"), member.alias("m")))["m"].alias(f"x{s}") for s in (1, 2)))
    leaders = leaders.select("gram", F.explode(F.array_distinct(F.array("x", "x1", "x2"))).alias("x"))
    pairs = first.join(leaders, "gram").select(F.least("cls", "x.cls").alias("a"), F.greatest("cls", "x.cls").alias("b"), F.col("n").alias("na"), F.col("x.n").alias("nb"), F.col("k").alias("ka"), F.col("x.k").alias("kb"), F.col("r").alias("ra"), F.col("x.r").alias("rb"))
    tried = saved(pairs.filter("a <> b").filter(fits).select("a", "b").distinct(), "pairs")
    links = saved(_overlaps(tried, segments), "found")

    roots = components(links)
    parted = first.join(roots, first["cls"] == roots["vertex"], "left").select("gram", "cls", "n", "k", "r", F.coalesce("root", "cls").alias("c"))
    by = Window.partitionBy("gram")
    parted = parted.withColumn("_a", F.min("c").over(by)).withColumn("_b", F.max("c").over(by)).filter("_a <> _b").drop("_a", "_b")
    x, y = (parted.select("gram", F.col("cls").alias(u), F.col("n").alias("n" + u), F.col("k").alias("k" + u), F.col("r").alias("r" + u), F.col("c").alias("c" + u)) for u in "ab")
    rest = x.join(y, "gram").filter("a < b and ca <> cb").filter(fits).select("a", "b").distinct()
    rest = saved(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = saved(_overlaps(rest, segments), "found")
    return components(links.union(more))


def groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> a row each: doc_id, n, cls, root (a class of its component; null without n-grams), component_id."""
    docs = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    doc_classes = saved(classes(docs), "classes")
    linked = linked_classes(docs, doc_classes)
    least = doc_classes.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"))
    rooted = least.join(linked, least["cls"] == linked["vertex"], "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(roots, "root").select(F.col("cls").alias("_c"), "component_id", "root")
    found = doc_classes.join(named, (F.col("cls") == F.col("_c")) & (F.col("n") > 0), "left")
    return found.select("doc_id", "n", "cls", "root", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id: the least doc_id reachable by links of likeness 0.8 or more.

    Null and blank texts have no n-grams and link with nothing; rows of a null id have a null component. Repeated ids
    and texts each have a row. A very long text is one set, held by one task. An empty table gives no rows. N-grams and
    classes are 64-bit hashes.
    """
    return groups(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with one row of each component: that of its least (doc_id, class), and of that the least text.

    Rows without an id or without n-grams stay. Classes of rows are only taken again for ids that repeat.
    """
    found = saved(groups(docs), "groups")
    counted = found.filter("root is not null and doc_id is not null")
    first = counted.groupBy("root").agg(F.min(F.struct("doc_id", "cls")).alias("first"))
    stays = saved(counted.select("doc_id", "cls", "root").distinct().join(first, "root").withColumn("stays", F.struct("doc_id", "cls") == F.col("first")).select("doc_id", "cls", "stays"), "stays")
    many = saved(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "many")
    gone = saved(stays.filter("not stays").join(many, "doc_id", "left_anti").select("doc_id"), "gone")
    kept = docs.join(light(gone, SENT_IDS), "doc_id", "left_anti").select(*docs.columns)
    if many.isEmpty():
        return kept
    many = light(many, SENT_IDS)
    rows = small_batches(kept.join(many, "doc_id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*docs.columns).alias("_row")))

    def classed(batches):
        for batch in batches:
            sets = list(_sets(batch))
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("_row"), pa.array([class_of(g) if len(g) else None for g in sets], pa.int64())], names=["text", "_row", "cls"])

    repeated = rows.mapInArrow(classed, T.StructType([*rows.schema.fields, T.StructField("cls", T.LongType())]))
    blank = repeated.filter("cls is null").select("_row.*")
    chosen = stays.filter("stays").select(F.col("doc_id").alias("_d"), F.col("cls").alias("_c"))
    one = repeated.join(chosen, (F.col("cls") == F.col("_c")) & (F.col("_row.doc_id").cast("long") == F.col("_d")))
    one = one.groupBy("_d", "_c").agg(F.min_by("_row", F.struct("text", F.to_json("_row"))).alias("_row")).select("_row.*")
    return kept.join(many, "doc_id", "left_anti").select(*docs.columns).unionByName(one).unionByName(blank)


def op10_ngramjoin(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def sql(docs: str = "documents") -> str:
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from {docs}),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from w),
grams as (select doc_id, len(s) n, unnest(s) g from sets),
pairs as (select a.doc_id a, b.doc_id b from grams a join grams b on a.g = b.g and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a)
select s.doc_id, cast(len(s.s) as bigint) n_shingles, coalesce(least(s.doc_id, r.m), s.doc_id) component_id
from sets s left join (select a, min(b) m from reach group by a) r on r.a = s.doc_id"""


OP10_SQL = sql()
