"""Mixing sources to target weights by Pareto order sampling.

Every step is a DataFrame expression, aggregate, window or join.

- Sources get shares by weight of a word budget; none may exceed a multiple of its own words (water filling).
- Within a source a document's expected copies are a common factor times its importance, at most the same multiple.
  The whole part is certain. The fraction is an inclusion probability.
- Documents rank by random odds divided by inclusion odds, and the source takes them in that order until the
  words still wanted are nearest. The order is found in two steps: rank buckets are summed per source, and only
  the one bucket in which a source's sum is reached is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, light, saved, table, unit_hash

#: Rank buckets of a source; bounds the rows of the prefix sum at buckets x sources.
BUCKETS = 65536
#: Importance is this minus the number of binary digits of the document's size, so that long texts repeat a little less.
IMPORTANCE = 64


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> the same with target.

    Weights repeat over the sources by code point, null last. The budget is share x all words. A source stops at
    most x source_size, and what it can't use goes to the others by weight until none is above: with sources in
    the order of cap per weight, those that stop are a prefix.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(everything)
    ranked = ranked.withColumn("_level", (budget - before) / rest)
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_i", "_level"))).over(everything)
    ranked = ranked.withColumn("_at", level["_level"])
    return ranked.select("source", "source_size", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_w"))).alias("target"))


def _ranked(rows: DataFrame, rates: DataFrame, salt: str) -> DataFrame:
    """rows (doc_id, source, size, ...) with the rates of their stratum, rank (_q) and rank bucket (_b)."""
    rows = rows.withColumn("_k", F.length(F.bin("size"))).withColumn("_u", unit_hash(F.col("doc_id"), salt))
    rates = rates.withColumnRenamed("source", "_source").withColumnRenamed("_k", "_rk")
    rows = rows.join(light(rates), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_k") == F.col("_rk"))).drop("_source", "_rk")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    return rows.withColumn("_q", F.when(F.col("_p") > 0, odds)).withColumn("_b", F.floor(F.col("_q") / (1 + F.col("_q")) * BUCKETS))


def shares(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, salt: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size) -> rates of each source and size stratum, and the decisions at each source's edge bucket."""
    strata = sizes.groupBy("source", F.length(F.bin("size")).alias("_k")).agg(F.sum("size").alias("_s"))
    targets = source_targets(strata.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, share, most)

    # the factor of each source: the strata that reach the most copies are a prefix by importance
    strata = strata.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("t.*", "s._k", "s._s")
    strata = strata.withColumn("_v", F.lit(IMPORTANCE) - F.col("_k"))
    by = Window.partitionBy("source").orderBy("_k")
    before = F.coalesce(F.sum("_s").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("_s") * F.col("_v")).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    strata = strata.withColumn("_c", F.when(rest > 0, (F.col("target") - F.lit(most) * before) / rest))
    factor = F.min(F.when(F.col("_c") * F.col("_v") <= most, F.struct("_k", "_c"))).over(Window.partitionBy("source"))["_c"]
    strata = strata.withColumn("_e", F.coalesce(F.least(F.lit(most), factor * F.col("_v")), F.lit(most)))
    strata = strata.withColumn("_whole", F.floor("_e")).withColumn("_p", F.col("_e") - F.floor("_e"))
    sure = F.sum(F.col("_s") * F.col("_whole")).over(Window.partitionBy("source"))
    strata = strata.withColumn("_left", F.col("target") - sure)
    rates = saved(strata.select("source", "_k", "source_size", "target", "_whole", "_p", "_left"), "rates")

    ranked = _ranked(sizes.select("doc_id", "source", "size"), rates, salt)
    sums = ranked.filter("_b is not null").groupBy("source", "_b").agg(F.sum("size").alias("_s"), F.first("_left").alias("_left"))
    upto = F.sum("_s").over(Window.partitionBy("source").orderBy("_b"))
    cut = sums.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_s")).filter("_upto > _left and (_from < _left or (_from = _left and _s > 0))")
    cut = cut.groupBy("source").agg(F.min(F.struct("_b", "_from")).alias("_cut")).select("source", F.col("_cut._b").alias("_cb"), F.col("_cut._from").alias("_from"))
    rates = rates.alias("r").join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left")
    rates = saved(rates.select("r.*", F.coalesce("c._cb", F.lit(BUCKETS)).alias("_cb"), "c._from"), "rates")

    inside = _ranked(sizes.select("doc_id", "source", "size"), rates, salt).filter("_b = _cb")
    inside = inside.withColumn("_in", F.sum("size").over(Window.partitionBy("source").orderBy("_q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    edge = inside.withColumn("_take", (F.col("_from") + F.col("_in") - F.col("size") / 2 <= F.col("_left")).cast("int"))
    return rates, saved(edge.groupBy("doc_id", "source", "size").agg(F.min("_take").alias("_take")), "edges")


def drawn(rows: DataFrame, rates: DataFrame, edges: DataFrame, salt: str = "mix") -> DataFrame:
    """rows with doc_id, source, size and others -> the same with source_size, target and copies, by shares() of them."""
    edges = light(edges.select(F.col("doc_id").alias("_d"), F.col("source").alias("_so"), F.col("size").alias("_si"), "_take"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_so")) & (F.col("size") == F.col("_si"))
    ranked = _ranked(rows, rates, salt).join(edges, same, "left")
    take = F.when(F.col("_b") < F.col("_cb"), 1).when(F.col("_b") == F.col("_cb"), F.coalesce("_take", F.lit(0))).otherwise(0)
    copies = (F.col("_whole") + take).cast("bigint")
    return ranked.select(*(F.col(c) for c in rows.columns), "source_size", "target", copies.alias("copies"))


def size_of(text: str = "text"):
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text, ...) -> doc_id, source, size: words of the text, 0 where it is null."""
    return docs.select("doc_id", "source", size_of().alias("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs -> doc_id, source, size, source_size, target, copies, taken = copies x size.

    Sizes are counted once and kept as a table, since the mix reads them several times. Repeated ids have the same
    random number, and rows alike in id, source and size are decided alike. Empty documents take nothing. A null source
    is a source of its own, the last. An empty table gives an empty result.
    """
    sizes = saved(sized(docs), "sizes")
    return drawn(sizes, *shares(sizes, **options)).withColumn("taken", F.col("size") * F.col("copies"))


def repeat_by_mix(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mix takes it; all its columns stay."""
    sizes = saved(sized(docs), "sizes")
    rows = docs.select("doc_id", "source", size_of().alias("size"), F.struct("*").alias("_row"))
    return drawn(rows, *shares(sizes, **options)).filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("_row.*")


def op4_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_RATED = """
rows_ as (
 select doc_id, source, size, length(bin(size)) k,
  (cast('0x' || substr(md5('mix' || coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint) + 0.5::double) / 4503599627370496.0::double u
 from (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) size from {docs})),
strata0 as (select source, k, cast(sum(size) as bigint) s from rows_ group by source, k),
src as (select source, cast(sum(s) as bigint) source_size, row_number() over (order by source asc nulls last) - 1 i from strata0 group by source),
caps as (select *, case i % 3 when 0 then 5 when 1 then 2 else 1 end w, 2.0::double * source_size cap from src),
levels as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by cap / w, i rows between current row and unbounded following) level from caps),
lev as (select level from levels where level * w <= cap order by cap / w, i limit 1),
tg as (select source, source_size, coalesce(least(cap, (select level from lev) * w), cap) target from levels),
st1 as (select t.source, s.k, s.s, t.source_size, t.target, 64 - s.k v from strata0 s join tg t on s.source is not distinct from t.source),
st2 as (select *, (target - 2.0::double * coalesce(sum(s) over (partition by source order by k rows between unbounded preceding and 1 preceding), 0))
  / nullif(sum(s * v) over (partition by source order by k rows between current row and unbounded following), 0) c from st1),
fac as (select source, arg_min(c, k) c from st2 where c * v <= 2 group by source),
st3 as (select a.*, case when f.c is null then 2.0::double else least(2.0::double, f.c * a.v) end e from st2 a left join fac f on a.source is not distinct from f.source),
st4 as (select *, target - sum(s * floor(e)) over (partition by source) left_ from st3),
rated as (select r.doc_id, r.source, r.size, t.source_size, t.target, floor(t.e) whole, t.left_, t.e - floor(t.e) p,
  case when t.e > floor(t.e) then (r.u / (1 - r.u)) / ((t.e - floor(t.e)) / (1 - (t.e - floor(t.e)))) end q
 from rows_ r join st4 t on r.source is not distinct from t.source and r.k = t.k),
drawn as (select *, cast(size * (whole + case when q is not null and sum(size) over (partition by source, q is null order by q, doc_id, size rows between unbounded preceding and current row) - size / 2.0::double <= left_ then 1 else 0 end) as bigint) taken from rated)
"""
OP4_SQL = f"with {_RATED.format(docs='documents')} select doc_id, size, source_size, target, taken from drawn"
