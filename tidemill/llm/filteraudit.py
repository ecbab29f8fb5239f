"""How filters act on each other, for every order they could be applied in, by counting paths forward and backward.

The states are the sets of filters already applied: a lattice of 2^n subsets, whose edges each apply one more filter. A
document is reduced to the set of filters it fails; an edge removes the documents that fail its filter and none of its
state. The orders that reach a state are counted from the empty set on, those that leave it from the full set back, and
their product over an edge is the number of orders that take it: it weighs the edge's removals for the Shapley sums.
The steps of an order are the edges along its path, so they are read from the same table.

The documents are read once and summed by part, failed set and label; nothing after that grows with their number.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, table

#: Filters by letter: a condition of failing over the columns of features(). COPY: the same text stands under a smaller id.
COPY = "copy"
FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_chars",
    "D": "marked",
    "E": COPY,
}
#: Most filters of an audit: the steps of all orders, n x n!, are sent to every executor.
MOST_FILTERS = 7
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, part, digest and the text's measures. A null text counts as empty, a null language is the part ''."""
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_text"))
    docs = docs.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    return docs.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("_text", 256)).alias("digest"),
        F.size("_words").cast("long").alias("n_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.length("_text").cast("long").alias("n_chars"),
        F.col("_text").rlike("[#$%&*|]").alias("marked"),
    )


def failures(featured: DataFrame, labels: DataFrame, filters: dict[str, str]) -> DataFrame:
    """-> part, fails (bit i: fails the i-th filter), n, good, toxic: documents summed by part and failed set.

    The first of equal texts is found per digest and matched by (digest, id), a key that no group of copies shares.
    A document without an id is no copy and makes none; rows that repeat an id are each the first.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(filters.values()) if rule != COPY]
    rows = featured.select("doc_id", "part", "digest", sum(bits, F.lit(0)).alias("fails"))
    copy = sum(1 << i for i, rule in enumerate(filters.values()) if rule == COPY)
    if copy:
        first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
        rows = rows.join(first, ["digest", "doc_id"], "left")
        rows = rows.withColumn("fails", F.col("fails") + F.when(F.col("_first").isNull() & F.col("doc_id").isNotNull(), copy).otherwise(0))
    known = labels.groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("_good"), F.bool_or(F.col("toxic") == 1).alias("_toxic"))
    rows = rows.join(known, "doc_id", "left")
    return rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if("_good").alias("good"), F.count_if("_toxic").alias("toxic"))


def paths(n: int) -> tuple[list[int], list[int]]:
    """For each state, the orders of its filters that reach it, and the orders of the others that leave it."""
    full = (1 << n) - 1
    reach, leave = [1] + [0] * full, [0] * full + [1]
    for state in range(full + 1):
        for i in range(n):
            if not state >> i & 1:
                reach[state | 1 << i] += reach[state]
    for state in range(full, -1, -1):
        for i in range(n):
            if not state >> i & 1:
                leave[state] += leave[state | 1 << i]
    return reach, leave


def edges(counts: DataFrame, n: int) -> DataFrame:
    """counts of failures() -> part, state, filter, the measures and shapley: the filter's removals summed over all orders."""
    full = (1 << n) - 1
    at = counts.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(full)))).withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = at.withColumn("_own", F.expr("shiftleft(1, filter)")).filter("state & _own = 0")
    total = lambda what, when: F.sum(F.when(F.expr(when), F.col(what)).otherwise(0)).alias
    here, gone = "fails & _own <> 0 and fails & state = 0", "fails & _own <> 0 and fails & state <> 0"
    found = at.groupBy("part", "state", "filter").agg(
        total("n", "fails & (state | _own) = 0")("kept"),
        total("n", here)("removed"),
        total("n", gone)("redundant"),
        total("n", "fails = _own")("unique_fails"),
        total("good", here)("good_lost"),
        total("toxic", here)("toxic_lost"),
    )
    reach, leave = (F.array(*map(F.lit, x)) for x in paths(n))
    orders = reach[F.col("state")] * leave[F.expr("state | shiftleft(1, filter)")]
    return found.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "filter")))


def audit(featured: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """-> part, filter_order, step, the measures and shapley: every step of every order of the filters, zeros included.

    featured: doc_id, part, digest and what the conditions read (features() makes them). labels: doc_id, quality, toxic; a
    document labelled twice counts as good or toxic if any label says so. Nulls: no condition that is null fails; see
    failures() for ids. Repeated rows count as often as they stand there. Very long texts are one row of measures.
    An empty table has no parts and gives no rows. Columns of other names play no part.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    letters = list(filters)
    steps = [("".join(letters[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    steps = featured.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    # n x n! rows of the steps: a bound by parameter
    found = edges(failures(featured, labels, filters), n).join(F.broadcast(steps), ["state", "filter"])
    return found.select("part", "filter_order", "step", *MEASURES, "shapley")


def op12_filteraudit(spark, sf_dir) -> DataFrame:
    return audit(features(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with recursive t as (select doc_id, coalesce(lang, '') part, coalesce(text, '') s from documents),
w as (select *, regexp_extract_all(s, '[^\x20\x09-\x0D]+') ws, min(doc_id) over (partition by s) first from t),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by 1),
f as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic, [
  len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 10 * length(s),
  regexp_matches(s, '[#$%&*|]'), coalesce(doc_id > first, false)] fails
  from w left join l using (doc_id)),
c as (select part, fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from f group by 1, 2),
o as (select '' filter_order union all select filter_order || x from o, (select unnest(['A', 'B', 'C', 'D', 'E']) x) where not contains(filter_order, x)),
s as (select filter_order, unnest(range(1, 6)) k from o where length(filter_order) = 5),
e as (select part, filter_order, k, substr(filter_order, k, 1) letter, n, good, toxic, fails[ascii(substr(filter_order, k, 1)) - 64] own,
  (select coalesce(bool_or(fails[ascii(substr(filter_order, j, 1)) - 64]), false) from (select unnest(range(1, 6)) j) where j < k) before,
  len(list_filter(fails, lambda x: x)) = 1 alone from c, s),
g as (select part, filter_order, k, letter, sum(case when not own and not before then n else 0 end) kept, sum(case when own and not before then n else 0 end) removed,
  sum(case when own and before then n else 0 end) redundant, sum(case when own and alone then n else 0 end) unique_fails,
  sum(case when own and not before then good else 0 end) good_lost, sum(case when own and not before then toxic else 0 end) toxic_lost
  from e group by 1, 2, 3, 4)
select part, filter_order, cast(k as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant,
  cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) shapley from g"""
