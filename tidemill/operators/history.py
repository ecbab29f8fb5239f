"""Revision histories and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import text as X


def content_hash(*columns: str) -> Column:
    """F24. MD5 of a record's JSON with sorted keys."""
    return F.md5(F.to_json(F.struct(*sorted(columns))))


def event_json(kind: Column, *columns: str) -> Column:
    """F25."""
    return F.to_json(F.struct(kind.alias("event"), *columns))


def is_noise(current: Column, expected: Column) -> Column:
    """Whether an issue asks for what is there already, but for spaces."""
    a, b = X.merge_space(current), X.merge_space(expected)
    return (a != "") & (a == b)


def filter_noise(issues: DataFrame, rec: str = "rec") -> DataFrame:
    """P4. (rec, cur, expected, pass) -> per record: issues dropped and left, and the verdict."""
    noise = is_noise(F.col("cur"), F.col("expected"))
    return issues.groupBy(rec).agg(F.count_if(noise).alias("dropped"), F.count_if(~noise).alias("left"), F.bool_and("pass").alias("_p")).select(
        rec, "dropped", "left", ((F.col("_p") & (F.col("left") == 0)) | ((F.col("left") == 0) & (F.col("dropped") > 0))).alias("passed")
    )


def issue_digest(issues: DataFrame, rec: str = "rec", order: str = "iter") -> DataFrame:
    """A9. The numbered lines of a record's issues."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "cur", "expected"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". 현재: "), X.text(x["cur"]), F.lit("\n   수정: "), X.text(x["expected"])))
    return issues.groupBy(rec).agg(F.array_join(lines, "\n").alias("digest"))


def convergence(revisions: DataFrame, rec: str = "rec", order: str = "iter", h: str = "h") -> DataFrame:
    """W8. The first revision at which three hashes in a row are equal, or two alternate twice; and which."""
    w = Window.partitionBy(rec).orderBy(order)
    a, b, c, d = (F.col(h) if i == 0 else F.lag(h, i).over(w) for i in range(4))
    reason = F.when((a == b) & (b == c), "converged").when((a == c) & (b == d) & (a != b), "oscillating")
    found = revisions.select(rec, order, reason.alias("reason")).filter("reason is not null")
    return found.groupBy(rec).agg(F.min(F.struct(order, "reason")).alias("_f")).select(rec, f"_f.{order}", "_f.reason")


def progress(events: DataFrame, job: str = "job_id", ts: str = "ts", order: str = "seq") -> DataFrame:
    """W9. At each completion: done, total, percent, seconds left by the pace so far (within ten minutes, else null)."""
    w = Window.partitionBy(job).orderBy(ts, order)
    whole = Window.partitionBy(job)
    rows = events.withColumn("done", F.row_number().over(w)).withColumn("total", F.count("*").over(whole)).withColumn("_t0", F.min(ts).over(whole))
    elapsed = (F.col(ts).cast("timestamp").cast("double") - F.col("_t0").cast("timestamp").cast("double")) * 0.9
    fraction = F.col("done") / F.col("total")
    eta = elapsed / fraction - elapsed + 5
    rows = rows.withColumn("percent", 10 + F.floor(80 * F.col("done") / F.col("total")))
    return rows.withColumn("eta", F.when((fraction > 0.05) & (eta > 0) & (eta < 600), F.round(eta, 3))).drop("_t0")


def fold_state(events: DataFrame, fields: list[str], job: str = "job_id", ts: str = "ts", order: str = "seq") -> DataFrame:
    """The latest value of each field of each job; events overwrite only what they carry. T2 is the same on a stream."""
    at = F.struct(ts, order)
    return events.groupBy(job).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields))
