"""Review: patches, deletions, order, corrections and similar examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill import rules as R
from tidemill.functions import text as X


def patch(records: DataFrame, changes: DataFrame, edits: DataFrame, locations: DataFrame | None = None, keys: tuple[str, str] = ("job_id", "idx"), order: str = "at") -> DataFrame:
    """J7. Records after group changes (keys, at, new_grp: valid groups only) and edits (keys, at, field, value: editable fields only, null is empty).

    Edited locations (keys, at, locations: array of address and use, nulls empty) take the place of the record's. Of several
    changes of one field the last by `at` holds.
    """
    keys = list(keys)
    valid = changes.filter(F.col("new_grp").isin([*R.GROUPS, R.EXCLUDED])).groupBy(*keys).agg(F.max_by("new_grp", F.struct(order, "new_grp")).alias("_grp"))
    fields = [f for f in R.EDITABLE if f in records.columns and f != "locations"]
    value = F.coalesce("value", F.lit(""))
    wide = edits.filter(F.col("field").isin(fields)).groupBy(*keys).agg(*(F.max_by(value, F.when(F.col("field") == f, F.struct(order, value.alias("v")))).alias(f"_{f}") for f in fields))
    rows = records.join(valid, keys, "left").join(wide, keys, "left").withColumn("old_grp", F.col("grp"))
    out = {"grp": F.coalesce("_grp", "grp")} | {f: F.coalesce(f"_{f}", f) for f in fields}
    if locations is not None:
        clean = lambda x: F.struct(F.coalesce(x["address"], F.lit("")).alias("address"), F.coalesce(x["use"], F.lit("")).alias("use"))
        edited = locations.groupBy(*keys).agg(F.max_by(F.transform("locations", clean), F.struct(order, F.to_json("locations"))).alias("_locations"))
        rows = rows.join(edited, keys, "left")
        out["locations"] = F.coalesce("_locations", "locations")
    return rows.select(*(out.get(c, F.col(c)).alias(c) for c in records.columns), "old_grp")


def delete(records: DataFrame, deleted: DataFrame, keys: tuple[str, str] = ("job_id", "idx")) -> DataFrame:
    """J8. Without the deleted indices (text); malformed ones are ignored."""
    gone = deleted.select(keys[0], F.col(keys[1]).try_cast("int").alias(keys[1])).filter(f"{keys[1]} is not null")
    return records.join(gone, list(keys), "left_anti")


def explicit_order(records: DataFrame, order: DataFrame, keys: tuple[str, str] = ("job_id", "idx")) -> DataFrame:
    """O2. rank: rows that order (keys, pos) names come first, by their first mention; then the rest by index."""
    first = order.groupBy(*keys).agg(F.min("pos").alias("_pos"))
    rows = records.join(first, list(keys), "left")
    w = Window.partitionBy(keys[0]).orderBy(F.col("_pos").isNull(), "_pos", keys[1])
    return rows.withColumn("rank", F.row_number().over(w)).drop("_pos")


def corrections(patched: DataFrame, signature: Column, at: Column) -> DataFrame:
    """F26. A row for each record whose group changed."""
    names = [c for c in ("job_id", "idx", "case_no", "item_no", "note", "locations") if c in patched.columns]
    return patched.filter("old_grp <> grp").select(*names, F.col("old_grp").alias("original_group"), F.col("grp").alias("group"), signature.alias("signature_text"), at.alias("timestamp"))


def last_n(log: DataFrame, n: int = 200, order: str = "seq") -> DataFrame:
    """W7. The last rows of a log; a bounded top-n, so no global sort."""
    return log.orderBy(F.desc(order)).limit(n)


def similar(targets: DataFrame, log: DataFrame, key: str, text: str, n: int = 200, k: int = 3) -> DataFrame:
    """J3 and W6. For each target its k most alike of the last n corrections, by Jaccard of keyword sets; ties in log order.

    The example side has n rows at most. Its words go to every executor and meet the targets' words, and common words are
    counted per pair where the target is, so that the work follows the matches. key must be unique.
    """
    examples = last_n(log, n).select("seq", "case_no", "grp", "signature_text", X.keywords(F.col("signature_text")).alias("_e"))
    words = examples.select("seq", F.size("_e").alias("_ne"), F.explode("_e").alias("_w"))
    own = targets.select(key, X.keywords(F.col(text)).alias("_t")).select(key, F.size("_t").alias("_nt"), F.explode("_t").alias("_w"))
    common = own.join(F.broadcast(words), "_w").groupBy(key, "_nt", "seq", "_ne").agg(F.count("*").alias("_o"))
    score = F.col("_o") / (F.col("_nt") + F.col("_ne") - F.col("_o"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "seq"))
    found = common.select(key, "seq", score.alias("score")).withColumn("rank", best).filter(F.col("rank") <= k)
    return found.join(F.broadcast(examples.drop("_e")), "seq").select(key, "seq", "case_no", "grp", "signature_text", "score", "rank")


def group_counts(log: DataFrame, group: str = "grp") -> DataFrame:
    """A3. Corrections and their cases by group."""
    return log.groupBy(group).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("case_no")).alias("cases"))


def examples_text(found: DataFrame, key: str) -> DataFrame:
    """F27. The numbered digest of a target's similar corrections."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". 사건: "), F.coalesce("case_no", F.lit("?")), F.lit(' → group="'), F.coalesce("grp", F.lit(R.OTHER)), F.lit('"\n   특징: '), F.replace(F.substring("signature_text", 1, 200), F.lit("\n"), F.lit(" ")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])
    text = F.concat(F.lit("[사용자 검수로 학습된 분류 예시]\n"), F.array_join(ordered, "\n"), F.lit("\n위 예시와 패턴이 비슷하면 같은 group으로 분류한다.\n"))
    return found.groupBy(key).agg(text.alias("block"))
