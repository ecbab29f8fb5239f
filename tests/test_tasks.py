"""Large tables are dealt over tasks by their rows, not by the session's number of them."""

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemill.operators import rows
from tidemill.plans import fixtures
from tidemill.plans.queries import QUERIES


def test_tasks_follow_rows(spark, monkeypatch):
    before = {n: sorted(map(str, QUERIES[n](spark, SF).collect())) for n in ("a2_case_majority", "w3_segment")}
    monkeypatch.setattr(fixtures, "TASK_ROWS", 5000)
    tasks = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    by_order, by_doc = tasks(fixtures.load(spark, SF, "nf_rows")), tasks(rows.islands(fixtures.load(spark, SF, "nf_rows", ("doc_id",))))
    assert sum(by_order) == 60000 and len(by_order) == 12 and max(by_order) < 7500
    assert len(by_doc) > spark.sparkContext.defaultParallelism
    for n, want in before.items():
        assert sorted(map(str, QUERIES[n](spark, SF).collect())) == want


def test_texts_are_made_after_rows_are_dealt(spark, monkeypatch):
    """The shuffle by document carries numbers; the texts of rows are made where they are used, and move no more."""
    monkeypatch.setattr(fixtures, "TASK_ROWS", 5000)
    found = rows.islands(fixtures.load(spark, SF, "nf_rows", ("doc_id",)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    texts = plan.index("\ub2ec\uc131\uad70")
    assert plan.count("Exchange hashpartitioning(") == 3 and "Exchange" not in plan[:texts] and "Exchange" in plan[texts:]


def test_islands_sort_once(spark):
    """Cells are made once a row, all windows of islands share one sort, and a use ends with its case."""
    made = spark.createDataFrame([(1, k, 1, *cells) for k, cells in enumerate([
        ("", "", "", "before", "", "", ""), ("2023타경1", "", "아파트", "a", "", "", ""), ("", "2", "", "b", "", "1,000\r900", ""), ("2023 타경 2\n2023타경3(중복)", "", "", "c", "", "", ""), ("", "5", "임야", "d", "", "78", ""),
    ])], "doc_id int, ok int, seq int, " + ", ".join(f"{n} string" for n in rows.CELLS))
    found = rows.islands(rows.rows_normalise(rows.as_cells(made)))
    got = [tuple(r) for r in found.orderBy("ok").select("rec_no", "case_no", "dup_tag", "item_no", "use").collect()]
    assert got == [(1, "2023타경1", "", "1", "아파트"), (2, "2023타경1", "", "2", "아파트"), (3, "2023타경2", "2023타경3[중복]", "1", ""), (4, "2023타경2", "2023타경3[중복]", "5", "임야")]
    prices = rows.assemble(found).orderBy("rec_no").select("price", "min_price", F.col("price_value").cast("int")).collect()
    assert [tuple(r) for r in prices] == [("", "", None), ("1,000", "900", 1000), ("", "", None), ("78", "78", 78)]
    plan = rows.islands(rows.rows_normalise(rows.as_cells(fixtures.load(spark, SF, "nf_rows"))))._jdf.queryExecution()
    # one sort is that of the row numbers of orders
    assert plan.executedPlan().toString().count("Sort [") == 2 and "size(array" not in plan.optimizedPlan().toString()
