from pyspark.sql import functions as F

from loomline.operators.marks import marked, without
from loomline.sources.shared import keyed, made, settled, written


def test_marks_name_the_chosen_rows(spark):
    df = written(spark.range(100_000).withColumn("text", F.concat(F.lit("t"), "id")).repartition(3), "test-marks")
    rows = keyed(df, "key")
    chosen = rows.filter("id % 7 = 0 or id > 99000").select("key")
    for most in (16_384, 0):
        got = marked(rows, "key", chosen.unionByName(chosen), "hit", most)
        assert got.columns.count("hit") == 1 and got.count() == 100_000
        assert got.filter(F.col("hit") != ((F.col("id") % 7 == 0) | (F.col("id") > 99_000))).count() == 0
    assert without(rows, "key", chosen).filter("id % 7 = 0 or id > 99000").count() == 0
    assert marked(rows, "key", chosen.limit(0), "hit").filter("hit").count() == 0
    assert without(rows.limit(0), "key", chosen).count() == 0


def test_marks_move_no_rows(spark):
    df = written(spark.range(1000).repartition(2), "test-marks")
    plan = without(keyed(df, "key"), "key", keyed(df, "key").filter("id < 5").select("key"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_settled_removes_what_a_step_wrote(spark):
    before = made()
    a = written(spark.range(5), "test-step")
    b = settled(a.selectExpr("id + 1 as id"), "test-step", before)
    assert made() == before + 1 and sorted(x.id for x in b.collect()) == [1, 2, 3, 4, 5]
