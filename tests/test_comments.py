"""Comments and lines of files in one pass, and files that are dealt out by path stay where they are."""

from pyspark.sql import functions as F

from lodestrata.operators import facts as B
from lodestrata.plans import code as P

TEXTS = {
    "a\n/* b\n\n c **/\n\nd": "a\n\n\n\n\nd",
    "\n//x\n\n//y": "\n\n\n",
    "f('//', /[/*]/, `/* ${a /* b */}`) // c": "f('//', /[/*]/, `/* ${a /* b */}`) ",
    "a /*/ b */ c/**/d /* open\n": "a  cd \n",
    "it's /* x */ \"a\n": "it's  \"a\n",
}


def test_comments_go_and_line_breaks_stay(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", B.uncommented(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == TEXTS


def test_lines_of_dealt_files_are_not_moved(spark, tmp_path):
    spark.range(1, 5001).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    ls = B.code_lines(P.files(spark, str(tmp_path)))
    plan = ls._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    health = B.parse_health(ls)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in health


def test_health_without_windows_is_as_before(spark):
    f = spark.createDataFrame([("s", "a", "f({\n})"), ("s", "b", "f({\n}"), ("s", "c", "}\n{"), ("s", "d", ""), ("s", "e", ")")], "snapshot_id string, path string, content string")
    assert {r.path: r.has_errors for r in B.parse_health(B.code_lines(f)).collect()} == {"a": False, "b": True, "c": False, "d": False, "e": True}
