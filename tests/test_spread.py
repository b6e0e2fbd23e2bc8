"""Files made of a small table are many tasks' work."""

from lodestrata.plans import code as P


def test_files_of_a_small_table_are_dealt_out(spark, tmp_path):
    spark.range(1, 5001).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = P.files(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 3 and got.count() == 5000
