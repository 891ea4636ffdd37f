from spanfold.llm.common import spread_out


def test_a_single_row_group_is_spread_over_the_cores(spark, tmp_path):
    spark.range(5_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    tasks = spark.sparkContext.defaultParallelism
    assert spread_out(one).rdd.getNumPartitions() == tasks and spread_out(one).count() == 5_000
    spark.range(5_000).repartition(2 * tasks).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    for df in (many, one.limit(10), one.where("id < 0"), spark.range(5)):
        assert spread_out(df).count() == df.count()
    assert spread_out(many) is many
