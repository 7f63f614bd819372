import pytest
from pyspark.sql import functions as F

from tallyframe import session


def test_small_inputs_are_spread_with_and_without_a_shuffle(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    for df in (one, one.groupBy((F.col("id") % 7).alias("k")).count(), one.join(F.broadcast(spark.range(5)), "id", "left_semi")):
        out = session.spread(df)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
        assert "RoundRobin" in out._jdf.queryExecution().optimizedPlan().toString() or "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString() or "Repartition" in out._jdf.queryExecution().optimizedPlan().toString()
    many = spark.range(0, 1000, 1, cores * 2)
    assert session.spread(many) is many


def test_a_machine_local_folder_is_refused_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())
