from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cadastra import session


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def fake(master, **conf):
    context = SimpleNamespace(master=master, getConf=lambda: Conf(conf), getCheckpointDir=lambda: None)
    return SimpleNamespace(sparkContext=context, conf=Conf({"spark.sql.shuffle.partitions": "2000"}))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        session.shared_folder(fake("spark://host:7077"))
    assert session.shared_folder(fake("yarn", **{"spark.checkpoint.dir": "/shared"})) == "/shared"
    one = fake("local[2]")
    assert session.shared_folder(one) == session.shared_folder(one)


def test_salts_follow_the_shuffle_partitions():
    spark = fake("local[2]")
    assert session.salts(spark) == session.MOST_SALTS
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert session.salts(spark) == session.FEWEST_SALTS


def test_a_side_is_broadcast_only_up_to_its_bound(spark):
    big = spark.createDataFrame([("a", n) for n in range(50)] + [("b", 1), (None, 2)], "k string, n int")
    small = spark.createDataFrame([("a", "x" * 1000), ("c", None)], "k string, v string")
    for how, count in (("inner", 50), ("left_outer", 52)):
        for most, broadcast in ((10_000, True), (500, False)):
            joined = session.sized_join(big, small, ["k"], [F.col("n")], how, most)
            assert joined.count() == count
            assert ("Broadcast" in joined._jdf.queryExecution().analyzed().toString() or "broadcast" in joined._jdf.queryExecution().analyzed().toString()) == broadcast
    assert session.sized_join(big, small.where("false"), ["k"], [F.col("n")], "left_outer").count() == 52
