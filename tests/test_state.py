import pytest
from pyspark.sql import functions as F

from quireflow.operators import profile as P
from quireflow.operators import state as K


def test_versions(spark, tmp_path):
    path = str(tmp_path / "keyed")
    assert K.read_current(spark, path) is None
    K.publish(spark.range(3).toDF("id"), path, "v1")
    assert K.read_current(spark, path).count() == 3
    with pytest.raises(ValueError):
        K.publish(spark.range(5).toDF("id"), path, "v2", check=lambda df: df.count() == 4)
    assert K.current_version(spark, path) == "v1"
    K.publish(spark.range(5).toDF("id"), path, "v3", check=lambda df: df.count() == 5)
    assert K.read_current(spark, path).count() == 5


def test_keyed_tables(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], "k string, v string, t int")
    new = spark.createDataFrame([("a", "3", 1), ("c", "4", 0), ("b", "0", 0)], "k string, v string, t int")
    assert sorted((r.k, r.v) for r in K.upsert(old, new, "k", "t").collect()) == [("a", "3"), ("b", "2"), ("c", "4")]
    same = spark.createDataFrame([("a", "1"), ("d", "9")], "k string, v string")
    assert sorted((r.k, r.v) for r in K.insert_or_ignore(old, same, "k", "v").collect()) == [("a", "1"), ("b", "2"), ("d", "9")]
    with pytest.raises(Exception, match="conflict under a"):
        K.insert_or_ignore(old, new.where("k = 'a'"), "k", "v").collect()
    bad = spark.createDataFrame([("n", bytearray(b"x"), "0")], "name string, content binary, sha256 string")
    with pytest.raises(Exception, match="checksum of n"):
        K.checked(bad).collect()
    assert K.pending(new, old, "k").select("k").collect()[0].k == "c"


def test_metrics(spark):
    text = '# HELP x\nrunning{engine="0"} 2\nrunning{engine="1"} 3\nok_total{finished_reason="stop"} 12\nok_total{engine="1",finished_reason="stop"} 8\nok_total{finished_reason="length"} 4\ntime_bucket{le="1"} 99\nbroken line here\n'
    got = {(r.metric, r.reason): r.value for r in P.parse_metrics(spark.createDataFrame([(1, text)], "sample int, text string")).collect()}
    assert got == {("running", None): 5.0, ("ok_total", "stop"): 20.0, ("ok_total", "length"): 4.0}
    v = spark.createDataFrame([("1, 2.5, 3, 4e1",), ("1, N/A, 3, 4",), ("1,2",), (None,)], "l string").select(P.gpu_values(F.col("l")).alias("v")).collect()
    assert [r.v for r in v] == [[1.0, 2.5, 3.0, 40.0], None, None, None]


def test_markers(spark):
    e = spark.createDataFrame([(1, "a", 1.0), (1, "b", 5.0), (1, "a", 3.0), (2, "a", 2.0)], "g int, k string, at double")
    got = {(r.g, r.k): (r.start, r.stop) for r in P.markers(e, ["a", "b"], "g", "at", "k").collect()}
    assert got == {(1, "a"): (1.0, 5.0), (1, "b"): (5.0, None), (2, "a"): (2.0, None)}
    with pytest.raises(Exception, match="out of order"):
        P.markers(e, ["b", "a"], "g", "at", "k").collect()
