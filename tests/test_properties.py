"""Property test of the exact-positions helper on random groupings and bucket widths."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fedtab.operators.positions import group_positions, int_bucket


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.integers(0, 10_000), min_size=1, max_size=300, unique=True),
       groups=st.integers(1, 5), width=st.integers(1, 64))
def test_positions_equal_row_number(spark, keys, groups, width):
    rows = [(k % groups, k) for k in keys]
    df = spark.createDataFrame(rows, "g long, k long")
    got = group_positions(df, ["g"], ["k"], bucket=int_bucket("k", width))
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    joined = got.join(ref, ["g", "k"])
    assert joined.count() == len(rows)
    assert joined.filter(F.col("pos") != F.col("ref")).count() == 0
