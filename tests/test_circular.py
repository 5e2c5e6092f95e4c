from pyspark.sql import functions as F

from wayline.functions.circular import direction, direction_bin


def test_direction_at_the_edge_of_a_bin(spark):
    """Displacements on which the JVM's arc tangent differs from the C library's by the last digit."""
    rows = [(-5.999999999999998, -6.0, 8), (-11.999999999999996, -12.0, 8), (-14.000000000000007, 14.0, 26), (0.0, 0.0, 36), (1.0, 1.0, 45), (0.0, -1.0, 0), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "dx double, dy double, b int")
    got = df.select("b", direction_bin(direction(F.col("dx"), F.col("dy")), 5).alias("got")).collect()
    assert [r.got for r in got] == [r.b for r in got]
